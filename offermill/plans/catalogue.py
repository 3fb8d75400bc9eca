"""Named queries over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import barcodes, fixed, formats, parse, scores, urls
from ..functions.numbers import half_up, plain, prefix_integer, prefix_number
from ..operators import frontier, leaderboard, limits, ranking
from ..operators.storage import kept
from . import catalogue_sql as sql
from . import discovery, markup, tables  # noqa: F401
from .offers import offers, panels, table, tasks
from .register import ORACLES, QUERIES, query  # noqa: F401

def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ranking reads of offers, stored, as codes are counted over all of them first."""
    columns = "ordinal, title, price, currency, quantity, unit, vendor, url, primaryUpc, shipping_cost, free_shipping, discount_percent, coupon"
    return kept(offers(spark, sf_dir).select(*columns.split(", "), barcodes.upc_a(F.col("primaryUpc")).alias("valid_upc")), "offers")


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_offers(_coded(spark, sf_dir))


OUT = "rank, title, vendor, price_per_unit, price_per_unit_usd, confidence, deal_score"


@query(f"WITH {sql.RANKED} SELECT {OUT} FROM ranked")
def offers_ranked_top50(spark, sf_dir):
    return _ranked(spark, sf_dir).select(*OUT.split(", "))


@query(f"WITH {sql.RANKED} SELECT {OUT} FROM ranked ORDER BY confidence >= 0.7 DESC, rank LIMIT 1")
def best_deal(spark, sf_dir):
    return ranking.best_deal(_ranked(spark, sf_dir)).select(*OUT.split(", "))


@query(f"WITH {sql.RANKED} SELECT {OUT} FROM ranked WHERE url NOT IN (SELECT url FROM ranked ORDER BY confidence >= 0.7 DESC, rank LIMIT 1)")
def other_results(spark, sf_dir):
    df = kept(_ranked(spark, sf_dir), "ranked")
    return ranking.other_results(df, ranking.best_deal(df)).select(*OUT.split(", "))


@query(f"WITH {sql.RANKED} SELECT ordinal, {sql.js('raw', 4)} AS ppu, {sql.js('raw * ' + sql.USD, 4)} AS ppu_usd, quantity * {sql.GRAMS} AS grams, price * {sql.USD} AS usd FROM sure")
def price_per_unit_usd(spark, sf_dir):
    ppu = scores.per_unit(F.col("price"), F.col("quantity"), F.col("unit"))
    return ranking.verified(_coded(spark, sf_dir)).select("ordinal", half_up(ppu, 4).alias("ppu"), half_up(scores.usd(ppu, F.col("currency")), 4).alias("ppu_usd"), scores.grams(F.col("quantity"), F.col("unit")).alias("grams"), scores.usd(F.col("price"), F.col("currency")).alias("usd"))


@query(f"WITH {sql.OFFERS} SELECT currency, count(*) AS n, bool_and(price * {sql.USD} = price) AS unchanged FROM offers GROUP BY currency")
def unknown_currency_default(spark, sf_dir):
    return offers(spark, sf_dir).groupBy("currency").agg(F.count(F.lit(1)).alias("n"), F.bool_and(scores.usd(F.col("price"), F.col("currency")) == F.col("price")).alias("unchanged"))


@query(f"WITH {sql.RANKED} SELECT ordinal, {sql.js('conf', 6)} AS confidence FROM sure")
def confidence_upc(spark, sf_dir):
    df = ranking.verified(_coded(spark, sf_dir))
    c = scores.confidence_with_upc(F.col("price"), F.col("quantity"), F.col("unit"), F.col("title"), F.col("valid_upc"), F.col("matches"))
    return df.select("ordinal", half_up(c, 6).alias("confidence"))


@query(f"""WITH {sql.OFFERS} SELECT ordinal, {sql.js(f'''least(1.0::DOUBLE, (CASE WHEN price > 0 THEN 0.3::DOUBLE ELSE 0 END) + (CASE WHEN quantity > 0 THEN 0.3::DOUBLE ELSE 0 END) + (CASE WHEN {sql.KNOWN} THEN 0.2::DOUBLE ELSE 0 END)
 + (CASE WHEN length(title) > 10 THEN 0.1::DOUBLE ELSE 0 END) + (CASE WHEN length(title) > 10 AND {sql.NAMES} THEN 0.1::DOUBLE ELSE 0 END))''', 6)} AS confidence FROM offers""")
def confidence_plain(spark, sf_dir):
    return offers(spark, sf_dir).select("ordinal", half_up(scores.confidence(F.col("price"), F.col("quantity"), F.col("unit"), F.col("title")), 6).alias("confidence"))


@query(f"WITH {sql.OFFERS} SELECT ordinal, count(*) OVER (PARTITION BY upc) - 1 AS matches FROM offers")
def cross_vendor_matches(spark, sf_dir):
    return ranking.cross_vendor(offers(spark, sf_dir)).select("ordinal", "matches")


@query(f"WITH {sql.RANKED} SELECT ordinal, {sql.js('least((CASE WHEN valid_upc THEN 0.4::DOUBLE ELSE 0 END) + (CASE WHEN matches > 0 THEN least(matches * 0.1::DOUBLE, 0.4::DOUBLE) ELSE 0 END), 1.0::DOUBLE)', 6)} AS score FROM matched")
def verification_score(spark, sf_dir):
    return ranking.verified(_coded(spark, sf_dir)).select("ordinal", half_up(F.col("verification_score"), 6).alias("score"))


@query(f"WITH {sql.RANKED} SELECT vendor, count(*) AS n, min(price_per_unit) AS least FROM firsts GROUP BY vendor")
def vendor_price_dedupe(spark, sf_dir):
    df = ranking.scored(ranking.priced(ranking.verified(_coded(spark, sf_dir))))
    return ranking.one_per_vendor_price(df, F.desc("deal_score"), F.asc("ordinal")).groupBy("vendor").agg(F.count(F.lit(1)).alias("n"), F.min("price_per_unit").alias("least"))


@query(f"WITH {sql.RANKED} SELECT ordinal, floor((avg(price_per_unit) OVER () - price_per_unit) / avg(price_per_unit) OVER () * 100 + 0.5) AS savings FROM priced")
def savings_vs_avg(spark, sf_dir):
    return ranking.savings(ranking.priced(ranking.verified(_coded(spark, sf_dir)))).select("ordinal", "savings")


_PARTS = "p_partkey, p_name || ' ' || ['12.5 kg', '60 Capsules', '2 fl. oz', '3 veggie caps', '40 mgs', '500GRAMS pack', '7 scoops x', 'no size'][p_partkey % 8 + 1] AS t"


@query(f"WITH p AS (SELECT {_PARTS} FROM part), q AS (SELECT p_partkey, {sql.quantity('t')} AS q FROM p) SELECT p_partkey, q.value AS value, q.unit AS unit FROM q")
def parse_quantity_titles(spark, sf_dir):
    tails = F.array(*(F.lit(x) for x in ("12.5 kg", "60 Capsules", "2 fl. oz", "3 veggie caps", "40 mgs", "500GRAMS pack", "7 scoops x", "no size")))
    df = table(spark, sf_dir, "part").select("p_partkey", parse.quantity(F.concat_ws(" ", "p_name", F.element_at(tails, (F.col("p_partkey") % 8 + 1).cast("int")))).alias("q"))
    return df.select("p_partkey", "q.value", "q.unit")


_PRICE_TEXTS = "CASE partkey % 7 WHEN 0 THEN '$' || d WHEN 1 THEN 'now € ' || c WHEN 2 THEN d || ' gbp' WHEN 3 THEN 'only ' || d WHEN 4 THEN '$1,' || d WHEN 5 THEN '£0' ELSE 'SEK ' || (cents // 100) END"


@query(f"WITH {sql.OFFERS}, d AS (SELECT ordinal, partkey, cents, (cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS d FROM offers), t AS (SELECT ordinal, partkey, cents, d, replace(d, '.', ',') AS c FROM d), q AS (SELECT ordinal, {sql.price('(' + _PRICE_TEXTS + ')')} AS q FROM t) SELECT ordinal, q.value AS value, q.currency AS currency FROM q")
def parse_price_text(spark, sf_dir):
    d = F.concat((F.col("cents") / 100).cast("long").cast("string"), F.lit("."), F.lpad((F.col("cents") % 100).cast("string"), 2, "0"))
    k = F.col("partkey") % 7
    text = F.when(k == 0, F.concat(F.lit("$"), d)).when(k == 1, F.concat(F.lit("now € "), F.replace(d, F.lit("."), F.lit(",")))).when(k == 2, F.concat(d, F.lit(" gbp"))).when(k == 3, F.concat(F.lit("only "), d)).when(k == 4, F.concat(F.lit("$1,"), d)).when(k == 5, F.lit("£0")).otherwise(F.concat(F.lit("SEK "), (F.col("cents") / 100).cast("long").cast("string")))
    return offers(spark, sf_dir).select("ordinal", parse.price(text).alias("q")).select("ordinal", "q.value", "q.currency")


@query(r"""WITH t AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size || 'W mono panel 21.5% efficiency 1722 x 1134 x 30 mm, 21.5 kg' WHEN 1 THEN '0.' || p_size || ' kW Bifacial, efficiency: ' || p_size || ' percent, 47 lbs' WHEN 2 THEN p_size || '-Watt thin film 70.5x40 inches' WHEN 3 THEN 'poly ' || p_size || '%' WHEN 4 THEN '10 × 20 × 3 in amorphous 900 kg' ELSE p_name END AS t FROM part),
w AS (SELECT *, TRY_CAST(nullif(regexp_extract(t, '(?i)(\d+(?:\.\d+)?)\s*kw', 1), '') AS DOUBLE) AS kw, TRY_CAST(nullif(regexp_extract(t, '(?i)(\d+(?:\.\d+)?)\s*[-]?\s*(?:watt(?:s)?|w)\b', 1), '') AS DOUBLE) AS w, TRY_CAST(nullif(regexp_extract(t, '(?i)(\d+(?:\.\d+)?)\s*kg', 1), '') AS DOUBLE) AS kg, TRY_CAST(nullif(regexp_extract(t, '(?i)(\d+(?:\.\d+)?)\s*(?:lbs?|pounds?)', 1), '') AS DOUBLE) AS lb,
 list_filter([TRY_CAST(nullif(regexp_extract(t, '(?i)efficiency\s*[:=]?\s*(\d+(?:\.\d+)?)\s*%', 1), '') AS DOUBLE), TRY_CAST(nullif(regexp_extract(t, '(?i)(\d+(?:\.\d+)?)\s*%\s*efficiency', 1), '') AS DOUBLE), TRY_CAST(nullif(regexp_extract(t, '(?i)(\d+(?:\.\d+)?)\s*percent\s*efficiency', 1), '') AS DOUBLE), TRY_CAST(nullif(regexp_extract(t, '(?i)efficiency\s*[:=]?\s*(\d+(?:\.\d+)?)\s*percent', 1), '') AS DOUBLE), TRY_CAST(nullif(regexp_extract(t, '(\d+(?:\.\d+)?)\s*%', 1), '') AS DOUBLE), TRY_CAST(nullif(regexp_extract(t, '(?i)(\d+(?:\.\d+)?)\s+percent', 1), '') AS DOUBLE)], lambda x: x BETWEEN 5 AND 50) AS e FROM t)
SELECT p_partkey, CAST(CASE WHEN kw > 0 AND kw < 100 THEN floor(kw * 1000 + 0.5) WHEN w > 0 AND w < 100000 THEN floor(w + 0.5) END AS BIGINT) AS wattage,
 CASE WHEN lower(t) LIKE '%bifacial%' THEN 'bifacial' WHEN lower(t) LIKE '%mono%' THEN 'monocrystalline' WHEN lower(t) LIKE '%poly%' THEN 'polycrystalline' WHEN regexp_matches(lower(t), 'thin[\s-]?film|amorphous') THEN 'thin-film' ELSE 'unknown' END AS kind,
 e[1] AS efficiency, CASE WHEN kg > 0 AND kg < 500 THEN kg WHEN lb > 0 AND lb < 1000 THEN floor(lb * 0.453592::DOUBLE * 100 + 0.5) / 100 END AS weight,
 CASE p_partkey % 6 WHEN 0 THEN 1722.0 WHEN 2 THEN floor(70.5 * 25.4::DOUBLE * 10 + 0.5) / 10 WHEN 4 THEN 254.0 END::DOUBLE AS length_mm, CASE p_partkey % 6 WHEN 0 THEN 30.0 WHEN 4 THEN 76.2 END::DOUBLE AS depth_mm FROM w""")
def solar_spec_parsers(spark, sf_dir):
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 6
    c = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v for v in x))
    t = F.when(k == 0, c(size, "W mono panel 21.5% efficiency 1722 x 1134 x 30 mm, 21.5 kg")).when(k == 1, c("0.", size, " kW Bifacial, efficiency: ", size, " percent, 47 lbs")).when(k == 2, c(size, "-Watt thin film 70.5x40 inches")).when(k == 3, c("poly ", size, "%")).when(k == 4, c("10 × 20 × 3 in amorphous 900 kg")).otherwise(F.col("p_name"))
    df = table(spark, sf_dir, "part").select("p_partkey", t.alias("t"))
    t = F.col("t")
    d = parse.dimensions(t)
    return df.select("p_partkey", parse.wattage(t).alias("wattage"), parse.panel_type(t).alias("kind"), parse.efficiency(t).alias("efficiency"), parse.weight_kg(t).alias("weight"), d["lengthMm"].alias("length_mm"), d["depthMm"].alias("depth_mm"))


@query(f"WITH {sql.OFFERS}, c AS (SELECT ordinal, upc, '0' || upc AS ean, '10' || upc AS gtin FROM offers) SELECT ordinal, {sql.check('upc', 12)} AS upc_ok, {sql.check('ean', 13)} AS ean_ok, {sql.check('gtin', 14)} AS gtin_ok FROM c")
def barcode_check_digits(spark, sf_dir):
    upc = F.col("primaryUpc")
    return offers(spark, sf_dir).select("ordinal", barcodes.upc_a(upc).alias("upc_ok"), barcodes.ean_13(F.concat(F.lit("0"), upc)).alias("ean_ok"), barcodes.gtin_14(F.concat(F.lit("10"), upc)).alias("gtin_ok"))


_CODES = "CASE partkey % 6 WHEN 0 THEN upc WHEN 1 THEN '0' || upc WHEN 2 THEN substr(upc, 1, 3) || '-' || substr(upc, 4, 8) WHEN 3 THEN 'SKU-' || partkey WHEN 4 THEN 'a' ELSE '10' || upc END"


@query(f"""WITH {sql.OFFERS}, n AS (SELECT ordinal, regexp_replace({_CODES}, '[\\s-]', '', 'g') AS n FROM offers), c AS (SELECT ordinal, CASE WHEN regexp_full_match(n, '[0-9]{{11}}') THEN '0' || n ELSE n END AS code FROM n)
SELECT ordinal, code, CASE WHEN regexp_full_match(code, '[0-9]{{12}}') THEN 'upc-a' WHEN regexp_full_match(code, '[0-9]{{13}}') THEN 'ean-13' WHEN regexp_full_match(code, '[0-9]{{14}}') THEN 'gtin-14' WHEN regexp_full_match(code, '(?i)[A-Z0-9-]{{4,30}}') THEN 'sku' ELSE 'unknown' END AS type,
 CASE WHEN regexp_full_match(code, '[0-9]{{12}}') THEN {sql.check('code', 12)} WHEN regexp_full_match(code, '[0-9]{{13}}') THEN {sql.check('code', 13)} WHEN regexp_full_match(code, '[0-9]{{14}}') THEN {sql.check('code', 14)} ELSE regexp_full_match(code, '(?i)[A-Z0-9-]{{4,30}}') END AS valid FROM c""")
def barcode_types(spark, sf_dir):
    upc, k = F.col("primaryUpc"), F.col("partkey") % 6
    code = F.when(k == 0, upc).when(k == 1, F.concat(F.lit("0"), upc)).when(k == 2, F.concat(F.substring(upc, 1, 3), F.lit("-"), F.substring(upc, 4, 8))).when(k == 3, F.concat(F.lit("SKU-"), F.col("partkey").cast("string"))).when(k == 4, F.lit("a")).otherwise(F.concat(F.lit("10"), upc))
    df = offers(spark, sf_dir).select("ordinal", barcodes.normal(code).alias("code")).withColumn("kind", barcodes.kind(F.col("code")))
    return df.select("ordinal", "code", F.col("kind.type").alias("type"), F.col("kind.isValid").alias("valid"))


@query(f"WITH {sql.OFFERS}, e AS (SELECT partkey, '0' || upc AS ean FROM offers GROUP BY partkey, upc) SELECT o.ordinal, e.partkey AS other FROM offers o JOIN e ON '0' || o.upc = e.ean")
def upc_to_ean_join(spark, sf_dir):
    df = offers(spark, sf_dir)
    other = df.select(F.col("partkey").alias("other"), F.concat(F.lit("0"), "primaryUpc").alias("ean")).distinct()
    return df.withColumn("ean", barcodes.as_ean(F.col("primaryUpc"))).join(other, "ean").select("ordinal", "other")


@query(r"SELECT doc_id, substr(trim(regexp_replace(regexp_replace(text, '[\s\x{00A0}]+', ' ', 'g'), '[^A-Za-z0-9_\s\-.,()]', '', 'g')), 1, 200) AS title FROM documents")
def clean_titles(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", parse.title(F.col("text")).alias("title"))


@query(f"SELECT page_id, {sql.domain('url')} AS domain, {sql.country('url')} AS country FROM pages")
def page_domains(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.domain(F.col("url")).alias("domain"), urls.country(F.col("url")).alias("country"))


@query(f"SELECT {sql.country('url')} AS country, count(*) AS n, count(DISTINCT {sql.domain('url')}) AS domains FROM pages GROUP BY 1")
def domain_counts(spark, sf_dir):
    df = table(spark, sf_dir, "pages").select(urls.country(F.col("url")).alias("country"), urls.domain(F.col("url")).alias("domain"))
    return df.groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("domain").alias("domains"))


_URLS = "'https://' || ['www.amazon.com', 'iherb.com', 'shop.slickdeals.net', 'screwfix.com', 'notiherb.com', 'reddit.com', 'apotea.se', 'www.examine.com', 'renogy.com', 'www.energysage.com'][event_id % 10 + 1] || ['/dp/', '/blog/', '/x?sku=', '/item/'][event_id % 4 + 1] || event_id % 50"


def _event_urls(spark, sf_dir):
    pick = lambda values, n: F.element_at(F.array(*(F.lit(v) for v in values)), (F.col("event_id") % n + 1).cast("int"))
    hosts = ["www.amazon.com", "iherb.com", "shop.slickdeals.net", "screwfix.com", "notiherb.com", "reddit.com", "apotea.se", "www.examine.com", "renogy.com", "www.energysage.com"]
    url = F.concat(F.lit("https://"), pick(hosts, 10), pick(["/dp/", "/blog/", "/x?sku=", "/item/"], 4), (F.col("event_id") % 50).cast("string"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("ordinal"), url.alias("url"))


@query(f"WITH u AS (SELECT event_id AS ordinal, {_URLS} AS url FROM events) SELECT ordinal, url FROM u WHERE len(list_filter({sql._list(fixed.EXCLUDED + fixed.EXCLUDED_BY_CATEGORY['supplements'])}, lambda x: contains({sql.domain('url')}, x))) = 0")
def excluded_domain_antijoin(spark, sf_dir):
    return frontier.fetchable(_event_urls(spark, sf_dir), "supplements")


@query(f"WITH u AS (SELECT event_id AS ordinal, {_URLS} AS url FROM events) SELECT url, min(ordinal) AS ordinal FROM u GROUP BY url")
def url_first_seen(spark, sf_dir):
    return frontier.first_seen(_event_urls(spark, sf_dir))


@query(
    f"WITH u AS (SELECT event_id AS ordinal, {_URLS} AS url FROM events) SELECT ordinal,"
    f" {sql.tier('url', fixed.VENDORS['supplements'], fixed.DEAL_SITES['supplements'])} AS tier,"
    f" {sql.tier('url', fixed.SOLAR_VENDORS, fixed.SOLAR_DEAL_SITES, 'solar|panel|watt')} AS solar_tier FROM u"
)
def url_tiers(spark, sf_dir):
    return frontier.both_tiers(_event_urls(spark, sf_dir), "supplements").select("ordinal", "tier", "solar_tier")


@query(f"WITH u AS (SELECT url, min(event_id) AS ordinal FROM (SELECT event_id, {_URLS} AS url FROM events) GROUP BY url) SELECT url, ordinal, {sql.tier('url', fixed.VENDORS['supplements'], fixed.DEAL_SITES['supplements'])} AS tier FROM u WHERE len(list_filter({sql._list(fixed.EXCLUDED + fixed.EXCLUDED_BY_CATEGORY['supplements'])}, lambda x: contains({sql.domain('url')}, x))) = 0 ORDER BY tier, ordinal LIMIT 30")
def urls_to_fetch(spark, sf_dir):
    return frontier.to_fetch(_event_urls(spark, sf_dir), "supplements", "quick")


@query(f"WITH u AS (SELECT url, min(event_id) AS ordinal FROM (SELECT event_id, {_URLS} AS url FROM events) GROUP BY url) SELECT url, ordinal FROM u WHERE NOT {sql.within(sql.domain('url'), fixed.SOLAR_EXCLUDED)} AND NOT regexp_matches(url, '(?i){'|'.join(fixed.BLOG_PATHS)}')")
def solar_url_filter(spark, sf_dir):
    return frontier.solar_fetchable(_event_urls(spark, sf_dir))


@query(f"WITH u AS (SELECT event_id AS ordinal, {_URLS} AS url FROM events) SELECT CASE WHEN {sql.within(sql.host('url'), fixed.BROWSER_DOMAINS)} THEN 'render' ELSE 'fetch' END AS route, count(*) AS n FROM u GROUP BY 1")
def fetch_routes(spark, sf_dir):
    return frontier.routed(_event_urls(spark, sf_dir)).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH u AS (SELECT event_id AS ordinal, {_URLS} AS url FROM events), c AS (SELECT DISTINCT url || CASE WHEN url LIKE '%7' THEN '' ELSE '#old' END AS url FROM u) SELECT ordinal, url FROM u WHERE url NOT IN (SELECT url FROM c)")
def uncached_urls(spark, sf_dir):
    """The cache holds all urls, those that don't end in 7 by names that they no longer have."""
    df = _event_urls(spark, sf_dir)
    held = df.select(F.concat("url", F.when(F.col("url").endswith("7"), "").otherwise("#old")).alias("url")).distinct()
    return frontier.uncached(df, held).select("ordinal", "url")


@query("WITH t AS (SELECT page_id, lower(html || CASE page_id % 4 WHEN 0 THEN '<p>reCAPTCHA</p>' WHEN 1 THEN 'Access Denied: are you a robot' ELSE '' END) AS t FROM pages) SELECT page_id, len(list_filter(" + sql._list(fixed.BLOCK_SIGNALS) + ", lambda x: contains(t, x))) >= 2 AS blocked FROM t")
def blocked_pages(spark, sf_dir):
    k = F.col("page_id") % 4
    html = F.concat("html", F.when(k == 0, "<p>reCAPTCHA</p>").when(k == 1, "Access Denied: are you a robot").otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", urls.blocked(html).alias("blocked"))


_KEY = r"array_to_string(list_sort(list_filter(regexp_split_to_array(regexp_replace(lower(query), '[^a-z0-9_\s]', '', 'g'), '\s+'), lambda w: length(w) > 2)), ' ')"


@query(f"WITH q AS (SELECT doc_id AS ordinal, text AS query FROM documents) SELECT ordinal, query FROM q QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY ordinal) = 1")
def query_dedupe(spark, sf_dir):
    return frontier.distinct_queries(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ordinal"), F.col("text").alias("query")))


@query(
    f"WITH t AS (SELECT unnest({sql._list(sql.SUPPLEMENT_QUERIES)}) AS t, unnest(range(0, {len(sql.SUPPLEMENT_QUERIES)})) AS ordinal)"
    " SELECT p_partkey, CAST(ordinal AS INT) AS ordinal, replace(t, '{}', trim(p_name)) AS query FROM part, t"
)
def query_generation(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("product"))
    return frontier.expand(parts, frontier.category_templates("supplements", ["US", "UK", "DE"])).drop("product")


def _panel_queries(country: str) -> str:
    texts = sql.PANEL_QUERIES[:12] + sql.MORE_PANEL_QUERIES[country] + sql.PANEL_QUERIES[12:]
    return f"SELECT '{country}' AS country, unnest({sql._list(texts)}) AS query, unnest(range(0, {len(texts)})) AS ordinal"


@query(
    f"WITH t AS ({' UNION ALL '.join(_panel_queries(c) for c in ('US', 'UK', 'DE', 'AU'))})"
    " SELECT n_nationkey, CAST(ordinal AS INT) AS ordinal, query FROM nation JOIN t ON country = ['US', 'UK', 'DE', 'AU'][n_nationkey % 4 + 1]"
)
def country_query_cross(spark, sf_dir):
    df = table(spark, sf_dir, "nation").select("n_nationkey", F.element_at(F.array(*(F.lit(c) for c in ("US", "UK", "DE", "AU"))), F.col("n_nationkey") % 4 + 1).alias("country"))
    return frontier.country_queries(df).drop("country")


@query("WITH e(engine, tier) AS (VALUES " + ", ".join(f"('{n}', {t})" for n, (t, _) in fixed.ENGINES.items()) + "), q AS (SELECT n_nationkey AS ordinal FROM nation) SELECT ordinal, engine, tier FROM q, e WHERE engine <> 'Bing' AND CASE WHEN ordinal < 2 THEN tier = 1 OR engine IN ('Qwant', 'Ecosia', 'Mojeek', 'Yandex') WHEN ordinal < 4 THEN tier <= 2 ELSE true END")
def query_engine_pairs(spark, sf_dir):
    df = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ordinal"))
    return frontier.query_engines(df, ["DE"], limited=["Bing"]).select("ordinal", "engine", "tier")


_LEADER = """picked AS (SELECT * FROM panels WHERE "pricePerWattUsd" BETWEEN 0.10 AND 3.0 AND confidence >= 0.4 QUALIFY row_number() OVER (PARTITION BY url ORDER BY ordinal) = 1),
 leaders AS (SELECT * FROM picked QUALIFY row_number() OVER (PARTITION BY vendor, floor("pricePerWattUsd" * 20 + 0.5) ORDER BY ordinal) = 1)"""
_PANEL = 'ordinal, url, wattage, "pricePerWatt", "pricePerWattUsd"'


def _leaders(spark, sf_dir):
    return leaderboard.filtered(leaderboard.priced_per_watt(panels(spark, sf_dir)))


@query(f'WITH {sql.PANELS}, {_LEADER} SELECT {_PANEL} FROM leaders ORDER BY "pricePerWattUsd", ordinal LIMIT 1000')
def leaderboard_top(spark, sf_dir):
    return leaderboard.top_panels(leaderboard.priced_per_watt(panels(spark, sf_dir))).select("ordinal", "url", "wattage", "pricePerWatt", "pricePerWattUsd")


_BUILT = f"""b AS (SELECT ordinal, title, vendor, url, wattage, upper(currency) AS currency, country, {sql.js("price / wattage", 3)} AS "pricePerWatt", {sql.js("price * " + sql._case(fixed.BUILDER_RATES, "currency", "1.0::DOUBLE"), 2)} AS "priceUsd" FROM raw_panels WHERE wattage BETWEEN 10 AND 1000 AND price > 0),
 built AS (SELECT *, {sql.js('"priceUsd" / wattage', 3)} AS "pricePerWattUsd" FROM b WHERE "pricePerWatt" BETWEEN 0.10 AND 3.0 QUALIFY row_number() OVER (PARTITION BY url ORDER BY ordinal) = 1)"""


@query(f'WITH {sql.PANELS}, {_BUILT} SELECT ordinal, url, "priceUsd", "pricePerWatt", "pricePerWattUsd" FROM built')
def leaderboard_builder(spark, sf_dir):
    return leaderboard.build(panels(spark, sf_dir), tasks(spark, sf_dir)).select("ordinal", "url", "priceUsd", "pricePerWatt", "pricePerWattUsd")


@query(f"WITH {sql.PANELS}, {_BUILT} SELECT count(*) AS \"totalAfterFiltering\", array_to_string(list_sort(list(DISTINCT country)), ',') AS \"countriesCrawled\", 3 AS version FROM built")
def leaderboard_metadata(spark, sf_dir):
    return leaderboard.metadata(leaderboard.build(panels(spark, sf_dir), tasks(spark, sf_dir), ordered=False), 0).select("totalAfterFiltering", F.array_join("countriesCrawled", ",").alias("countriesCrawled"), "version")


@query(f"""WITH {sql.PANELS}, {_LEADER} SELECT {_PANEL} FROM leaders WHERE country IN ('US', 'DE') AND coalesce(wattage, 0) >= 100 AND coalesce(wattage, 0) <= 800 AND lower("panelType") = 'bifacial'""")
def leaderboard_facets(spark, sf_dir):
    return leaderboard.facets(_leaders(spark, sf_dir), ["us", " DE"], 100, 800, "Bifacial").select("ordinal", "url", "wattage", "pricePerWatt", "pricePerWattUsd")


@query(f"WITH {sql.PANELS}, {_LEADER} SELECT ordinal, efficiency FROM leaders ORDER BY efficiency ASC NULLS LAST, ordinal LIMIT 40 OFFSET 20")
def leaderboard_page(spark, sf_dir):
    return leaderboard.page(leaderboard.sorted_by(_leaders(spark, sf_dir), "efficiency"), 40, 20).select("ordinal", "efficiency")


@query(f"WITH {sql.PANELS}, {_LEADER} SELECT ordinal, efficiency FROM leaders ORDER BY coalesce(efficiency, 0) DESC, ordinal LIMIT 50")
def leaderboard_display_sort(spark, sf_dir):
    return leaderboard.page(leaderboard.sorted_by(_leaders(spark, sf_dir), "efficiency", display=True)).select("ordinal", "efficiency")


@query(f'WITH {sql.PANELS}, {_LEADER} SELECT count(*) AS total, 50 AS "limit", 100 AS "offset", 150 < count(*) AS "hasMore", CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages FROM leaders')
def leaderboard_page_info(spark, sf_dir):
    return leaderboard.page_info(_leaders(spark, sf_dir), 50, 100)


@query(f'WITH {sql.PANELS}, {_LEADER} SELECT ordinal, row_number() OVER (ORDER BY "pricePerWattUsd", ordinal) + 50 AS rank FROM leaders ORDER BY "pricePerWattUsd", ordinal LIMIT 50')
def display_ranks(spark, sf_dir):
    df = _leaders(spark, sf_dir).orderBy("pricePerWattUsd", "ordinal").limit(50)
    return leaderboard.display_rank(df, F.asc("pricePerWattUsd"), F.asc("ordinal"), start=50).select("ordinal", F.col("rank").cast("long").alias("rank"))


def _stocked(spark, sf_dir):
    pick = F.element_at(F.array(*(F.lit(v) for v in ("in_stock", "out-of-stock", "unknown", "in-stock", ""))), (F.col("event_id") % 5 + 1).cast("int"))
    statuses = table(spark, sf_dir, "events").select((F.col("user_id") % 500).cast("string").alias("url"), pick.alias("status"), F.col("event_id").alias("ordinal"))
    df = panels(spark, sf_dir).select("ordinal", F.floor(F.col("ordinal") / 1000000).cast("string").alias("url"))
    return leaderboard.with_stock(df, statuses)


_STOCKED = "CASE WHEN status IN ('in-stock', 'in_stock') THEN 'in-stock' WHEN status IN ('out-of-stock', 'out_of_stock') THEN 'out-of-stock' ELSE 'unknown' END AS \"stockStatus\""


@query(f"WITH {sql.OFFERS}, {sql.STOCK} SELECT ordinal, {_STOCKED} FROM offers LEFT JOIN stock USING (partkey)")
def stock_join(spark, sf_dir):
    return _stocked(spark, sf_dir).select("ordinal", "stockStatus")


@query(f"WITH {sql.OFFERS}, {sql.STOCK} SELECT {_STOCKED}, count(*) AS n FROM offers LEFT JOIN stock USING (partkey) GROUP BY 1")
def stock_histogram(spark, sf_dir):
    return leaderboard.stock_counts(_stocked(spark, sf_dir))


@query(f"WITH {sql.OFFERS}, s AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority LIKE '1%') SELECT ordinal, partkey IN (SELECT k FROM s) AS saved FROM offers")
def saved_flags(spark, sf_dir):
    """Offers for parts whose numbers are those of customers with an order of the first priority are taken as saved."""
    from ..operators.display import flagged

    saved = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("partkey"))
    return flagged(offers(spark, sf_dir), saved, "partkey").select("ordinal", "saved")


@query(f"WITH {sql.OFFERS}, s AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority LIKE '1%') SELECT ordinal FROM offers WHERE partkey NOT IN (SELECT k FROM s)")
def saved_removed(spark, sf_dir):
    saved = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("partkey"))
    return offers(spark, sf_dir).join(saved, "partkey", "left_anti").select("ordinal")


@query(f"WITH {sql.OFFERS} SELECT ordinal, price, CAST(NULL AS VARCHAR) AS vendor, CAST(NULL AS VARCHAR) AS source FROM offers WHERE partkey % 3 = 0 UNION ALL SELECT ordinal, price, vendor, NULL FROM offers WHERE partkey % 3 = 1 UNION ALL SELECT ordinal, NULL, NULL, vendor FROM offers WHERE partkey % 3 = 2")
def heterogeneous_union(spark, sf_dir):
    df = offers(spark, sf_dir)
    a, b, c = (df.filter(f"partkey % 3 = {i}") for i in range(3))
    return a.select("ordinal", "price").unionByName(b.select("ordinal", "price", "vendor"), True).unionByName(c.select("ordinal", F.col("vendor").alias("source")), True)


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.from_json("props", "k long")["k"].alias("k")).agg(F.count(F.lit(1)).alias("n"))


_MADE = "list_filter(f.made, lambda x: e.at - x < 36000000)"


@query(f"""WITH RECURSIVE e AS (SELECT event_id, epoch_us(ts) // 1000 AS at, row_number() OVER (ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS recent, CAST([] AS BIGINT[]) AS made
 UNION ALL SELECT e.i, e.event_id, CAST(len({_MADE}) AS BIGINT), CASE WHEN len({_MADE}) < 60 THEN list_append({_MADE}, e.at) ELSE {_MADE} END FROM f JOIN e ON e.i = f.i + 1)
SELECT event_id, recent, recent < 60 AS allowed FROM f WHERE i > 0""")
def request_budget(spark, sf_dir):
    """Only requests that are made count, so the first denials don't last."""
    return limits.budgeted(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", "event_id", ms=36_000_000).select("event_id", "recent", "allowed")


@query()
def engine_budget(spark, sf_dir):
    """The same with engines, which are denied once two thirds of more than five requests failed; tested against plain Python."""
    df = table(spark, sf_dir, "events").select("event_id", "ts", (F.col("user_id") % 12).alias("engine"), (F.col("event_type") != "click").alias("failed"))
    return limits.budgeted(df, "ts", "event_id", ms=36_000_000, engine="engine", failed="failed").select("event_id", "recent", "allowed")


@query("""WITH RECURSIVE o AS (SELECT user_id, epoch_us(ts) // 1000 AS at_ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events),
f AS (SELECT user_id, at_ms, nth, at_ms AS was_set, false AS hit FROM o WHERE nth = 1
 UNION ALL SELECT o.user_id, o.at_ms, o.nth, CASE WHEN o.at_ms - f.was_set <= 86400000 THEN f.was_set ELSE o.at_ms END, o.at_ms - f.was_set <= 86400000 FROM f JOIN o ON o.user_id = f.user_id AND o.nth = f.nth + 1)
SELECT user_id, at_ms, hit FROM f""")
def cache_day_hits(spark, sf_dir):
    """A day's time to live: an entry is set by a miss and does not live longer for its hits."""
    return limits.cache_hits(table(spark, sf_dir, "events"), "user_id", "ts", 86_400_000).select("user_id", F.col("at").alias("at_ms"), "hit")


@query("""WITH c AS (SELECT user_id % 12 AS engine, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type <> 'error') AS succeeded FROM events GROUP BY 1)
SELECT engine, failed > 3 AND failed > 2 * succeeded AS blocked FROM c""")
def proxy_blocked_engines(spark, sf_dir):
    df = limits.engine_stats(table(spark, sf_dir, "events").withColumn("engine", F.col("user_id") % 12), "engine", F.col("event_type") == "error")
    return df.select("engine", limits.proxy_blocked(F.col("succeeded"), F.col("failed")).alias("blocked"))


@query("""WITH f AS (SELECT *, event_type = 'error' AS failed FROM events), i AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM f),
r AS (SELECT *, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS run FROM i),
c AS (SELECT *, CAST(CASE WHEN run > 0 THEN least(30000 * pow(2, run - 1), 600000) ELSE 0 END AS BIGINT) AS cooldown_ms FROM r)
SELECT event_id, CAST(run AS BIGINT) AS run, cooldown_ms, max(CASE WHEN run > 0 THEN epoch_us(ts) // 1000 + cooldown_ms END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until_ms FROM c""")
def failure_runs_cooldown(spark, sf_dir):
    return limits.failure_runs(table(spark, sf_dir, "events"), "user_id", F.col("event_type") == "error", "ts", "event_id", at="ts").select("event_id", "run", "cooldown_ms", "until_ms")


@query("""WITH n AS (SELECT event_id, user_id % 20 AS domain, event_type = 'error' AS failed, (row_number() OVER (ORDER BY ts, event_id) - 1) // 8 AS chunk FROM events)
SELECT event_id, CAST(chunk AS BIGINT) AS chunk, coalesce(bool_or(failed) OVER (PARTITION BY domain ORDER BY chunk RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS skipped FROM n""")
def domain_circuit_breaker(spark, sf_dir):
    df = limits.numbered(table(spark, sf_dir, "events").withColumn("domain", F.col("user_id") % 20), F.asc("ts"), F.asc("event_id"), by=F.date_trunc("hour", "ts"))
    return limits.circuit_breaker(df, "domain", F.col("event_type") == "error", "ordinal").select("event_id", "chunk", "skipped")


@query("SELECT user_id % 12 AS engine, count(*) AS requests, CAST(count(*) FILTER (event_type <> 'error') AS BIGINT) AS succeeded, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS failed, max(ts) AS last_request, NOT (count(*) FILTER (event_type = 'error') > 2 * count(*) FILTER (event_type <> 'error') AND count(*) > 5) AS healthy FROM events GROUP BY 1")
def engine_stats(spark, sf_dir):
    return limits.engine_stats(table(spark, sf_dir, "events").withColumn("engine", F.col("user_id") % 12), "engine", F.col("event_type") == "error")


@query("WITH n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS nth FROM events) SELECT user_id, floor(sum(value * pow(0.5, nth)) * 10000 + 0.5) / 10000 AS mean FROM n GROUP BY user_id")
def engine_moving_mean(spark, sf_dir):
    return limits.moving_mean(table(spark, sf_dir, "events"), "user_id", "event_id", "value").select("user_id", half_up(F.col("mean"), 4).alias("mean"))


@query(f"""WITH {sql.OFFERS} SELECT ordinal, CASE currency WHEN 'USD' THEN '$' WHEN 'EUR' THEN '€' WHEN 'GBP' THEN '£' WHEN 'JPY' THEN '¥' WHEN 'CAD' THEN 'C$' ELSE currency || ' ' END || printf('%.2f', {sql.js('price', 2)}) AS price_text,
 CASE WHEN price / 100000 < 0.01 THEN printf('%.4f', {sql.js('price / 100000', 4)}) ELSE printf('%.2f', {sql.js('price / 100000', 2)}) END || '/' || unit AS unit_text, CAST(quantity AS BIGINT) || ' ' || unit AS quantity_text,
 CASE WHEN length(title) <= 20 THEN title ELSE substr(title, 1, 17) || '...' END AS short, CASE WHEN cents < 1000 THEN cents || 'ms' WHEN cents < 60000 THEN (cents // 1000) || 's' ELSE (cents // 60000) || 'm ' || (cents // 1000 % 60) || 's' END AS elapsed FROM offers""")
def format_strings(spark, sf_dir):
    cents = F.col("cents")
    return offers(spark, sf_dir).select(
        "ordinal", formats.currency(F.col("price"), F.col("currency")).alias("price_text"), formats.price_per_unit(F.col("price") / 100000, F.col("unit")).alias("unit_text"),
        formats.quantity(F.col("quantity"), F.col("unit")).alias("quantity_text"), formats.truncated(F.col("title"), 20).alias("short"), formats.elapsed(cents).alias("elapsed"),
    )


@query(f"WITH {sql.OFFERS} SELECT ordinal, TRY_CAST(nullif(regexp_extract(cents || 'px', '^\\s*([+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?)', 1), '') AS DOUBLE) AS number, CAST(cents AS BIGINT) AS whole, floor(price * 10 + 0.5) / 10 AS rounded FROM offers")
def numeric_prefixes(spark, sf_dir):
    text = F.concat(F.col("cents").cast("string"), F.lit("px"))
    return offers(spark, sf_dir).select("ordinal", prefix_number(text).alias("number"), prefix_integer(text).alias("whole"), half_up(F.col("price"), 1).alias("rounded"))


_H1 = r"regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"
_UNESCAPED = f"regexp_replace(regexp_replace({_H1}, '&quot;?', '\"', 'g'), '&amp;?', '&', 'g')"


def _clean(x: str) -> str:
    return rf"substr(trim(regexp_replace(regexp_replace({x}, '[\s\x{{00A0}}]+', ' ', 'g'), '[^A-Za-z0-9_\s\-.,()]', '', 'g')), 1, 200)"


@query(f"SELECT page_id, {_clean(_UNESCAPED)} AS title FROM pages WHERE {_clean(_UNESCAPED)} <> ''")
def page_titles(spark, sf_dir):
    """Titles by the page's own heading; pages without one have none."""
    from ..operators.extract import title
    from ..sources.html import page_facts

    found = page_facts(table(spark, sf_dir, "pages"))
    return found.select("page_id", title(found).alias("title")).filter("title IS NOT NULL")


def _product_pages(spark, sf_dir):
    """Pages with what a shop adds: a price that is now and then reduced, a size, a code, shipping and a coupon."""
    n = F.col("page_id")
    c = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    size = F.element_at(F.array(*(F.lit(v) for v in ("500g", "2 lb", "60 capsules"))), (n % 3 + 1).cast("int"))
    add = c("<title>Powder number ", n, " of ", size, "</title><b class='now-price'>$", n % 90 + 10, ".50</b><i class='was-price'>$", n % 90 + n % 20 + 10, ".50</i><s class='shipping-cost'>$4.99</s><u class='coupon'>SAVE", n % 10 + 10, " for 10% off</u><p>UPC: 012345678905")
    return table(spark, sf_dir, "pages").select("page_id", "url", F.concat(F.lit("<html><body>"), add, F.lit("</body></html>")).alias("html"))


@query("""SELECT page_id, 'Powder number ' || page_id || ' of ' || ['500g', '2 lb', '60 capsules'][page_id % 3 + 1] AS title, page_id % 90 + 10.5::DOUBLE AS price, ['500', '2', '60'][page_id % 3 + 1]::DOUBLE AS quantity,
 ['g', 'lb', 'capsules'][page_id % 3 + 1] AS unit, CASE WHEN page_id % 20 > 0 THEN page_id % 90 + page_id % 20 + 10.5::DOUBLE END AS original, CASE WHEN page_id % 20 > 0 THEN CAST(floor(page_id % 20 / (page_id % 90 + page_id % 20 + 10.5::DOUBLE) * 100 + 0.5) AS BIGINT) END AS discount,
 '012345678905' AS upc, 4.99::DOUBLE AS shipping, 'SAVE' || (page_id % 10 + 10) AS coupon FROM pages""")
def product_extraction(spark, sf_dir):
    from ..operators.extract import product_records

    df = product_records(_product_pages(spark, sf_dir))
    return df.select("page_id", "title", "price", "quantity", "unit", F.col("original_price").alias("original"), F.col("discount_percent").alias("discount"), F.col("primaryUpc").alias("upc"), F.col("shipping.cost").alias("shipping"), F.col("promotion.couponCode").alias("coupon"))


@query("""SELECT page_id, page_id % 300 + 50.0::DOUBLE AS price, CAST(page_id % 400 + 20 AS BIGINT) AS wattage, 'bifacial' AS kind, 21.5::DOUBLE AS efficiency, 'Renogy' AS brand, floor((page_id % 300 + 50.0) / (page_id % 400 + 20) * 1000 + 0.5) / 1000 AS per_watt, 0.85::DOUBLE AS confidence FROM pages""")
def panel_extraction(spark, sf_dir):
    from ..operators.extract import panel_records

    n = F.col("page_id")
    c = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    html = c("<title>Renogy ", n % 400 + 20, "W Bifacial</title><script type='application/ld+json'>{\"@type\": \"Product\", \"offers\": {\"price\": \"", n % 300 + 50, "\"}}</script><body><table><tr><td>Efficiency: 21.5%</table>Add to cart")
    df = panel_records(table(spark, sf_dir, "pages").select("page_id", "url", html.alias("html")))
    return df.select("page_id", "price", "wattage", F.col("specs.panelType").alias("kind"), F.col("specs.efficiency").alias("efficiency"), F.col("specs.brand").alias("brand"), F.col("pricePerWatt").alias("per_watt"), half_up(F.col("confidence"), 3).alias("confidence"))


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Google' WHEN 1 THEN 'Yahoo' ELSE 'Mojeek' END AS engine, CAST(i AS BIGINT) AS ordinal, url || '/' || i AS url FROM pages, (SELECT unnest([0, 1, 2]) AS i)""")
def result_links(spark, sf_dir):
    """Result pages whose links lead to the urls of all pages, with query and fragment, and the links found on them."""
    from ..operators.extract import links

    k, items = F.col("page_id") % 3, []
    for i in range(3):
        u = F.concat("url", F.lit(f"/{i}"))
        items.append(F.when(k == 0, F.concat(F.lit("<a href='/url?q="), urls.encoded(u), F.lit("&sa=1'>x</a>"))).when(k == 1, F.concat(F.lit("<a href='https://r.example/RU="), urls.encoded(u), F.lit("/RK=2'>x</a>"))).otherwise(F.concat(F.lit("<a class=title href='"), u, F.lit("'>x</a><a href='https://www.mojeek.com/about'>y</a>"))))
    engine = F.when(k == 0, "Google").when(k == 1, "Yahoo").otherwise("Mojeek")
    return links(table(spark, sf_dir, "pages").select("page_id", engine.alias("engine"), F.concat(*items).alias("html"))).select("page_id", "engine", "ordinal", "url")


@query("""SELECT page_id, CAST(i AS BIGINT) AS ordinal, 'Panel mono ' || (page_id % 300 + i) || 'W' AS title, page_id % 900 + 100.25::DOUBLE AS price, 'EUR' AS currency, CAST(page_id % 300 + i AS BIGINT) AS wattage, 'https://shop.example/product/' || page_id || '-' || i AS url FROM pages, (SELECT unnest([0, 1]) AS i)""")
def listing_cards(spark, sf_dir):
    from ..operators.extract import cards

    n = F.col("page_id")
    c = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    items = [c("<li class='product'><h3>Panel mono ", n % 300 + i, "W</h3><span class='price'>€", n % 900 + 100, ".25</span><a href='/product/", n, f"-{i}'>go</a></li>") for i in range(2)]
    df = table(spark, sf_dir, "pages").select("page_id", F.lit("https://shop.example/list").alias("url"), F.concat(*items).alias("html"))
    return cards(df).select("page_id", "ordinal", "title", "price", "currency", "wattage", "url")


def _stream(spark, sf_dir, make, mode="append"):
    """What a stream gives: appended rows go to a Parquet table, exactly once; a complete small result is a table in memory."""
    import tempfile
    import uuid

    from ..streaming import state

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    name = f"stream_{uuid.uuid4().hex}"
    folder = f"{(base or tempfile.mkdtemp()).rstrip('/')}/{name}"
    df = make(state.event_stream(spark, sf_dir))
    if mode != "append":
        return state.run_now(df, name, folder, mode)
    state.run_to(df, f"{folder}-rows", folder)
    return spark.read.schema(df.schema).parquet(f"{folder}-rows")


@query("SELECT event_type, count(*) AS n, floor(sum(value) * 100 + 0.5) / 100 AS total FROM events GROUP BY event_type")
def stream_event_counts(spark, sf_dir):
    count = lambda e: e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), half_up(F.sum("value"), 2).alias("total"))
    return _stream(spark, sf_dir, count, "complete")


@query("WITH w AS (SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT start, event_type, n FROM w WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def stream_tumbling(spark, sf_dir):
    from ..streaming import state

    return _stream(spark, sf_dir, state.tumbling).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT DISTINCT user_id FROM events")
def stream_distinct_users(spark, sf_dir):
    """A time to live as long as the table: each user is fresh once."""
    from ..streaming import state

    return _stream(spark, sf_dir, lambda e: state.fresh(e, ["user_id"], "36500 days").select("user_id"))


@query("SELECT event_type AS event, '{\"id\":' || event_id || '}' AS data, event_id FROM events")
def event_text_round_trip(spark, sf_dir):
    from ..sources.documents import event_text, parsed_events

    df = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("event"), F.to_json(F.struct(F.col("event_id").alias("id"))).alias("data"))
    texts = event_text(df.withColumn("data", F.col("data"))).withColumn("_", F.lit(0)).drop("_")
    return parsed_events(texts).select("event", "data", F.from_json("data", "id long")["id"].alias("event_id"))


@query(f"WITH {sql.OFFERS} SELECT ordinal, array_to_string(list_filter([CASE WHEN valid_upc THEN 'UPC' END, CASE WHEN discount_percent > 5 THEN discount_percent || '% off' END, CASE WHEN coupon THEN 'coupon' END, CASE WHEN free_shipping THEN 'free shipping' END], lambda x: x IS NOT NULL), ', ') AS badges FROM offers")
def offer_badges(spark, sf_dir):
    b = formats.badges(F.col("valid_upc"), F.lit(0), F.col("discount_percent"), F.lit(None).cast("double"), F.col("coupon"), F.col("free_shipping"))
    return _coded(spark, sf_dir).select("ordinal", F.array_join(b, ", ").alias("badges"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 40 + event_id % 10 / 10::DOUBLE * 40 WHEN 'view' THEN CASE event_id % 10 WHEN 0 THEN 10 ELSE 5 + event_id % 10 / 10::DOUBLE * 35 END WHEN 'error' THEN 85 ELSE 100 END::DOUBLE AS percent FROM events""")
def progress_percent(spark, sf_dir):
    kind = F.col("event_type")
    stage = F.when(kind == "click", "crawling").when(kind == "view", "searching").when(kind == "error", "extracting").otherwise("complete")
    return table(spark, sf_dir, "events").select("event_id", formats.progress(stage, F.col("event_id") % 10, F.lit(10)).alias("percent"))


@query(f"WITH {sql.OFFERS}, h AS (SELECT partkey, CAST(epoch_us(ts) // 1000 AS BIGINT) AS at_ms FROM (SELECT user_id AS partkey, ts FROM events)), o AS (SELECT partkey AS user_id, at_ms, row_number() OVER (PARTITION BY partkey ORDER BY at_ms) AS nth FROM h) SELECT user_id, at_ms, nth > 1 AS hit FROM o")
def cache_first_misses(spark, sf_dir):
    """With a time to live beyond all events only the first request of a key misses."""
    return limits.cache_hits(table(spark, sf_dir, "events"), "user_id", "ts", 10**15).select("user_id", F.col("at").alias("at_ms"), "hit")


@query(
    "SELECT url, bool_or(page_id % 3 = 0) AS held, CASE WHEN bool_or(page_id % 3 = 0) THEN octet_length(encode(min(html) FILTER (page_id % 3 = 0)))"
    " ELSE octet_length(encode(min(html))) END AS size FROM pages GROUP BY url"
)
def read_through_pages(spark, sf_dir):
    """The cache holds all pages twice, two of three by urls that they no longer have; those are read as they were fetched. All are asked for twice."""
    pages = table(spark, sf_dir, "pages")
    pages = pages.unionByName(pages)
    held = pages.select(F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.concat("url", F.lit("#old"))).alias("url"), "html")
    found = frontier.read_through(pages, held, pages)
    return found.select("url", (F.col("source") == "cache").alias("held"), F.octet_length("html").cast("long").alias("size"))


@query(
    "SELECT url, CASE WHEN bool_or(page_id % 4 = 0) THEN 'render' ELSE 'fetch' END AS source FROM pages GROUP BY url"
    " UNION ALL SELECT DISTINCT url || '#late', 'render' FROM pages WHERE page_id % 4 > 0"
)
def fetched_and_rendered(spark, sf_dir):
    """All pages are fetched and rendered, three of four by urls that no fetch has."""
    pages = table(spark, sf_dir, "pages")
    rendered = pages.select(F.when(F.col("page_id") % 4 == 0, F.col("url")).otherwise(F.concat("url", F.lit("#late"))).alias("url"), "html")
    return frontier.one_of_both(pages.unionByName(pages), rendered.unionByName(rendered)).select("url", "source")


@query("""SELECT page_id, CAST(i AS BIGINT) AS ordinal, 'https://' || CASE WHEN page_id % 3 = 0 THEN 'json' ELSE 'html' END || '.example/' || page_id || '/' || i AS url FROM pages, (SELECT unnest(range(70)) AS i) WHERE i < CASE WHEN page_id % 3 = 0 THEN 50 ELSE 2 END""")
def json_first_links(spark, sf_dir):
    """Results with a body of 70 JSON links, an empty one or none, and with markup; 50 links are kept of each."""
    from ..operators.extract import either_links

    k = F.col("page_id")
    body = F.to_json(F.struct(F.transform(F.sequence(F.lit(0), F.lit(69)), lambda i: F.struct(F.concat(F.lit("https://json.example/"), k, F.lit("/"), i).alias("url"))).alias("results")))
    html = F.concat(*(F.concat(F.lit("<a class=title href='https://html.example/"), k, F.lit(f"/{i}'>x</a>")) for i in range(2)))
    df = table(spark, sf_dir, "pages").select("page_id", F.lit("Mojeek").alias("engine"), F.when(k % 3 == 0, body).when(k % 3 == 1, F.lit('{"results": []}')).alias("body"), html.alias("html"))
    return either_links(df).select("page_id", "ordinal", "url")


@query(f"WITH {sql.OFFERS} SELECT ordinal, false AS added FROM offers UNION ALL SELECT ordinal, true FROM offers WHERE partkey % 3 > 0")
def saved_inserted(spark, sf_dir):
    """All offers are saved; of as many that come later, those whose url isn't saved yet are added."""
    from ..sources.documents import insert_absent

    df = offers(spark, sf_dir).withColumn("added", F.lit(False))
    later = df.withColumn("added", F.lit(True)).withColumn("url", F.when(F.col("partkey") % 3 > 0, F.concat("url", F.lit("#new"))).otherwise(F.col("url")))
    return insert_absent(df, later).select("ordinal", "added")


@query(f"WITH {sql.OFFERS} SELECT ordinal FROM offers WHERE ordinal <> (SELECT min(ordinal) FROM offers)")
def saved_without_one(spark, sf_dir):
    from ..sources.documents import removed

    df = offers(spark, sf_dir).withColumn("url", F.col("ordinal").cast("string"))
    return removed(df, str(df.agg(F.min("ordinal")).first()[0])).select("ordinal")


@query("SELECT p_partkey, lower(trim('  ' || p_name || ' ')) || ':supplements:' || CASE WHEN p_partkey % 2 = 0 THEN 'DE,US' ELSE 'UK' END || ':quick' AS cache_key FROM part")
def search_cache_keys(spark, sf_dir):
    from ..streaming.state import cache_key

    countries = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("US"), F.lit("DE"))).otherwise(F.array(F.lit("UK")))
    return table(spark, sf_dir, "part").select("p_partkey", cache_key(F.concat(F.lit("  "), "p_name", F.lit(" ")), F.lit("supplements"), countries, F.lit("quick")).alias("cache_key"))


@query("""WITH p AS (SELECT p_partkey, p_size * 12 AS wattage, p_retailprice / 4 AS price, CASE p_partkey % 4 WHEN 0 THEN 'Pallet of panels' WHEN 1 THEN 'Mono panel' WHEN 2 THEN 'Set of 2' ELSE 'Poly BUNDLE' END AS title FROM part)
SELECT p_partkey, wattage FROM p WHERE wattage BETWEEN 5 AND 1000 AND price > 0 AND price / wattage BETWEEN 0.05 AND 5.0 AND p_partkey % 4 = 1""")
def single_panels_of_listings(spark, sf_dir):
    title = F.element_at(F.array(*(F.lit(t) for t in ("Pallet of panels", "Mono panel", "Set of 2", "Poly BUNDLE"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    df = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 12).alias("wattage"), (F.col("p_retailprice") / 4).alias("price"), F.lit("USD").alias("currency"), title.alias("title"))
    return leaderboard.listing_panels(df).select("p_partkey", "wattage")


@query(f'WITH {sql.PANELS}, {_LEADER} SELECT (SELECT count(*) FROM pages) AS "totalCrawled", (SELECT count(*) FROM part) AS "totalExtracted", (SELECT count(*) FROM leaders) AS "totalAfterFiltering"')
def counters_of_a_crawl(spark, sf_dir):
    from .search import crawl_counters

    return crawl_counters(table(spark, sf_dir, "pages"), table(spark, sf_dir, "part"), _leaders(spark, sf_dir))


@query("SELECT p_partkey, replace(replace(replace(replace(p_name || ' (A) it''s ~5! + 100%', '%', '%25'), ' ', '%20'), '+', '%2B'), '/', '%2F') AS escaped FROM part")
def escaped_titles(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", urls.encoded(F.concat("p_name", F.lit(" (A) it's ~5! + 100%"))).alias("escaped"))
