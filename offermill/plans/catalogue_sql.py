"""SQL for the catalogue: the same relations and rules, said independently for DuckDB."""

from __future__ import annotations

from ..functions import fixed


def _list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def _case(table: dict, key: str, default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN CAST({v!r} AS DOUBLE)" for k, v in table.items()) + f" ELSE {default} END"


def js(x: str, digits: int = 0) -> str:
    k = float(10**digits)
    return f"(floor(({x}) * {k} + 0.5) / {k})"


OFFERS = """
lines AS (SELECT l_partkey, l_suppkey, min(l_extendedprice / l_quantity) AS price, min(l_discount) AS disc FROM lineitem GROUP BY l_partkey, l_suppkey),
base AS (
  SELECT l.*, p_name, p_brand, p_size, s_nationkey, ['g', 'kg', 'mg', 'lb', 'oz', 'capsules', 'tablets', 'ml'][l_partkey % 8 + 1] AS unit,
    lower(regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g')) || ['.com', '.co.uk', '.de', '.com.au', '.jp', '.net'][s_nationkey % 6 + 1] AS vendor,
    lpad(CAST(l_partkey * 7919 % 100000000000 AS VARCHAR), 11, '0') AS body
  FROM lines l JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
coded AS (SELECT *, (10 - (3 * list_sum(list_transform([1, 3, 5, 7, 9, 11], lambda i: CAST(body[i] AS INT))) + list_sum(list_transform([2, 4, 6, 8, 10], lambda i: CAST(body[i] AS INT)))) % 10) % 10 AS digit FROM base),
offers AS (
  SELECT l_partkey * 1000000 + l_suppkey AS ordinal, l_partkey AS partkey, l_suppkey AS suppkey, s_nationkey AS nation, p_name || ' ' || p_brand || ' ' || p_size || unit AS title, price,
    ['USD', 'EUR', 'GBP', 'CAD', 'JPY', 'XXX'][s_nationkey % 6 + 1] AS currency, CAST(p_size AS DOUBLE) AS quantity, unit, vendor, 'https://www.' || vendor || '/product/' || l_partkey AS url,
    body || CAST(CASE WHEN l_partkey % 5 = 0 THEN (digit + 1) % 10 ELSE digit END AS BIGINT) AS upc, l_partkey % 5 <> 0 AS valid_upc,
    CASE WHEN l_suppkey % 3 = 0 THEN 4.99::DOUBLE END AS shipping_cost, l_suppkey % 4 = 0 AS free_shipping, CAST(trunc(disc * 300) AS BIGINT) AS discount_percent, l_partkey % 6 = 0 AS coupon,
    CAST(floor(price * 100 + 0.5) AS BIGINT) AS cents, p_size AS size
  FROM coded)
"""
USD = _case(fixed.USD_RATES, "currency", "1.0::DOUBLE")
GRAMS = _case(fixed.GRAMS, "unit", "NULL")
KNOWN = f"unit IN ({', '.join(repr(u) for u in fixed.KNOWN_UNITS)})"
NAMES = r"regexp_matches(title, '(?i)\d+\s*(g|kg|mg|capsules|tablets)')"
CONF = f"""least(((CASE WHEN price > 0 THEN 0.25::DOUBLE ELSE 0 END) + (CASE WHEN quantity > 0 THEN 0.25::DOUBLE ELSE 0 END) + (CASE WHEN {KNOWN} THEN 0.15::DOUBLE ELSE 0 END)
 + (CASE WHEN length(title) > 10 THEN 0.1::DOUBLE ELSE 0 END) + (CASE WHEN length(title) > 10 AND {NAMES} THEN 0.05::DOUBLE ELSE 0 END) + (CASE WHEN valid_upc THEN 0.15::DOUBLE ELSE 0 END)
 + (CASE WHEN matches > 0 THEN least(matches * 0.05::DOUBLE, 0.15::DOUBLE) ELSE 0 END)) / 1.2::DOUBLE, 1.0::DOUBLE)"""
PPU = f"(CASE WHEN quantity * {GRAMS} > 0 THEN price / (quantity * {GRAMS}) ELSE price / quantity END)"
RANKED = (
    OFFERS
    + f""",
matched AS (SELECT *, count(*) OVER (PARTITION BY upc) - 1 AS matches FROM offers),
sure AS (SELECT *, {PPU} AS raw, {CONF} AS conf FROM matched WHERE price IS NOT NULL AND quantity IS NOT NULL),
priced AS (SELECT *, {js("raw", 4)} AS price_per_unit, {js(f"raw * {USD}", 4)} AS price_per_unit_usd, {js("conf", 2)} AS confidence FROM sure WHERE conf >= 0.5),
effs AS (SELECT *, price_per_unit + CASE WHEN shipping_cost > 0 THEN shipping_cost / quantity ELSE 0 END AS eff FROM priced),
means AS (SELECT *, avg(eff) OVER () AS mean FROM effs),
scored AS (SELECT *, {js('''1.0 / (eff + 0.001::DOUBLE) * (CASE WHEN (mean - eff) / mean > 0.2 THEN 1.0 + (mean - eff) / mean * 0.5::DOUBLE ELSE 1.0 END) * (0.8::DOUBLE + confidence * 0.4::DOUBLE)
  * (CASE WHEN valid_upc THEN 1.15::DOUBLE ELSE 1.0 END) * (CASE WHEN matches > 0 THEN 1.0 + 0.05::DOUBLE * matches ELSE 1.0 END) * (CASE WHEN free_shipping THEN 1.05::DOUBLE ELSE 1.0 END)
  * (CASE WHEN discount_percent > 10 THEN 1.0 + discount_percent / 200.0::DOUBLE ELSE 1.0 END) * (CASE WHEN coupon THEN 1.05::DOUBLE ELSE 1.0 END)''', 3)} AS deal_score FROM means),
firsts AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY vendor, floor(price_per_unit * 100 + 0.5) ORDER BY deal_score DESC, ordinal) = 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY deal_score DESC, ordinal) AS rank FROM firsts ORDER BY rank LIMIT 50)
"""
)
PANELS = (
    OFFERS
    + f""",
raw_panels AS (SELECT ordinal, title, price / 10 AS price, currency, CAST(size * 20 AS BIGINT) AS wattage, vendor, url, ['US', 'UK', 'DE', 'AU'][nation % 4 + 1] AS country,
  ['monocrystalline', 'bifacial', 'unknown'][partkey % 3 + 1] AS "panelType", CASE WHEN partkey % 4 <> 0 THEN size * 0.5::DOUBLE + 1 END AS efficiency, partkey % 10 / 10.0::DOUBLE AS confidence FROM offers),
panels AS (SELECT *, price * {USD} AS "priceUsd", {js("price / wattage", 3)} AS "pricePerWatt", {js(f"price * {USD} / wattage", 3)} AS "pricePerWattUsd" FROM raw_panels)
"""
)
STOCK = """stock AS (SELECT partkey, max_by(status, event_id) AS status FROM (SELECT user_id % 500 AS partkey, event_id, ['in_stock', 'out-of-stock', 'unknown', 'in-stock', ''][event_id % 5 + 1] AS status FROM events) WHERE status NOT IN ('unknown', '') GROUP BY partkey)"""


def host(url: str) -> str:
    return f"coalesce(nullif(lower(regexp_extract({url}, '^[a-zA-Z]+://([^/:?#]+)', 1)), ''), 'unknown')"


def domain(url: str) -> str:
    return f"regexp_replace({host(url)}, '^www\\.', '')"


def country(url: str) -> str:
    tests = [f"WHEN {' OR '.join(f'''ends_with({host(url)}, '{s}')''' for s in v[2])} THEN '{c}'" for c, v in fixed.COUNTRIES.items()]
    return "CASE " + " ".join(tests) + " END"


def within(d: str, names: list[str]) -> str:
    return f"len(list_filter({_list(names)}, lambda x: {d} = x OR ends_with({d}, '.' || x))) > 0"


def ends(d: str, names: list[str]) -> str:
    return f"len(list_filter({_list(names)}, lambda x: ends_with({d}, x))) > 0"


def tier(url: str, vendors: list[str], deals: list[str], more: str = "") -> str:
    shop = "|".join([*fixed.SHOP_URL, *([more] if more else [])])
    return f"CASE WHEN {within(host(url), fixed.BROWSER_DOMAINS)} THEN 5 WHEN {ends(domain(url), vendors)} THEN 1 WHEN {ends(domain(url), deals)} THEN 2 WHEN regexp_matches({url}, '(?i){shop}') THEN 3 ELSE 4 END"


def price(t: str) -> str:
    """value and currency, as a struct."""
    amount = r"(\d+(?:[.,]\d{2})?)"
    sym, code, bare = f"([£$€₹¥])\\s*{amount}", f"(?i){amount}\\s*(USD|EUR|GBP|INR|AUD|CAD|JPY)", r"(\d+(?:\.\d{2}))"
    num = lambda p, g: f"TRY_CAST(replace(nullif(regexp_extract({t}, '{p}', {g}), ''), ',', '.') AS DOUBLE)"
    symbol = "CASE regexp_extract(%s, '%s', 1) " % (t, sym) + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.SYMBOL_CURRENCY.items()) + " END"
    return f"CASE WHEN {num(sym, 2)} > 0 THEN struct_pack(value := {num(sym, 2)}, currency := {symbol}) WHEN {num(code, 1)} > 0 THEN struct_pack(value := {num(code, 1)}, currency := upper(regexp_extract({t}, '{code}', 2))) WHEN {num(bare, 1)} > 0 THEN struct_pack(value := {num(bare, 1)}, currency := 'USD') END"


def unit_name(u: str) -> str:
    return f"CASE WHEN {u} LIKE '%fl%' AND {u} LIKE '%oz%' THEN 'fl oz' WHEN {u} LIKE '%veggie%' AND {u} LIKE '%cap%' THEN 'capsules' ELSE CASE {u} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.UNIT_NAMES.items()) + f" ELSE {u} END END"


def quantity(t: str) -> str:
    n = r"(\d+(?:\.\d+)?)\s*"
    first, second = f"{n}({fixed.WEIGHT_UNITS})\\b", f"{n}({fixed.COUNT_UNITS})"
    t = f"trim(lower({t}))"
    get = lambda p, g: f"nullif(regexp_extract({t}, '{p}', {g}), '')"
    return " ".join(["CASE", *(f"WHEN {get(p, 1)} IS NOT NULL THEN struct_pack(value := CAST({get(p, 1)} AS DOUBLE), unit := {unit_name(get(p, 2))})" for p in (first, second)), "END"])


def check(code: str, size: int) -> str:
    weights = [3 if (size - i) % 2 == 0 else 1 for i in range(size - 1)]
    return f"(regexp_full_match({code}, '[0-9]{{{size}}}') AND coalesce((10 - list_sum(list_transform(range(1, {size}), lambda i: TRY_CAST({code}[i] AS INT) * {weights}[i])) % 10) % 10 = TRY_CAST({code}[{size}] AS INT), false))"


#: The queries for supplements in the US, the UK and Germany, written out.
SUPPLEMENT_QUERIES = [
    '{} (site:allstarhealth.com OR site:dpsnutrition.net)',
    '{} (site:taoofherbs.com OR site:jacked-factory.com)',
    '{} (site:iherb.com OR site:vitacost.com)',
    '{} (site:swansonvitamins.com OR site:bulksupplements.com)',
    '{} "add to cart"',
    '{} "in stock" buy',
    '{} price per serving',
    '{} -review -blog -article -reddit -"best 10"',
    '{} (site:priceplow.com OR site:slickdeals.net OR site:dealsplus.com)',
    '{} (site:amazon.com OR site:bodybuilding.com OR site:gnc.com)',
    '{} (site:vitaminshoppe.com OR site:costco.com OR site:samsclub.com)',
    '{} buy site:*.co.uk',
    '{} buy site:*.de',
    '{} (site:priceplow.com OR site:nootropicsdepot.com OR site:allstarhealth.com)',
    '{} "per serving" price',
    '{} coupon code discount',
    '{} buy supplement online',
    '"alternative to" "{}" buy',
    '{} (site:chemistwarehouse.com.au OR site:amcal.com.au OR site:pharmacyonline.com.au OR site:healthpost.co.nz)',
    '"{}" buy',
    '"{}" price',
]
#: The queries for panels in the US, written out; elsewhere two more stand in twelfth place.
PANEL_QUERIES = [
    '"solar panel" (site:renogy.com OR site:signature-solar.com)',
    '"solar panel" (site:shopsolarkits.com OR site:unboundsolar.com)',
    '"solar panel" (site:wholesalesolar.com OR site:solaris.com)',
    '"solar panel" (site:bousol.com OR site:goalzero.com)',
    'solar panel "add to cart" -blog -article -guide -review -reddit',
    'solar panel "in stock" buy -review -blog -reddit -cost-guide',
    'solar panel shop online "add to cart" -best -review',
    '400W solar panel "add to cart" buy',
    '500W monocrystalline solar panel buy -review',
    '200W portable solar panel buy "add to cart"',
    '600W bifacial solar panel buy shop',
    '300W solar panel buy online -blog -review',
    'solar panel /product/ OR /shop/ buy',
    'solar panel watt price "add to cart" -guide -article',
    'solar panel deal clearance "add to cart" -blog',
    'solar panel sale "free shipping" buy',
    'solar panel price (site:energysage.com OR site:pvxchange.com OR site:solaris.com)',
    'Renogy solar panel buy "add to cart"',
    'LONGi solar panel buy shop',
    'Canadian Solar panel buy online',
    'Trina solar panel buy shop',
]
MORE_PANEL_QUERIES = {
    "US": [],
    'UK': ['solar panel buy site:*.co.uk -blog -review', 'solar panel shop UK "add to cart"'],
    'DE': ['solar panel buy site:*.de -blog -review', 'solar panel shop Deutschland "add to cart"'],
    'AU': ['solar panel buy site:*.com.au -blog -review', 'solar panel shop Australia "add to cart"'],
}
