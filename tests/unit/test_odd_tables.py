"""Queries of the catalogue against their SQL on tables with odd rows: repeated urls, open references, keys that meet."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from offermill.plans import catalogue


def same(spark, folder, name, **tables):
    con = duckdb.connect()
    for t, rows in tables.items():
        pq.write_table(pa.table(rows), f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    cursor = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in cursor.fetchall())
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    assert got == want and want
    return got


@pytest.mark.parametrize("name", ["listing_pages_reached", "listing_products_reached"])
def test_listings_whose_url_several_pages_have(spark, tmp_path, name):
    # 1 leads to 4; 4 and 7 have one url, and only 7 leads to 22, 23 and 51; their links together are more than a listing's five
    urls = [f"https://h{k % 3}.example/l?p={4 if k == 7 else k}" for k in range(80)]
    got = same(spark, tmp_path, name, pages={"page_id": list(range(80)), "url": urls, "html": [""] * 80})
    assert any("Panel 7 300W" in r or "?p=22'" in r for r in got)


def test_titles_with_references_that_no_semicolon_ends(spark, tmp_path):
    titles = ["a &amp; b &quot;c&quot;", "cut &amp", "cut &am", "&ampx; y", "a &quot b", "R&D", "1 &amp 2 &amp; 3"]
    html = [f"<html><head><title>{t}</title></head><body><p>1</p><p>2</p></body></html>" for t in titles]
    got = same(spark, tmp_path, "registered_extractors", pages={"page_id": list(range(len(html))), "url": ["https://a.example/x"] * len(html), "html": html})
    assert len(got) == len(html)
    from offermill.sources import registry

    assert next(iter(registry._fields(html[1])))["title_tag"] == "cut &"  # as browsers do, unless only closed ones are asked for


def test_versions_whose_added_keys_exist(spark, tmp_path):
    keys = [*range(1, 40), *range(1_000_001, 1_000_040)]
    same(spark, tmp_path, "versions_of_a_table", part={"p_partkey": keys, "p_size": pa.array([k % 50 + 1 for k in keys], pa.int32())})
