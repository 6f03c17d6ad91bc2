from __future__ import annotations

import duckdb

from driftwell.llm.common import table
from driftwell.llm.q_urlfilter import SQL, op7_url_filter
from driftwell.llm.urlfilter import filter_urls

SCHEMA = "page_id long, url string, html string, host string, pages int, node string"


def judged(spark, urls):
    df = spark.createDataFrame([(i, u, "x", "clash", 1, "clash") for i, u in enumerate(urls)], SCHEMA)
    return {r.page_id: r for r in filter_urls(df).collect()}


def test_as_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf_dir}/pages.parquet')")
    columns = ["page_id", "host", "path", "rule", "verdict"]
    want = sorted(con.execute(SQL).fetchdf()[columns].itertuples(index=False, name=None), key=str)
    got = sorted((tuple(r[c] for c in columns) for r in op7_url_filter(spark, sf_dir).collect()), key=str)
    assert [tuple(None if x != x else x for x in r) for r in want] == got


def test_hosts_paths_and_rules(spark):
    cases = {
        "https://WWW.Example.ORG/es/1?x=/en/": ("www.example.org", "/es/1", "example.org/es/", "block"),
        "http://example.org/en/12#a": ("example.org", "/en/12", "example.org/en/1", "block"),
        "http://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "http://notexample.org/es/1": ("notexample.org", "/es/1", "org/", "allow"),
        "http://a.com/fr/x": ("a.com", "/fr/x", "com/fr/", "allow"),
        "http://a.com/de/": ("a.com", "/de/", "com/de/", "block"),
        "http://a.com/de": ("a.com", "/de", None, None),
        "http://b.org": ("b.org", "", None, None),
        "a://b.net?c://d/e": ("b.net", "", None, None),
        "no scheme": ("", "", None, None),
        None: ("", "", None, None),
        "": ("", "", None, None),
        "x://É.COM/" + "ü" * 100_000: ("É.com", "/" + "ü" * 100_000, None, None),
    }
    got = judged(spark, list(cases))
    for i, (host, path, rule, verdict) in enumerate(cases.values()):
        assert (got[i].host, got[i].path, got[i]["rule"]) == (host, path, rule)
        assert got[i].verdict in ("allow", "block") and (verdict is None or got[i].verdict == verdict)


def test_templates_generalise_and_take_their_branch_s_purity(spark):
    urls = [f"http://s.com/item/{w}/view" for w in ("ant", "bee", "cat", "dog", "elk", "fox", "gnu", "hen", "ibis")]
    urls += [f"http://s.com/de/{i}" for i in range(30)] + ["http://s.com/de", "http://s.com/x/2024-01-05/0123456789abcdef/a/b/c"]
    got = judged(spark, urls)
    assert {got[i].template for i in range(9)} == {"/item/*/view"}
    assert got[9].template == "/de/*" and got[9].verdict == "block"
    assert got[40].template == "/x/*/*/a/**"
    assert got[39].verdict == "block"  # nothing but blocked examples on this host


def test_rows_stay(spark):
    got = filter_urls(spark.createDataFrame([(1, "http://a.b/c", None, None, None, None)] * 3 + [(None, None, None, None, None, None)], SCHEMA))
    assert sorted(str(r.page_id) for r in got.collect()) == ["1", "1", "1", "None"]
    assert filter_urls(table(spark, "/root/testdata/sf0.001", "pages").limit(0)).count() == 0
