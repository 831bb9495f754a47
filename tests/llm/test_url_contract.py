"""The URL filter's verdicts against the rules as the contract words them."""

import sys

import pytest

sys.path.insert(0, __file__.rsplit("/", 2)[0])
from compare import assert_equal  # noqa: E402

from trackledger.llm import queries, sql  # noqa: E402

CONTRACT = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
URLS = {
    "http://a.com/en/1": "com/en/", "http://example.com/en/7x": "example.com/en/7", "http://example.com/en/8": "com/en/", "http://NET/de/": "net/de/",
    "http://www.example.net/de/7": "net/de/", "http://www.example.net/de/8": "example.net/de/8", "http://x.org/es/": "org/es/",
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The URLs as a pages table."""
    folder = tmp_path_factory.mktemp("pages")
    spark.createDataFrame([(i, u, "") for i, u in enumerate(URLS)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def test_every_rule_gives_the_verdict_of_the_contract(spark, folder):
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in queries.op3_url_filter(spark, folder).collect()}
    assert got == {i: (rule, CONTRACT[rule]) for i, rule in enumerate(URLS.values())}


def test_the_sql_follows_the_same_rules(spark, folder):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    assert_equal(queries.op3_url_filter(spark, folder), con, sql.ORACLES["op3_url_filter"])
