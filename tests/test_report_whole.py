"""The report queries look at every page."""

import re

from paraqa.plans import queries as plans

SF = "/root/testdata/sf0.001"


def brute(text):
    """Lines of a text with 12 English words and six in a row."""
    lines = [re.sub(r"\s+", " ", x).strip() for x in text.split("\n")]
    return sum(len(re.findall("[A-Za-z][A-Za-z’'-]+", x)) >= 12 and bool(re.search(r"(?:[A-Za-z][A-Za-z’'-]*[\s,;:]+){5,}[A-Za-z]", x)) for x in lines)


def test_english_blocks_on_every_page(spark):
    got = {r.page: r["count"] for r in plans.QUERIES["english_blocks"](spark, SF).groupBy("page").count().collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").collect()
    want = {r.doc_id: n for r in docs if (n := brute(r.text or ""))}
    assert {p % 2 for p in want} == {0, 1} and {p: got.get(p) for p in want} == want


def test_no_query_reads_a_part_of_its_pages():
    for name in ("english_blocks", "english_unreported", "report_items", "report_summary", "report_filter_kind"):
        assert "% 2 = 0), unnest" not in plans.ORACLES[name] and "% 10 = 0), unnest" not in plans.ORACLES[name]
