"""The report's work grows with the text: checks run once, strings are listed once, and pages are found as by looking through all."""

import io
import random
from contextlib import redirect_stdout

from paraqa.functions import text as T
from paraqa.operators import report
from paraqa.plans import queries as plans
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def explained(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("extended")
    return out.getvalue().split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]


def test_a_filter_on_the_kind_does_not_repeat_the_checks(spark):
    plan = explained(plans.QUERIES["report_summary"](spark, SF))
    assert plan.count("markup") == 1


def test_counts_look_at_no_page_and_sort_nothing(spark):
    plan = explained(plans.QUERIES["report_summary"](spark, SF))
    assert "MapInArrow" not in plan and "Sort [" not in plan


def test_items_are_digests_before_they_are_dealt_out(spark):
    for name in ("report_items", "report_snippets"):
        plan = explained(plans.QUERIES[name](spark, SF))
        assert "documents.parquet" not in plan and "regexp" not in plan.split("MapInArrow")[0]


def test_page_finder_lists_few_strings(spark):
    """2,000 pages of one repeated passage: a task hands on a string once, and only strings that may be probes."""
    pages = spark.range(2000).select(F.col("id").alias("page"), F.lit("译文" * 300).alias("s")).repartition(2)
    probes = spark.createDataFrame([("译文" * 6,), ("手动12",)], "probe string")
    got = pages.mapInArrow(report._strings(report._filter(probes), True), "gram string, page long").collect()
    assert len(got) < 100 and min(r.page for r in got if r.gram == "译文" * 6) == 0


def test_page_finder_against_brute_force(spark, monkeypatch):
    """Borders between pages and pieces, probes of all lengths, characters outside the basic plane, nulls."""
    monkeypatch.setattr(report, "HELD", 40)
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab译文.😀") for _ in range(rng.choice([0, 3, 4, 5, 11, 12, 13, 39, 40, 41, 500]))) for _ in range(120)]
    items = [t[(a := rng.randrange(len(t))) : a + rng.choice([3, 4, 5, 11, 12, 13, 30])] for t in texts if t] + ["zzzz", "nowhere to be found", "", None]
    got = {r.item: r.page for r in report.find_pages(spark.createDataFrame(list(enumerate(items)), "item int, text string"), spark.createDataFrame([*enumerate(texts), (500, None)], "page int, text string")).collect()}
    want = {}
    for k, t in enumerate(items):
        for probe in ((t or "")[:12], (t or "")[len(t or "") // 2 :][:12]):
            if k not in want and len(probe) >= 4 and (found := [p for p, s in enumerate(texts) if probe in s]):
                want[k] = found[0]
    assert got == want and len(want) > 60


def test_short_cuts_agree_with_whole_texts(spark):
    rng = random.Random(2)
    rows = ["".join(rng.choice([" ", "  ", "\t", "\xa0", " ", "　", "\x85", "a", "word ", "it's ", "é", "译", "{v1}", "<b>", "<", "7 "]) for _ in range(rng.randrange(120))) for _ in range(600)]
    x = F.col("t")
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    old = (F.regexp_replace(x, T.SPACE, " "), F.regexp_replace(x, T.SPACE, ""), F.substring(T.squash(x), 1, 40), T.count_matches(x, T.ENGLISH_WORD) >= 12, F.size(T.english_runs(x, 6)) > 0, F.length(x) - F.length(F.regexp_replace(x, T.CJK, "")))
    new = (T.collapse(x), T.without_space(x), T.squashed_start(x, 40), T.has_words(x, 12), T.has_run(x, 6), T.count_cjk(x))
    wrong = [r for r in df.select("t", *(a.eqNullSafe(b).alias(f"c{k}") for k, (a, b) in enumerate(zip(old, new)))).collect() if not all(r[1:])]
    assert not wrong
