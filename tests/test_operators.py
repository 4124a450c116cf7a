"""Cases of checks, reviews, chunks, ranges, stores, layout and streams."""

import pytest
from pyspark.sql import functions as F

from paraqa.functions import checks, chunks, prompts, ranges
from paraqa.functions import text as T
from paraqa.operators import decisions, layout, viewer
from paraqa.sources import tables
from paraqa.streaming import resume, translate

SOURCE = "The sample {v1} was heated to <style id='2'>300 degrees</style> for 76.5 minutes in 12 separate cells of the device"
GOOD = "样品 {v1} 在装置的 12 个独立单元中加热到 <style id='2'>300 度</style> 持续 76.5 分钟并保持稳定"
CASES = [
    (SOURCE, GOOD, []),
    (SOURCE, GOOD.replace("{v1}", ""), ["markup"]),
    (SOURCE, GOOD.replace("{v1}", "{ v1 }"), []),
    (SOURCE, GOOD.replace("300", "三百"), ["numbers:300"]),
    ("We saw 1,024 large blue cells there", "我们在那里看到了1024个很大的蓝色细胞", []),
    (SOURCE, GOOD + " separate cells of the device", ["leftover:separate cells of the device"]),
    (SOURCE, "太短了", ["markup", "numbers:12|300|76.5", "short"]),
    (SOURCE, " ", ["empty"]),
    (SOURCE, None, ["empty"]),
    ("These are four words", "Ceci est une phrase", ["no_cjk"]),
    ("Only three words", "Trois mots", []),
    ("a 5 and 5 and 5", "5", ["numbers:5"]),
    (None, "多", []),
]


@pytest.mark.parametrize("source,output,want", CASES)
def test_check(spark, source, output, want):
    row = spark.createDataFrame([(source, output)], "source string, draft string")
    assert checks.checked(row).first().issues == want


def test_ratio_boundaries(spark):
    forty, less = "a" * 10 + " " + "b" * 10 + " " + "c" * 10 + " " + "d" * 10, "a" * 10 + " " + "b" * 10 + " " + "c" * 10 + " " + "d" * 9
    rows = [(forty, "字" * 8, []), (forty, "字" * 7, ["short"]), (less, "字" * 7, []), (forty, "字" * 52, []), (forty, "字" * 53, ["long"])]
    got = checks.checked(spark.createDataFrame([(k, *r[:2]) for k, r in enumerate(rows)], "k int, source string, draft string")).orderBy("k").collect()
    assert [r.issues for r in got] == [r[2] for r in rows]


def test_keep_terms(spark):
    row = spark.createDataFrame([(SOURCE, GOOD + " Separate cells of the device")], "source string, draft string")
    assert checks.checked(row, keep=F.array(F.lit("separate cells of the device"))).first().issues == []


def test_long_run_needs_no_stack(spark):
    row = spark.createDataFrame([("word " * 20000,)], "t string")
    assert row.select(F.size(T.english_runs(F.col("t"))).alias("n")).first().n == 1


def test_split_text(spark):
    sentences = " ".join(f"This is sentence number {k}." for k in range(50))
    rows = spark.createDataFrame([("short",), (sentences,), ("x" * 250,), ("",), (None,)], "t string")
    got = [r.p for r in rows.select(chunks.split_text("t", 120).alias("p")).collect()]
    assert got[0] == ["short"] and got[3] == [""]
    assert all(len(p) <= 120 for p in got[1]) and " ".join(got[1]) == sentences
    assert [len(p) for p in got[2]] == [120, 120, 10]


def test_page_ranges(spark):
    one = lambda spec, n: spark.createDataFrame([(spec, n)], "s string, n int").select(ranges.parse_pages(F.col("s"), F.col("n")).alias("p")).first().p
    assert one("1-3,7", 10) == [0, 1, 2, 6] and one("", 2) == [0, 1] and one("5-", 6) == [4, 5] and one("11-12", 10) == []
    for bad in ("0-2", "5-3"):
        with pytest.raises(Exception, match="bad page range"):
            one(bad, 10)


def test_choose(spark):
    rows = [(SOURCE, GOOD, "fixed", GOOD + "。", ["p"]), (SOURCE, GOOD, "fixed", GOOD.replace("{v1}", ""), ["p"]), (SOURCE, GOOD, "fixed", GOOD.replace("300", "三百"), []), (SOURCE, GOOD, "ok", "x", ["q"]), (SOURCE, GOOD, None, None, None), (SOURCE, GOOD, "fixed", " ", [])]
    got = decisions.choose(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, source string, draft string, verdict string, output string, problems array<string>")).orderBy("k").collect()
    assert [r.final == GOOD for r in got] == [False, True, True, True, True, True]
    assert [r.problems for r in got] == [["p"], ["p", decisions.BREAKS], [decisions.WORSE], ["q"], [], []]


def test_replies(spark):
    rows = spark.createDataFrame([(1, '[{"id": 1, "verdict": "FIXED", "problems": "one", "output": "x"}]'), (2, "nonsense")], "b int, r string")
    got = prompts.reviews(rows, "b", "r").collect()
    assert [(r.b, r.verdict, r.problems, r.output) for r in got] == [(1, "fixed", ["one"], "x")]


def test_store(spark, tmp_path):
    path, schema = str(tmp_path / "notes"), "k string, final string"
    put = lambda rows: tables.save_keyed(spark, path, spark.createDataFrame(rows, "k string, final string, seq long"), schema)
    put([("a", "1", 0), ("b", "1", 1), ("a", "2", 2)])
    put([("c", "1", 0), ("b", None, 1)])
    tables.delete_keyed(spark, path, spark.createDataFrame([("c",)], "k string"), schema)
    assert sorted(map(tuple, tables.read_keyed(spark, path, schema).collect())) == [("a", "2"), ("b", None)]


def test_glossary_and_report_files(spark, tmp_path):
    (tmp_path / "g.csv").write_text("﻿source,target\n cell ,细胞\n,x\nDNA,DNA\n", encoding="utf-8")
    assert sorted(map(tuple, tables.read_glossary(spark, str(tmp_path / "g.csv")).collect())) == [("DNA", "DNA"), ("cell", "细胞")]


def test_report_file_is_in_order(spark, tmp_path):
    rows = [(k, ("manual", "check", "fixed", "english")[k % 4], None if k % 5 == 0 else k * 7 % 11, f"s{k}", "t", ["n"], "d") for k in range(200)]
    items = spark.createDataFrame(rows, "seq long, " + tables.ITEM).repartition(16)
    tables.write_report(items, 7, str(tmp_path / "r"))
    got = [tuple(r) for r in tables.read_report(spark, str(tmp_path / "r")).collect()]
    kinds = ("check", "english", "fixed", "manual")
    want = sorted(rows, key=lambda r: (kinds.index(r[1]), 10**6 if r[2] is None else r[2], r[0]))
    assert got == [(7, *r[1:]) for r in want]


def test_batch_notes_and_moves(spark, tmp_path):
    rows = spark.createDataFrame([("s", "f", "d", ["p"], [], None, True, False)], tables.PARAGRAPH)
    tables.write_notes(rows, str(tmp_path / "n"))
    assert tables.read_notes(spark, str(tmp_path / "n")).collect() == rows.collect()
    (tmp_path / "a.json").write_text('[{"source": "x", "final": "y", "problems": ["q"]}, {"source": "z"}]')
    assert [(r.source, r.final, r.problems) for r in tables.read_notes(spark, str(tmp_path / "a.json")).collect()] == [("x", "y", ["q"]), ("z", None, None)]
    assert tables.read_notes(spark, str(tmp_path / "missing")).count() == 0
    assert tables.moved(spark, str(tmp_path / "missing"), str(tmp_path / "b")) is None
    assert tables.moved(spark, str(tmp_path / "n"), str(tmp_path / "b")) == str(tmp_path / "b") and tables.read_notes(spark, str(tmp_path / "b")).count() == 1


def test_unicode_spaces_and_digits(spark):
    text = "one\u00a0two\u2003three\x1cfour and \u0661\u0662,\u0663\u0664\u0665 or 1,234,567 and 1,0245 {\u00a0v\u0661 }"
    row = spark.createDataFrame([(text,)], "t string").select(T.english_runs(F.col("t")).alias("r"), T.numbers(F.col("t")).alias("n"), T.placeholders(F.col("t")).alias("p"), T.strip(F.lit("\x1d\u3000a\x85")).alias("s")).first()
    assert row.r == ["one\u00a0two\u2003three\x1cfour and"] and row.n == ["\u0661\u0662\u0663\u0664\u0665", "1234567", "1,0245"] and row.p == ["{v\u0661}"] and row.s == "a"


def test_improve(spark):
    bad = GOOD.replace("300", "三百")
    rows = spark.createDataFrame([(1, 0, SOURCE, bad, GOOD), (1, 1, SOURCE, bad, GOOD), (2, 0, SOURCE, bad, GOOD), (2, 1, SOURCE, GOOD, bad), (3, 0, SOURCE, bad, None)], "batch int, id int, source string, draft string, again string")
    said = spark.createDataFrame([(1, 0, "fixed", ["number"], GOOD)], "batch int, id int, verdict string, problems array<string>, output string")
    by = lambda df: {(r.batch, r.id): (r.final == GOOD, r.problems) for r in df.collect()}
    got = by(decisions.improve(rows, "full", said))
    assert got[1, 0] == (True, ["number"]) and got[1, 1] == (False, []) and got[2, 0] == (True, ["numbers:300"]) and got[2, 1] == (True, []) and got[3, 0] == (False, [])
    assert by(decisions.improve(rows, "rules"))[1, 1] == (True, ["numbers:300"]) and by(decisions.improve(rows.drop("again"), "rules"))[1, 1] == (False, [])
    assert by(decisions.improve(rows, "off", said))[1, 0] == (False, []) and decisions.notes_of(decisions.improve(rows, "off")).columns == ["k", "source", "draft", "final", "problems"]
    with pytest.raises(ValueError, match="no such mode"):
        decisions.improve(rows, "some")


def test_pages_that_cannot_be_translated(spark):
    one = lambda spec, n, locked: spark.createDataFrame([(spec, n, locked)], "s string, n int, e boolean").select(ranges.pages_to_translate(F.col("s"), F.col("n"), F.col("e")).alias("p")).first().p
    assert one("2-", 3, False) == [1, 2]
    for args in (("1", 3, True), ("11-12", 10, False), ("a", 3, False)):
        with pytest.raises(Exception, match="can't translate"):
            one(*args)


def test_output_names():
    names = {tables.output_names("/a/b.pdf", engine=e)["mono"] for e in ("", "google", "microsoft")}
    assert names == {"/a/b.zh-CN.pdf", "/a/b.zh-CN.google.pdf", "/a/b.zh-CN.microsoft.pdf"}


def _chars(spark, lines):
    rows = [(n, i, c, x + 5.0 * i, x + 5.0 * i + 5, y, y + 7, 10.0) for n, pieces in enumerate(lines) for i, (x, y, c) in enumerate((x0 - 5.0 * start, y, c) for start, x0, y, c in _placed(pieces))]
    return spark.createDataFrame(rows, "line int, i int, c string, x double, x2 double, y double, y2 double, size double")


def _placed(pieces):
    out, i = [], 0
    for x, y, text in pieces:
        for k, c in enumerate(text):
            out.append((i, x + 5.0 * k, float(y), c))
            i += 1
    return out


def test_layout(spark):
    lines = [[(50, 100, "1.1"), (100, 100, "Title here"), (520, 100, "12")], [(50, 100, "Preface"), (520, 100, "xiii")], [(50, 100, "run 12")], [(50, 100, "12")], [(50, 100, "first"), (50, 80, "second")]]
    printed = layout.printed_lines(_chars(spark, lines))
    got = {(r.line, r.printed): r for r in layout.marks(printed).collect()}
    assert got[0, 0].trail == "12" and got[0, 0].lead_x == 100 and got[1, 0].trail == "xiii"
    assert got[2, 0].trail is None and got[3, 0].trail is None and (4, 1) in got


def test_entries(spark):
    rows = [("b", 0, 50.0, 100.0, None, 10.0, "1 long title"), ("b", 1, 100.0, None, "7", 10.0, "goes on"), ("b", 2, 100.0, None, "9", 10.0, "new"), ("b", 3, 50.0, 100.0, "11", 10.0, "2 next")]
    got = layout.entries(spark.createDataFrame(rows, "block string, seq int, x double, lead_x double, trail string, em double, text string")).orderBy("seq").collect()
    assert [r.entry for r in got] == [0, 0, 1, 2]


def test_retries():
    calls = []

    def flaky(text):
        calls.append(text)
        if len(calls) < 3:
            raise OSError("busy")
        return "ok"

    assert translate.with_retries(flaky, "x", sleep=lambda s: None) == "ok" and len(calls) == 3
    waits = []
    with pytest.raises(RuntimeError, match="google"):
        translate.with_retries(lambda t: 1 / 0, "x", sleep=waits.append, engine="google")
    assert waits == [1, 2, 4]
    with pytest.raises(RuntimeError, match="llm"):
        translate.with_retries(lambda t: 1 / 0, "x", "llm", sleep=waits.append)
    assert waits[3:] == [2, 4, 8, 16, 30]
    with pytest.raises(translate.HardError):
        translate.with_retries(lambda t: (_ for _ in ()).throw(translate.HardError("no")), "x")


def test_engines(spark):
    def make():
        def call(text):
            if text == "bad":
                raise translate.HardError("no")
            assert len(text) <= 2000
            return text.upper()

        return call

    engine = translate.register("google", make)
    assert translate.engine_of("google") is engine and engine.limit == 2000 and translate.register("other", make).limit == 4000
    assert translate.register("llm", make).limit is None and translate.engine_of("llm").kind == "llm"
    with pytest.raises(ValueError, match="no such engine"):
        translate.engine_of("none")
    long = " ".join(f"This is sentence number {k}." for k in range(300))
    rows = spark.createDataFrame([("a",), ("bad",), (None,), (" ",), (long,)], "source string")
    got = translate.translated(rows, engine).collect()
    assert [(r.draft, r.error) for r in got[:4]] == [("A", None), (None, "no"), (None, None), (" ", None)]
    assert got[4].error is None and got[4].draft.replace(" ", "") == long.upper().replace(" ", "")
    assert translate.exit_status(translate.translated(rows, engine)) == 1 and translate.exit_status(translate.translated(rows.limit(1), engine, per_second=100, workers=2)) == 0


def test_preflight():
    calls = []

    def made(fails):
        def call(text):
            calls.append(text)
            if fails:
                raise OSError("no key")
            return text

        return lambda: call

    good, wrong = translate.Engine("llm", made(False), kind="llm"), translate.Engine("reviewer", made(True), kind="llm")
    translate.preflight(good, good)
    assert len(calls) == 1
    with pytest.raises(RuntimeError, match="no connection to reviewer"):
        translate.preflight(good, wrong)
    assert len(calls) == 3  # a probe isn't repeated


def test_stream_resumes(spark, tmp_path):
    seen = []
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    spark.range(3).coalesce(1).write.parquet(source)
    resume.run(spark, source, "id long", checkpoint, lambda df, k: seen.append(df.count())).awaitTermination()
    resume.run(spark, source, "id long", checkpoint, lambda df, k: seen.append(df.count())).awaitTermination()
    spark.range(2).coalesce(1).write.mode("append").parquet(source)
    resume.run(spark, source, "id long", checkpoint, lambda df, k: seen.append(df.count())).awaitTermination()
    assert seen == [3, 2]


def test_batches_are_keyed_by_their_pages(spark):
    a = resume.batches(spark.createDataFrame([("d", p) for p in range(3)], "doc string, page int"), "doc")
    b = resume.batches(spark.createDataFrame([("d", p) for p in range(9, 12)], "doc string, page int"), "doc")
    assert resume.todo(b, a, "doc").count() == 3 and resume.todo(a, a, "doc").count() == 0
    now, old = a.withColumn("signature", F.lit("new")), a.withColumn("signature", F.lit("old"))
    assert resume.todo(now, old, "doc").count() == 3 and resume.todo(now, now, "doc").count() == 0


def test_viewer(spark):
    tops = viewer.page_tops(spark.createDataFrame([("a", p, 100.0) for p in range(3)], "doc string, page long, height double"), "doc", 1.0, 10)
    offsets = spark.createDataFrame([("a", y) for y in (0, 109, 110, 500)], "doc string, y long")
    assert {r.y: r.page for r in viewer.page_at(tops, offsets, "doc").collect()} == {0: 0, 109: 0, 110: 1, 500: 2}
