"""Queries that SQL can express give the same rows in DuckDB."""

import random

import duckdb
import pytest

from paraqa.llm import registry

SF = "/root/testdata/sf0.001"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted(repr(tuple(r[k] for k in order)) for r in rows)


def odd_tables(spark, folder):
    """Nulls, empty and long texts, repeats, ties, odd characters."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefg%#é", k=rng.randint(1, 7))) for _ in range(80)]
    texts = [" ".join(rng.choices(words, k=rng.choice([3, 12, 60, 200]))) for _ in range(60)]
    texts += [None, "", " \n\t", "x " * 9000, "same line\n" * 30, *texts[:10], texts[0] + "\n" + texts[1], "a b c d e f g h i j " * 3, "\x0b\x0c one\u00a0word", "\u20ac" * 300]
    items = [" ".join(rng.choices(words, k=n)) for n in (4, 6, 9, 13, 20, 40, 40)] + ["样品被加热到三百度并保持十二分钟然后冷却", None, ""]
    for k in range(80):
        parts = rng.choice(items[:7]).split()
        for at in rng.sample(range(len(parts)), rng.randint(0, 1 + len(parts) // 6)):
            parts[at] = rng.choice(words)
        texts.append(" ".join(rng.choices(words, k=rng.randint(0, 9)) + parts + rng.choices(words, k=rng.randint(0, 9))).upper())
    texts.append("前言样品被加热到五百度并保持十二分钟然后冷却结束")
    rows = [(k or None, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", None]), 1) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([*enumerate(items), (90, items[5])], "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")


@pytest.mark.parametrize("table", ["given", "odd", "empty"])
@pytest.mark.parametrize("name", ["op1_quality_rules", "op6_decontamination", "op7_repeated_strings"])
def test_same_rows(spark, tmp_path, name, table):
    folder = SF
    if table != "given":
        folder = str(tmp_path)
        odd_tables(spark, folder)
        if table == "empty":
            spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{folder}/none/documents.parquet")
            spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{folder}/none/benchmark.parquet")
            folder = f"{folder}/none"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        files = f"{folder}/{t}.parquet" + ("" if table == "given" else "/*.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{files}'")
    got = registry.QUERIES[name](spark, folder)
    want = con.sql(registry.ORACLES[name])
    got, want = rows_of(got.columns, map(tuple, got.collect())), rows_of(want.columns, want.fetchall())
    assert got == want and (len(got[1]) > 0) == (table != "empty")


def test_preference(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    got, want = registry.QUERIES["op2_preference_format"](spark, SF), con.sql(registry.ORACLES["op2_preference_format"])
    assert rows_of(got.columns, map(tuple, got.collect())) == rows_of(want.columns, want.fetchall())
