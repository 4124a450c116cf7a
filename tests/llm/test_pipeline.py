"""The pipeline as a whole, and the entry without it."""

import random
import shutil
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_decontam_whole import brute_query
from tests.llm.test_quality_groups import brute_kept
from tests.llm.test_similar import brute as brute_groups

ROOT, SF = Path(__file__).resolve().parents[2], "/root/testdata/sf0.001"


def test_stages(spark):
    docs = corpus_pipeline.documents(spark, SF)
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, SF), name)
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids and (before is None or ids <= before)
        assert docs.columns == columns or name == "sharding"
        before = ids
    assert docs.count() == corpus_pipeline.run(spark, SF).count()


def odd_corpus(spark, folder):
    """Nulls in every column, empty and long texts, repeated rows, near copies, leaks, junk, extra columns with odd names."""
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    items = [(k, prose(25)) for k in range(4)] + [(9, None), (10, "")]
    rows = [[k, prose(rng.randint(20, 300)), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", None])] for k in range(120)]
    for k in range(10):
        near = rows[k][1].split()
        near[len(near) // 2] = "other"
        rows.append([200 + k, " ".join(near), *rows[k][2:]])
    rows += [[300 + k, f"{prose(20)} {items[k][1]} {prose(20)}", "en", "s1"] for k in range(4)]
    rows += [[400 + k, " ".join(w + "###" for w in prose(90).split()), "en", "s1"] for k in range(4)]
    rows += [[500, None, "en", "s1"], [501, "", None, None], [None, prose(60), "en", "s2"], [502, "same " * 500, "en", "s1"], [503, prose(9000), "en", "s2"], [504, prose(40), None, None]]
    rows += [list(rows[3]), list(rows[3]), [505, rows[4][1], "de", "s1"]]
    names = ["size", "shard", "slot", "row", "fp", "key", "node", "kept", "n_words", "copies"]
    df = spark.createDataFrame([(*r, None if k % 3 else k) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    df = df.withColumns({n: F.concat(F.lit(f"mine {n} "), F.coalesce("doc_id", F.lit(-1))) for n in names})
    df.coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return df, rows, items


def test_decisions_against_brute_force(spark, tmp_path):
    """Up to the mixture each stage's decisions are those of a plain version; the mixture and the shards keep their rows."""
    df, rows, items = odd_corpus(spark, str(tmp_path))
    kept = sorted(brute_kept([(r[1], r[2], r[3]) for r in rows]), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    groups = brute_groups([rows[k][1] for k in kept])
    left = [kept[k] for k in sorted(set(groups))]
    leaks = brute_query([(k, rows[k][1]) for k in left], [i for i in items if i[1]])
    want = {rows[k][0] for k in left} - {rows[d][0] for d, _ in leaks}
    docs, seen = corpus_pipeline.documents(spark, str(tmp_path)), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, str(tmp_path)), name)
        seen[name] = docs.collect()
        if name != "sharding":
            assert docs.columns == df.columns
    assert sorted(map(repr, (r.doc_id for r in seen["quality"]))) == sorted(repr(rows[k][0]) for k in kept)
    assert {r.doc_id for r in seen["near_duplicates"]} == {rows[k][0] for k in left} and len(seen["near_duplicates"]) == len(left)
    assert {r.doc_id for r in seen["decontamination"]} == want and len(leaks) == 4
    assert {r.doc_id for r in seen["mixing"]} <= want
    assert all(r["size"] == f"mine size {-1 if r.doc_id is None else r.doc_id}" for r in seen["sharding"])
    mixed = Counter(r.doc_id for r in seen["mixing"])
    assert Counter(r.doc_id for r in seen["sharding"]) == mixed and max(mixed.values()) <= 3
    slots = defaultdict(list)
    for r in seen["sharding"]:
        slots[r.reshard_shard].append(r.reshard_slot)
        assert r.reshard_size == len(r.text.encode()) + 1 and r.text_crc32 == zlib.crc32(r.text.encode())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_empty_corpus(spark, tmp_path):
    df, *_ = odd_corpus(spark, str(tmp_path))
    df.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    spark.read.parquet(str(tmp_path / "benchmark.parquet")).write.parquet(str(tmp_path / "none/benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "none"))
    assert got.count() == 0 and got.columns[: len(df.columns)] == df.columns


def test_entry_without_the_folders(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'check_issues' in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, timeout=120)
