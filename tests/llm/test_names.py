"""Extra columns, whatever their names, change no result; nulls in every column are rows like others."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paraqa.llm import classifier, decontam, mixing, quality, repeats, secrets, sharding, similar, simhash, tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
NAMES = ["id", "tie", "fp", "key", "node", "root", "rid", "copy", "anchor", "piece", "start", "n", "mark", "marks", "wanted", "size", "mass", "spot", "h", "k", "at", "rows", "copies", "row", "n_words", "base_failed", "signal", "bin", "n_symbols", "block", "rn", "before", "shard", "slot", "old_shard", "place", "first", "quality", "toxic", "words", "meta", "view", "label", "sure", "bytes", "frame", "offsets", "spans", "depth", "doc", "item_id", "target", "Text_", "stays"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(200)]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(3, 90))), rng.choice(["en", "de"]), rng.choice(["s1", "s2"]), 5) for k in range(60)]
    rows += [(60 + k, *rows[k][1:]) for k in range(8)] + [rows[2]] * 2
    rows += [(None, *rows[9][1:]), (90, None, "en", "s1", 1), (91, "x y z", None, "s1", 1), (92, words[0] * 200, "en", None, None), (93, "", None, None, None), (None, None, None, None, None)]
    plain = spark.createDataFrame(rows, DOCS).repartition(3).cache()
    return plain, plain.withColumns({n: F.when(F.col("doc_id") % 3 > 0, F.lit(f"mine {n}")) for n in NAMES})


def written(docs, folder):
    import public_tokenizers

    tokens.write(docs, public_tokenizers.path("word_bpe_49k.json"), folder)
    return tokens.read(docs.sparkSession, folder)


def labels(spark):
    return spark.createDataFrame([(k, int(k % 3 > 0), int(k % 5 == 0)) for k in range(40)] + [(None, None, None)], "doc_id long, quality int, toxic int")


def items(spark, docs):
    return docs.where("doc_id < 3").select(F.col("doc_id").alias("item_id"), "text")


RUNS = {
    "quality": lambda spark, docs, folder: quality.judge(docs),
    "quality_filter": lambda spark, docs, folder: quality.filter_documents(docs),
    "mixing": lambda spark, docs, folder: mixing.mix(docs),
    "mixing_taken": lambda spark, docs, folder: mixing.taken(docs, mixing.mix(docs)),
    "tokens": lambda spark, docs, folder: written(docs, folder),
    "secrets": lambda spark, docs, folder: secrets.scan_documents(docs),
    "decontam": lambda spark, docs, folder: decontam.contaminated(docs, items(spark, docs)),
    "decontam_clean": lambda spark, docs, folder: decontam.clean(docs, items(spark, docs)),
    "repeats": lambda spark, docs, folder: repeats.repeats_removed(docs).drop("rid"),
    "simhash": lambda spark, docs, folder: simhash.near_duplicates(docs),
    "similar": lambda spark, docs, folder: similar.near_duplicates_removed(docs),
    "classifier": lambda spark, docs, folder: classifier.score(docs, classifier.train(docs, labels(spark))),
    "sharding": lambda spark, docs, folder: sharding.reshard(docs, sharding.by_source(), 12, lambda t: sharding.even(t, 4)),
}
#: These pass other columns through.
THROUGH = {"quality_filter", "mixing_taken", "decontam_clean", "similar", "sharding"}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_names_change_nothing(spark, tables, tmp_path, name):
    plain, odd = tables
    want, got = RUNS[name](spark, plain, str(tmp_path / "a")), RUNS[name](spark, odd, str(tmp_path / "b"))
    if name in THROUGH:
        assert got.columns[: len(odd.columns)] == odd.columns
        assert all(r[n] in (None, f"mine {n}") for r in got.collect() for n in NAMES)
        if name == "sharding":
            new = sharding.added_names(odd.columns)
            got = got.drop(*NAMES).withColumnsRenamed({v: k for k, v in new.items()})
        got = got.select(want.columns)
    assert Counter(map(repr, got.select(want.columns).collect())) == Counter(map(repr, want.collect()))
    assert want.columns == got.columns
