"""Both views teach each other, and few labels go further for it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paraqa.llm import classifier

SF = "/root/testdata/sf0.1"


def auc(good, score):
    rank = np.empty(len(score))
    rank[np.argsort(score, kind="stable")] = np.arange(len(score))
    n1 = good.sum()
    return (rank[good].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(good) - n1))


@pytest.fixture(scope="module")
def rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(4).cache()
    yield docs, spark.read.parquet(f"{SF}/labels.parquet")
    docs.unpersist()


def test_exchange_gains(spark, rows, monkeypatch):
    docs, labels = rows
    few = labels.where("doc_id % 3 <> 0").where(F.pmod(F.xxhash64("doc_id"), F.lit(40)) == 0)
    held = labels.where("doc_id % 3 = 0").select("doc_id", F.col("quality").alias("good"))
    taught, real = [], classifier.exchanged
    monkeypatch.setattr(classifier, "exchanged", lambda *a: taught.append(real(*a)) or taught[-1])
    found = {}
    for rounds in (0, 2):
        got = classifier.score(docs, classifier.train(docs, few, rounds)).join(held, "doc_id").collect()
        good = np.array([r.good == 1 for r in got])
        found[rounds] = np.mean(good == np.array([r.quality >= 0.5 for r in got])), auc(good, np.array([r.quality_text for r in got]))
    assert len(taught) == 2
    for views in taught:  # each view teaches the other both classes
        assert all({y for _, y, _ in views["quality", v]} == {0, 1} for v in (0, 1))
        assert all(0 < w <= 1 for those in views.values() for _, _, w in those)
    assert found[2][0] > found[0][0] and found[2][1] > found[0][1] + 0.02, found


def test_a_view_without_skill_teaches_nothing(spark):
    rng = np.random.default_rng(3)
    y = rng.random(400) < 0.3
    noise = [np.array([int(x)], np.int32) for x in rng.integers(0, 5, 400)]
    signal = [np.array([int(x)], np.int32) for x in y]
    for features, skilled in ((noise, False), (signal, True)):
        fit = classifier.Fit(features[:200], y[:200])
        fit.calibrate(features[200:], y[200:])
        assert (fit.skill > 0.5) == skilled and 0 <= fit.skill <= 1 and (skilled or fit.skill < 0.05)
