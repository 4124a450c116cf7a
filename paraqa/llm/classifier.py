"""Quality and toxicity by co-training.

Two views of a document: its text (the set of its words, the marks around them, how often words repeat at once) and its
page's metadata (language, source, length, number and length of lines, shares of capitals, digits, punctuation, symbols and
other scripts; no words). A logistic classifier for each view is fitted on labelled documents and calibrated on others that
were never fitted on. In each round both views score all documents without a label, in one distributed pass; the EXCHANGED
documents of each class that a view is surest of (no more than the class has labels), by rank and whatever its level, become
pseudo-labelled examples for the other view. These count as much as their calibrated probability is away from even odds, times the view's skill: the share
of the uncertainty about held-out rows that it takes away, so a view that knows nothing of a target teaches nothing. In the end both views' log odds
are added less those of the prior, and all documents are scored. The corpus is read once for the labels, once a round and
once for the scores; what a round's candidates need for the fit comes with them.

Fitting is on bounded samples, the documented parameters LABELLED, EXCHANGED and MOST_FEATURES; scoring covers every
document and all its features.

Nulls: a null text is empty, null metadata is a value of its own, a null doc_id has no label. Several labels of a document
count as the worst one (least quality, most toxic); null labels are none. Repeated rows are scored one by one. Without
labels of both classes a view says the prior, one half if there is none. Empty tables give empty results. Columns other
than doc_id, text, lang, source and n_chars aren't read.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import as_bytes, batch, documents, staged

TARGETS = ("quality", "toxic")
#: At most so many labelled documents, chosen by hash; one in HELD of them is kept for calibration.
LABELLED, HELD = 12_000, 4
#: Rounds, and pseudo-labels a round, view, target and class: the most confident ones.
ROUNDS, EXCHANGED = 2, 250
#: Features of a document that takes part in a fit: those of the least numbers, which are hashes.
MOST_FEATURES = 4096
#: Hashed features of a view; features that a fit may use, and how far in standard errors its classes must differ there.
DIMENSIONS, MOST_USED, LEAST_Z, LEAST_DOCS = 1 << 20, 3000, 3.0, 3
#: Distinct words whose features a worker keeps at hand; beyond, it starts anew.
MOST_WORDS = 500_000
#: A document is kept if it is as likely as not to be good, and not toxic.
KEEP = 0.5


def feature(kind: str, value: bytes) -> int:
    return xxhash.xxh64_intdigest(kind.encode() + b":" + value, 9) % DIMENSIONS


known_feature = lru_cache(1 << 16)(feature)  # of kinds that have few values

MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LETTERS_ONLY = feature("marks", b"_")


class TextView(dict):
    """Features of a text: of each distinct word its letters and its marks, and how often a word repeats the last one.

    A dictionary of the words' numbers, new ones are numbered when they are asked for; two places of `flat` have a word's
    features.
    """

    def __init__(self):
        super().__init__()
        self.flat = array("i", bytes(1 << 16))

    def __missing__(self, word: bytes) -> int:
        number = len(self)
        if 2 * number == len(self.flat):
            self.flat.extend(self.flat)
        if word.isalpha():
            core, marks = word, LETTERS_ONLY
        else:
            core = word.strip(MARKS)
            marks = known_feature("marks", word.replace(core, b"_", 1) if core else word)
        self.flat[2 * number], self.flat[2 * number + 1] = xxhash.xxh64_intdigest(core, 10) % DIMENSIONS, marks
        self[word] = number
        return number

    def __call__(self, raw: bytes) -> np.ndarray:
        if len(self) > MOST_WORDS:
            self.clear()
        words = raw.lower().split()
        distinct = set(words)
        again = 100 * sum(map(eq, words, words[1:])) // max(1, len(words))
        numbers = np.fromiter(map(self.__getitem__, distinct), np.int64, len(distinct))
        found = np.empty(2 * len(numbers) + 1, np.int32)
        flat = np.frombuffer(self.flat, np.int32)
        found[0:-1:2], found[1::2], found[-1] = flat[2 * numbers], flat[2 * numbers + 1], known_feature("again", b"%d" % again.bit_length())
        found.sort()
        return found[np.append(True, found[1:] != found[:-1])]


_VIEW = TextView()  # one for each worker process: later tasks find the words of earlier ones


#: Kinds of bytes that the metadata view counts.
KINDS = {"lines": b"\n", "capitals": bytes(range(65, 91)), "digits": bytes(range(48, 58)), "punctuation": b".,;:!?'\"()-", "symbols": b"#*$%&|<>@[]{}=+_/\\^~`", "scripts": bytes(range(128, 256))}


def meta_features(lang: str | None, source: str | None, n_chars: int | None, raw: bytes) -> np.ndarray:
    """Shares are taken by powers of two of a thousandth."""
    found = [known_feature("lang", repr(lang).encode()), known_feature("source", repr(source).encode()), known_feature("chars", b"%d" % n_chars.bit_length() if n_chars is not None else b"none")]
    size = max(1, len(raw))
    for kind, those in KINDS.items():
        n = len(raw) - len(raw.translate(None, those))
        found.append(known_feature(kind, b"%d" % (1000 * n // size).bit_length()))
        if kind == "lines":
            found += [known_feature("n_lines", b"%d" % n.bit_length()), known_feature("line", b"%d" % (size // (n + 1)).bit_length())]
    return np.array(found, np.int32)


class Fit:
    """Logistic regression over the features of rows (arrays of feature numbers) that tell the classes apart."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray | None = None, steps: int = 150, l2: float = 1e-3):
        self.weights, self.bias, self.scale, self.shift = np.zeros(DIMENSIONS, np.float32), 0.0, 1.0, 0.0
        self.skill = 0.0  # share of the uncertainty about held-out rows that the view takes away
        y = np.asarray(y, np.float64)
        weight = np.ones(len(y)) if weight is None else np.asarray(weight, np.float64)
        n1, n0 = float((weight * y).sum()), float((weight * (1 - y)).sum())
        self.prior = float((n1 + 1) / (n1 + n0 + 2))
        self.bias = float(np.log(self.prior / (1 - self.prior)))
        if min(n1, n0) < 1e-9:
            return
        flat, of = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        with1 = np.bincount(flat, weights=(weight * y)[of], minlength=DIMENSIONS)
        with0 = np.bincount(flat, weights=weight[of], minlength=DIMENSIONS) - with1
        p = (with1 + with0 + 1) / (n1 + n0 + 2)
        z = np.abs(with1 / n1 - with0 / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
        z[with1 + with0 < LEAST_DOCS] = 0
        used = np.argsort(-z, kind="stable")[:MOST_USED]
        used = used[z[used] >= LEAST_Z]
        if not len(used):
            return
        place = np.full(DIMENSIONS, -1, np.int32)
        place[used] = np.arange(len(used))
        kept = place[flat] >= 0
        col, of = place[flat[kept]], of[kept]
        w, b, gw, gb = np.zeros(len(used)), self.bias, np.full(len(used), 1e-8), 1e-8
        for _ in range(steps):  # AdaGrad
            e = 1 / (1 + np.exp(-np.clip(np.bincount(of, weights=w[col], minlength=len(y)) + b, -30, 30))) - y
            e *= weight
            g, h = np.bincount(col, weights=e[of], minlength=len(used)) / (n1 + n0) + l2 * w, float(e.sum() / (n1 + n0))
            gw, gb = gw + g * g, gb + h * h
            w, b = w - 0.5 * g / np.sqrt(gw), b - 0.5 * h / np.sqrt(gb)
        self.weights[used], self.bias = w, b

    def raw(self, row: np.ndarray) -> float:
        return float(self.weights[row].sum(dtype=np.float64) + self.bias)

    def calibrate(self, rows: list[np.ndarray], y: np.ndarray) -> None:
        """Platt's scaling: log odds become scale * raw + shift, fitted on held-out rows by Newton's method."""
        y = np.asarray(y, np.float64)
        if not y.sum() or y.all():
            return
        x = np.array([self.raw(r) for r in rows])
        t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        features, a = np.stack((x, np.ones_like(x))), np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ features, -30, 30)))
            step = np.linalg.solve((features * (p * (1 - p))) @ features.T + 1e-3 * np.eye(2), features @ (p - t) + 1e-3 * (a - [1.0, 0.0]))
            a = a - np.clip(step, -1, 1)
        self.scale, self.shift = float(max(a[0], 0.0)), float(a[1])
        loss = lambda p: float(-np.mean(np.where(y > 0, np.log(p), np.log(1 - p))))
        chance = (y.sum() + 1) / (len(y) + 2)
        self.skill = max(0.0, 1 - loss(1 / (1 + np.exp(-np.clip(self.scale * x + self.shift, -30, 30)))) / loss(np.full(len(y), chance)))

    def log_odds(self, row: np.ndarray) -> float:
        return max(-30.0, min(30.0, self.scale * self.raw(row) + self.shift))


class Model:
    """fits: by target, the two views. prior: log odds by target."""

    def __init__(self, fits: dict[str, tuple[Fit, Fit]], prior: dict[str, float]):
        self.fits, self.prior = fits, prior

    def views(self, target: str, text: np.ndarray, meta: np.ndarray) -> tuple[float, float]:
        a, b = self.fits[target]
        return a.log_odds(text), b.log_odds(meta)


def probability(log_odds: float) -> float:
    return 1 / (1 + float(np.exp(-log_odds)))


def _rows(docs: DataFrame) -> DataFrame:
    """What both views need of a document; `spot` orders documents by hash."""
    doc_id = F.col("doc_id").cast("long")
    return as_bytes(docs, doc_id.alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"), F.xxhash64(F.lit(5), doc_id, F.octet_length("text")).alias("spot"))


def _features(b: pa.RecordBatch, view: TextView) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    metas = zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("n_chars").to_pylist(), strict=True)
    for k, (text, meta) in enumerate(zip(b.column("text"), metas, strict=True)):
        raw = text.as_py()
        yield k, view(raw), meta_features(*meta, raw)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    view = _VIEW
    for b in batches:
        text, meta = [], []
        for _, t, m in _features(b, view):
            text.append(t[:MOST_FEATURES]), meta.append(m)
        yield pa.RecordBatch.from_arrays([b.column("spot"), *(b.column(t) for t in TARGETS), pa.array(text, pa.list_(pa.int32())), pa.array(meta, pa.list_(pa.int32()))], names=["spot", *TARGETS, "words", "meta"])


def worst(labels: DataFrame) -> DataFrame:
    """One row for each doc_id."""
    return labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"), F.max(F.col("toxic").cast("int")).alias("toxic"))


def sampled(labels: DataFrame) -> DataFrame:
    """About LABELLED labels, thinned by hash, before they meet any text: small enough to broadcast whatever their number."""
    some = worst(labels)
    step = max(1, -(-some.count() // LABELLED))
    return some.where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(step)) == 0).limit(2 * LABELLED)


def labelled(docs: DataFrame, some: DataFrame) -> list:
    """At most LABELLED rows: spot, targets, features of both views."""
    rows = _rows(docs).join(F.broadcast(some), "doc_id")
    got = rows.select("spot", *TARGETS, "lang", "source", "n_chars", "text").mapInArrow(_extract, "spot long, quality int, toxic int, words array<int>, meta array<int>")
    return got.orderBy("spot", "words").limit(LABELLED).collect()


CONFIDENT = pa.schema([("target", pa.string()), ("view", pa.int32()), ("label", pa.int32()), ("sure", pa.float64()), ("spot", pa.int64()), ("words", pa.list_(pa.int32())), ("meta", pa.list_(pa.int32()))])
CONFIDENT_DDL = "target string, view int, label int, sure double, spot long, words array<int>, meta array<int>"


def _confident(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, view = shared.value, _VIEW
        best: dict[tuple[str, int, int], list[tuple[float, int, np.ndarray, np.ndarray]]] = {}
        for b in batches:
            spots = b.column("spot").to_pylist()
            for k, text, meta in _features(b, view):
                for target in TARGETS:
                    for v, x in enumerate(model.views(target, text, meta)):
                        best.setdefault((target, v, int(x > 0)), []).append((-abs(x), spots[k], text, meta))
            for key, found in best.items():  # a task puts out no more than the round may exchange
                best[key] = sorted(found, key=lambda x: x[:2])[:EXCHANGED]
        out = [(*key, -x, spot, text[:MOST_FEATURES], meta) for key, found in best.items() for x, spot, text, meta in found]
        yield batch(CONFIDENT, **dict(zip(CONFIDENT.names, zip(*out, strict=True) if out else [[]] * 7, strict=True)))

    return run


#: The most confident of all tasks are found in so many parts by class first; the driver gets those of each part.
PARTS = 16

Examples = dict[tuple[str, int], list[tuple[np.ndarray, int, float]]]


def exchanged(docs: DataFrame, some: DataFrame, model: Model, quota: dict[tuple[str, int], int]) -> Examples:
    """By target and view, the examples that the other view is surest of: (features, label, weight). quota: how many of a
    target and class at most, EXCHANGED or less."""
    spark, key = docs.sparkSession, ["target", "view", "label"]
    rest = _rows(docs).join(F.broadcast(some.select("doc_id")), "doc_id", "left_anti")
    found = staged(rest.mapInArrow(_confident(spark.sparkContext.broadcast(model)), CONFIDENT_DDL), "classifier-confident")
    rank = F.row_number().over(Window.partitionBy(*key, "part").orderBy(F.desc("sure"), "spot"))
    ranked = found.select(*key, "sure", "spot").withColumn("part", F.pmod("spot", F.lit(PARTS))).withColumn("rank", rank)
    rows = ranked.where(F.col("rank") <= EXCHANGED).select(*key, "sure", "spot").collect()  # 8 * PARTS * EXCHANGED at most
    picked: dict[tuple[str, int, int], dict[int, float]] = {}
    for r in sorted(rows, key=lambda r: (-r.sure, r.spot)):
        spots = picked.setdefault((r.target, r.view, r.label), {})
        if len(spots) < quota[r.target, r.label] and r.spot not in spots:
            spots[r.spot] = (2 * probability(r.sure) - 1) * model.fits[r.target][r.view].skill
    out: Examples = {(t, v): [] for t in TARGETS for v in (0, 1)}
    if not picked:
        return out
    wanted = spark.createDataFrame([(x,) for x in sorted({x for spots in picked.values() for x in spots})], "spot long")  # 8 * EXCHANGED at most
    got = found.join(F.broadcast(wanted), "spot", "left_semi").select("spot", "words", "meta").dropDuplicates(["spot"]).collect()
    features = {r.spot: (np.array(r.words, np.int32), np.array(r.meta, np.int32)) for r in got}
    for (target, view, label), spots in picked.items():
        out[target, 1 - view] += [(features[x][1 - view], label, weight) for x, weight in spots.items() if weight > 0]
    return out


def train(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> Model:
    some = staged(sampled(labels), "classifier-labels")
    rows = labelled(docs, some)
    arrays = [(r.spot, {t: r[t] for t in TARGETS}, np.array(r.words, np.int32), np.array(r.meta, np.int32)) for r in rows]
    fit, held = [r for r in arrays if r[0] % HELD], [r for r in arrays if not r[0] % HELD]
    extra: Examples = {(t, v): [] for t in TARGETS for v in (0, 1)}

    def fitted() -> Model:
        fits, prior = {}, {}
        for t in TARGETS:
            both = []
            for v in (0, 1):
                own = [(r[2 + v], r[1][t], 1.0) for r in fit if r[1][t] is not None] + extra[t, v]
                view = Fit([x for x, _, _ in own], np.array([y for _, y, _ in own]), np.array([w for _, _, w in own]))
                view.calibrate([r[2 + v] for r in held if r[1][t] is not None], np.array([r[1][t] for r in held if r[1][t] is not None]))
                both.append(view)
            known = [r[1][t] for r in arrays if r[1][t] is not None]
            p = (sum(known) + 1) / (len(known) + 2)
            fits[t], prior[t] = tuple(both), float(np.log(p / (1 - p)))
        return Model(fits, prior)

    # a view gets no more pseudo-labels of a class than there are labels, or their errors would outweigh what is known
    quota = {(t, y): min(EXCHANGED, sum(r[1][t] == y for r in fit)) for t in TARGETS for y in (0, 1)}
    model = fitted()
    for _ in range(rounds):
        extra = exchanged(docs, some, model, quota)
        model = fitted()
    return model


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, view = shared.value, _VIEW
        for b in batches:
            out: list[tuple[float, ...]] = []
            for _, text, meta in _features(b, view):
                row: list[float] = []
                for t in TARGETS:
                    a, m = model.views(t, text, meta)
                    row += [probability(a + m - model.prior[t]), probability(a), probability(m)]
                out.append(tuple(row))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(list(c), pa.float64()) for c in columns)], names=["doc_id", *(f"{t}{x}" for t in TARGETS for x in ("", "_text", "_meta"))])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, the two probabilities, those of each view, and kept, for each row of docs; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = _rows(docs).select("doc_id", "lang", "source", "n_chars", "text").mapInArrow(_score(shared), "doc_id long, " + ", ".join(f"{t}{x} double" for t in TARGETS for x in ("", "_text", "_meta")))
    return rows.withColumn("kept", (F.col("quality") >= KEEP) & (F.col("toxic") < KEEP))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
