"""Near-duplicates by similarity against brute force, recall by the share of words that differ, odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paraqa.llm import similar

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, n=5):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(texts, similarity=0.8):
    """The least number of each one's group."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and jaccard(sets[i], sets[j]) >= similarity:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def replaced(rng, words, n):
    out = words.split()
    for k in rng.sample(range(len(out)), n):
        out[k] = "".join(rng.choices("qrstuvwxyz", k=6))
    return " ".join(out)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 7))) for _ in range(300)]
    base = [" ".join(rng.choices(vocabulary, k=rng.choice([3, 8, 40, 150, 300]))) for _ in range(60)]
    out = list(base)
    for t in base:
        n = len(t.split())
        out += [replaced(rng, t, rng.randint(0, max(1, n // 20))) for _ in range(rng.randint(0, 4))]
    chain = [base[3] if len(base[3].split()) > 100 else next(t for t in base if len(t.split()) > 100)]
    for _ in range(6):  # each is like the one before, the first and the last are not alike
        chain.append(replaced(rng, chain[-1], max(1, len(chain[-1].split()) // 60)))
    return [*out, *chain, *(t.upper() for t in base[:5]), "", " \n", "one", "one", "One  two", None, "é É", "é É", "x " * 20000]


@pytest.mark.parametrize("block,verified", [(4096, 512), (6, 4)])
def test_groups_against_brute_force(spark, texts, block, verified):
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    got = similar.groups(df, block=block, verified=verified).collect()
    first = {r.doc_id: r["first"].doc_id for r in got}
    assert [first[k] for k in range(len(texts))] == brute(texts)
    left = similar.near_duplicates_removed(df, block=block, verified=verified)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == sorted(set(brute(texts)))


def test_odd_rows(spark, texts):
    names = ["fp", "node", "root", "row", "tie", "stays", "rows", "key", "first"]
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(texts[:40])]
    rows += [rows[3], rows[3], (None, texts[0], None, None, None), (None, "only here", "en", "s", 1), (None, "only here", "en", "s", 1), (2, "second text of an id", "en", "s", 1), (2, None, "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumns({n: F.lit(f"mine {n}") for n in names})
    left = similar.near_duplicates_removed(df)
    got = left.collect()
    assert left.columns == df.columns and all(r.fp == "mine fp" and r.root == "mine root" for r in got)
    texts_left = [r.text for r in got]
    assert texts_left.count(rows[3][1]) == 1 and texts_left.count("only here") == 1 and "second text of an id" in texts_left and [r.doc_id for r in got if r.text == texts[0]] == [0]
    assert similar.near_duplicates_removed(df.limit(0)).count() == 0


def test_recall_by_share_of_words(spark):
    """Pairs with scattered words replaced, and with one passage replaced, by their similarity; figures are in the README."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 7))) for _ in range(5000)]
    rows, pairs = [], []
    for k in range(600):
        words = rng.choices(vocabulary, k=rng.choice([120, 250, 500]))
        other = list(words)
        if k % 2:
            for at in rng.sample(range(len(words)), rng.randint(1, len(words) // 45)):
                other[at] = "z" + rng.choice(vocabulary)
        else:
            n = rng.randint(1, len(words) // 10)
            at = rng.randrange(len(words) - n)
            other[at : at + n] = ["y" + w for w in rng.choices(vocabulary, k=n)]
        a, b = " ".join(words), " ".join(other)
        if (j := jaccard(shingles(a), shingles(b))) >= 0.8:
            pairs.append((len(rows), k % 2, j))
        rows += [(len(rows), a, "en", "s", 1), (len(rows) + 1, b, "en", "s", 1)]
    first = {r.doc_id: r["first"].doc_id for r in similar.groups(spark.createDataFrame(rows, DOCS)).collect()}
    found = {kind: np.mean([first[a + 1] == a for a, k, _ in pairs if k == kind]) for kind in (0, 1)}
    print("recall: scattered", found[1], "passage", found[0], "of", len(pairs))
    assert found[1] >= 0.97 and found[0] >= 0.85
    assert all(first[d] in (d, d - d % 2) for d in first)


def test_shared_keys_over_batches():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    for _ in range(50):
        key = np.sort(rng.integers(0, 30, rng.integers(1, 40)))
        cuts = np.sort(rng.integers(0, len(key) + 1, 4))
        batches = [pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["key", "node"]) for k, n in zip(np.split(key, cuts), np.split(np.arange(len(key)), cuts))]
        got = [x for b in similar._shared(iter(batches)) for x in b.column("node").to_pylist()]
        assert got == [n for n in range(len(key)) if (key == key[n]).sum() > 1]
        whole = [list(map(int, g[0])) for g in similar._groups(iter(batches), ("key", "node"), rows=4)]
        assert [k for g in whole for k in g] == key.tolist() and all(not set(a) & set(b) for a, b in zip(whole, whole[1:]))


def test_word_hashes_tell_words_apart(monkeypatch):
    rng = random.Random(1)
    words = ["".join(rng.choices("abé\u4e00", k=rng.randint(1, 5))) for _ in range(3000)] + ["a" * k for k in range(1, 400)]
    text = "".join(w.upper() + rng.choice([" ", "\n", "\t ", "  \r\n", "\x0b"]) for w in words).encode()
    h = similar.word_hashes(text)
    of = dict(zip([w.upper().encode().lower() for w in words], h.tolist()))
    assert len(h) == len(words) and h.tolist() == [of[w.upper().encode().lower()] for w in words] and len(set(of.values())) == len(of)
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(similar, "PIECE", size)
        assert similar.word_hashes(text).tolist() == h.tolist()
    assert len(similar.word_hashes(b"")) == len(similar.word_hashes(b" \n ")) == 0 and len(similar.word_hashes(b"x")) == 1
