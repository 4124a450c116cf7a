"""Groups are judged by their own distribution, whatever their size."""

import random

import pytest

from paraqa.llm import quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n=80, letters="abcdefgh"):
    return " ".join("".join(rng.choices(letters, k=rng.randint(3, 7))) for _ in range(n))


def kept(spark, rows):
    df = spark.createDataFrame([(k, text, lang, source, 1) for k, (text, lang, source) in enumerate(rows)], DOCS)
    return {r.doc_id for r in quality.judge(df).collect() if r.kept}


@pytest.mark.parametrize("n", [20, 150, 199, 200])
def test_small_groups_keep_their_own_kind(spark, n):
    rng = random.Random(n)
    rows = [(prose(rng), "en", "web") for _ in range(300)]
    rows += [(" ".join(w + rng.choice(["", "|", "<>", "&&"]) for w in prose(rng).split()), "en", "code") for _ in range(n)]
    rows += [(" ".join("".join(rng.choices("的一是不了人我在有他", k=30)) for _ in range(20)), "zh", "web") for _ in range(n)]
    assert kept(spark, rows) == set(range(len(rows)))


def test_small_groups_reject_their_outlier(spark):
    rng = random.Random(1)
    rows = [(prose(rng), "en", "web") for _ in range(300)] + [(prose(rng), "de", "web") for _ in range(20)]
    rows.append((" ".join(w + "###" for w in prose(rng).split()), "de", "web"))
    assert kept(spark, rows) == set(range(320))


def test_each_signal_rejects_its_outlier(spark):
    rng = random.Random(4)
    lines = lambda: "\n".join(prose(rng, 8) for _ in range(10))
    again = prose(rng, 40)  # a passage that stands there twice, in a text of 500 words
    outliers = {
        "symbols": lines().replace(" ", "## "),
        "dup_lines": "\nx\n".join(lines().split("\n")) + "\nx",
        "repeats": f"{prose(rng, 210)} {again} {prose(rng, 210)} {again}",
        "long_words": " ".join("".join(rng.choices("abcdefgh", k=30)) for _ in range(80)),
        "short_words": " ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=80)),
    }
    assert set(outliers) == set(quality.SIGNALS)
    rows = [(lines(), "en", "s") for _ in range(250)] + [(t, "en", "s") for t in outliers.values()]
    df = spark.createDataFrame([(k, *r, 1) for k, r in enumerate(rows)], DOCS)
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    assert not any(r.base_failed for r in got.values())
    assert {k for k, r in got.items() if r.kept} == set(range(250))


def low(v):
    """The least value of v's bin: itself below 32, then 16 to an octave."""
    shift = max(0, v.bit_length() - 5)
    return v >> shift << shift


def brute_kept(rows):
    """Decisions by exact quantiles, rounded as the sketch rounds."""
    import math

    from tests.llm.test_llm import brute_signals

    out, groups = {}, {}
    for k, (text, lang, source) in enumerate(rows):
        n, chars, symbols, dups, repeats = brute_signals(text)
        n_lines = sum(bool(x.strip(" \t\n\r\x0b\x0c")) for x in (text or "").split("\n"))
        out[k] = False
        if n >= 10 and 100 * repeats <= 20 * n:
            groups.setdefault((lang, source), []).append((k, n, n_lines, symbols, dups, repeats, chars))
    for members in groups.values():
        at = lambda values, q: sorted(map(low, values))[math.ceil(q * len(values)) - 1]
        for k, *_ in members:
            out[k] = True
        for col, of, event in ((3, 1, 1), (4, 2, 1), (5, 1, 10)):
            q1, q3 = (at([1000 * m[col] // max(m[of], 1) for m in members], q) for q in (0.25, 0.75))
            for m in members:
                e = (q3 + 3 * (q3 - q1)) * m[of] / 1000
                out[m[0]] &= m[col] <= e + 6 * (math.sqrt(event * e) + event)
        q1, q3 = (at([1000 * m[6] // m[1] for m in members], q) for q in (0.25, 0.75))
        for m in members:
            length, chance = 1000 * m[6] // m[1], 6 * q3 / 2 / math.sqrt(m[1])
            out[m[0]] &= q1 - 3 * (q3 - q1) - chance <= length <= q3 + 3 * (q3 - q1) + chance
    return {k for k, v in out.items() if v}


def test_decisions_against_exact_quantiles(spark):
    rng = random.Random(8)
    rows = []
    for source, rate in (("calm", 0.01), ("loud", 0.1), (None, 0.3)):
        for lang in ("en", None):
            for _ in range(rng.choice([7, 60])):
                words = prose(rng, rng.randint(5, 300)).split()
                words = [w + ("#" if rng.random() < rate * rng.choice([0.5, 1, 1, 1, 9]) else "") for w in words]
                text = " ".join(words).replace(" b", "\nb")
                rows.append((text + (" " + text[: rng.randint(0, 150)] if rng.random() < 0.2 else "") + "\nend" * rng.choice([0, 0, 0, 12]), lang, source))
    rows += [(None, "en", "calm"), ("", None, None), *rows[:5]]
    want = brute_kept(rows)
    assert kept(spark, rows) == want and 0 < len(want) < len(rows) - 10


def test_limits_follow_the_rates_of_their_source(spark):
    rng = random.Random(5)
    marked = lambda rate: " ".join(w + ("#" if rng.random() < rate else "") for w in prose(rng, 400).split())
    rows = [(marked(0.02), "en", "calm") for _ in range(60)] + [(marked(0.2), "en", "loud") for _ in range(60)]
    rows += [(marked(0.2), "en", "calm"), (marked(0.9), "en", "loud")]
    assert kept(spark, rows) == set(range(120))
    df = spark.createDataFrame([(k, *r, 1) for k, r in enumerate(rows)], DOCS)
    limits = {r.source: r.limit_symbols for r in quality.judge(df).select("source", "limit_symbols").distinct().collect()}
    assert limits["loud"] > 4 * limits["calm"] > 0


def test_planted_junk_and_clean_documents():
    """By the labels of a test table: nearly all junk is caught, hardly any clean document that the base rules keep goes."""
    import duckdb

    docs = duckdb.sql("select doc_id, text, lang, source from '/root/testdata/sf0.01/documents.parquet' order by doc_id").fetchall()
    good = dict(duckdb.sql("select doc_id, min(quality) from '/root/testdata/sf0.01/labels.parquet' group by 1").fetchall())
    left = brute_kept([r[1:] for r in docs])
    base = {k for k, r in enumerate(docs) if quality.signals((r[1] or "").encode())[0] >= 10 and 5 * quality.signals((r[1] or "").encode())[4] <= quality.signals((r[1] or "").encode())[0]}
    clean = [k for k in base if good.get(docs[k][0]) == 1]
    junk = [k for k, r in enumerate(docs) if good.get(r[0]) == 0]
    assert sum(k in left for k in clean) >= 0.99 * len(clean) and sum(k not in left for k in junk) >= 0.9 * len(junk)
