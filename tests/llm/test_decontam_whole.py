"""Every run that the decontamination rule counts is found."""

import numpy as np
import pytest

from paraqa.llm import decontam


def brute(equal, size):
    """Whether a stretch of 13 words, or all of a shorter item, has 80 % equal words."""
    if size < 13:
        return len(equal) == size and 10 * equal.sum() >= 8 * size
    sums = np.concatenate(([0], np.cumsum(equal)))
    return any(equal[a] and equal[z - 1] and 10 * (sums[z] - sums[a]) >= 8 * (z - a) for a in range(size) for z in range(a + 13, size + 1))


@pytest.mark.parametrize("size", [*range(5, 24), 33, 45])
def test_every_counted_run_is_found(size):
    rng = np.random.default_rng(size)
    item = [f"w{k}" for k in range(size)]
    block = decontam.Block([([1], " ".join(item)), ([2], "other " * 20)])
    hasher, both = decontam.Hasher(), set()
    for n in range(300):
        wrong = rng.choice(size, rng.integers(max(0, size // 5 - 1), size // 5 + 2), replace=False)
        text = ["x", "y", *(w if k not in wrong else f"z{k}" for k, w in enumerate(item)), "end"]
        want = brute(~np.isin(np.arange(size), wrong), size)
        assert (0 in block.matches(hasher(text))) == want, (n, sorted(wrong))
        both.add(want)
    assert True in both and (size > 22 or False in both)


def test_cases_of_the_review():
    for size, wrong in ((15, (3, 8, 9)), (20, (5, 8, 10, 15)), (15, (3, 7, 11)), (10, (4,)), (10, (0, 9))):
        item = [f"w{k}" for k in range(size)]
        text = " ".join(w if k not in wrong else "other" for k, w in enumerate(item))
        assert decontam.Block([([1], " ".join(item))]).matches(decontam.Hasher()(decontam.words(f"a {text} b"))), (size, wrong)


def brute_query(docs, items):
    """(doc_id, item_id) by comparing every diagonal of every pair."""
    got = set()
    for doc_id, text in docs:
        a = decontam.words(text)
        for item_id, item in items:
            b = decontam.words(item)
            if len(b) < 5:
                continue
            for d in range(-len(b) + 1, len(a)):
                low, high = max(0, d), min(len(a), d + len(b))
                equal = np.array([a[k] == b[k - d] for k in range(low, high)])
                if len(b) < 13:
                    hit = len(equal) == len(b) and 10 * equal.sum() >= 8 * len(b)
                else:
                    sums = np.concatenate(([0], np.cumsum(equal)))
                    hit = any(equal[s] and equal[e - 1] and 10 * (sums[e] - sums[s]) >= 8 * (e - s) for s in range(len(equal)) for e in range(s + 13, len(equal) + 1))
                if hit:
                    got.add((doc_id, item_id))
                    break
    return got


@pytest.mark.parametrize("size", [40, 200_000])
def test_whole_query_against_brute_force(spark, size):
    """Substitutions, insertions, pieces of items, common words, in several blocks and in one."""
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(vocabulary, rng.integers(4, 32)))) for k in range(14)]
    docs = [(None, items[0][1]), (0, None), (1, ""), (2, items[3][1].upper().replace(" ", ", "))]
    for k in range(3, 90):
        words = items[int(rng.integers(0, 14))][1].split()
        for _ in range(int(rng.integers(0, 5))):
            at = int(rng.integers(0, len(words)))
            if rng.random() < 0.7:
                words[at] = str(rng.choice(vocabulary))
            else:
                words.insert(at, "more")
        a = int(rng.integers(0, 4))
        docs.append((k, " ".join([*rng.choice(vocabulary, rng.integers(0, 12)), *words[a:], *rng.choice(vocabulary, rng.integers(0, 12))])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([*items, (99, items[5][1]), (98, None)], "item_id long, text string")
    want = brute_query(docs, [*items, (99, items[5][1])])
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(df, bench, size).collect()}
    assert got == want and len(want) > 20
    clean = {r.doc_id for r in decontam.clean(df.where("doc_id is not null"), bench, size).collect()}
    assert clean == {d for d, _ in docs if d is not None} - {d for d, _ in want} and clean


def test_scripts_without_blanks(spark):
    item = "在实验中样品被加热到三百度并保持十二分钟然后缓慢冷却至室温后进行测量"
    changed = item.replace("三百", "五百").replace("测量", "分析")
    docs = [(0, f"前言{item}结束"), (1, f"说明:{changed}。"), (2, "今天天气很好我们一起去公园散步吧大家都很高兴"), (3, "これは試験です" + "ひらがなカタカナの文がここにありますよ")]
    bench = [(0, item), (1, "ひらがなカタカナの文がここにあります")]
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got == {(0, 0), (1, 0), (3, 1)}
    short = spark.createDataFrame([(7, "two words")], "item_id long, text string")
    df = spark.createDataFrame([(0, "just two words here"), (1, "words two")], "doc_id long, text string")
    assert decontam.contaminated(df, short).count() == 0
    assert [(r.doc_id, r.n_words) for r in decontam.contaminated(df, short, shortest=1).collect()] == [(0, 2)]
