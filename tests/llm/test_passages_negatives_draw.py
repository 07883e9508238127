"""Substring dedup, hard negatives and importance draws against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulight.llm import negatives, resampling, substrings

WORDS = [a + b for a in ("ka", "Lo", "mi", "né", "pu") for b in ("n", "ri", "ST", "lum")]
DOCS = "doc_id long, text string, kept string, spans string, copy string, hit string, n_words string, score string"


def frame(spark, texts, ids=None):
    """Rows with ids from 0 (or given), and columns whose names clash with those of the results."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "k", "s", "c", "h", "n", "x") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


def brute_kept(rows, size):
    """(id, words, removed, kept) of (id, text) rows, window by window."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (key, _), own in zip(rows, words, strict=True):
        for i in range(len(own) - size + 1):
            w = tuple(own[i : i + size])
            if key is not None:
                least[w] = min(least.get(w, key), key)
    out = []
    for (key, _), own in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(own) - size + 1):
            if key is not None and least[tuple(own[i : i + size])] < key:
                gone.update(range(i, i + size))
        out.append((key, len(own), len(gone), " ".join(w for i, w in enumerate(own) if i not in gone)))
    return sorted(out, key=repr)


def found_kept(df, size):
    return sorted(
        [(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substrings.remove_repeats(df, words=size).collect()],
        key=repr,
    )


@pytest.mark.parametrize("size", [1, 5, 12, 50])
def test_passages(spark, size):
    rng = random.Random(size)
    prose = lambda n, vocabulary=WORDS: [rng.choice(vocabulary) for _ in range(n)]
    passages = [prose(rng.randint(size, 3 * size + 20)) for _ in range(4)]
    texts = [None, "", " \n\t ", "one", "la " * (size + 3), "la  " * (3 * size), "ab cd " * size, "cd ab\n" * (2 * size)]
    for _ in range(25):
        parts = [prose(rng.randint(0, 2 * size))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages)[rng.randint(0, 3) :], prose(rng.randint(0, size))]
        texts.append("\x0b ".join(" ".join(p) for p in parts))
    texts += [texts[10], texts[10].upper(), texts[12] + " " + texts[9]]  # copies, and letters that differ in case only
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [*zip(ids, texts, strict=True), (ids[9], texts[9]), (ids[9], texts[14]), (None, texts[9])]
    assert found_kept(frame(spark, [t for _, t in rows], [i for i, _ in rows]), size) == brute_kept(rows, size)


def test_passages_of_an_empty_table_and_a_long_text(spark, monkeypatch):
    assert found_kept(frame(spark, []), 50) == []
    monkeypatch.setattr(substrings, "PART_BYTES", 5000)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    long = [rng.choice(vocabulary) for _ in range(60_000)]
    blank_free = "ß" * 50_000
    texts = [" ".join(long), " ".join(long[:30_000] + ["new"] + long[30_010:]), " ".join(long[100:160]), blank_free, blank_free]
    rows = list(enumerate(texts))
    assert found_kept(frame(spark, texts), 50) == brute_kept(rows, 50)


def test_symbols_of_equal_passages_agree():
    """What a window's symbols depend on lies in the window, so they are the same wherever it stands."""
    rng = np.random.default_rng(1)
    core = rng.integers(0, 6, 50)
    core[10:22] = 3
    seen = []
    for seed in range(40):
        around = np.random.default_rng(seed).integers(0, 6, 80)
        text = b" ".join(b"w%d" % w for w in np.concatenate((around[:40], core, around[40:])))
        parsed = substrings.Parsed([b"x", text], 50)
        inside = (parsed.low >= 41) & (parsed.high <= 91)
        seen.append((parsed.name[inside].tolist(), (parsed.low[inside] - 41).tolist()))
    assert len(seen[0][0]) > 0 and all(s == seen[0] for s in seen)


VECTORS = "vec_id long, embedding array<float>, label int, score string, place string, slots string, part string"


def brute_negatives(rows, positives, negatives_, percent, scale):
    fit = [
        (i, label, [math.floor(scale * x) for x in v]) for i, v, label in rows
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, label, v in [min(r for r in fit if r[0] == i) for i in sorted({r[0] for r in fit if r[0] % 4 == 0})]:
        score = lambda w: sum(x * y for x, y in zip(v, w))  # noqa: E731, B023
        others = [r for r in fit if r[0] != a and len(r[2]) == len(v)]
        best = sorted((-score(w), i) for i, own, w in others if own == label)[:positives]
        for minus, p in best:
            top = sorted((-score(w), i) for i, own, w in others if own != label and percent * -minus <= 100 * score(w) <= 100 * -minus)
            out += [(a, p, rank, i, -minus, -s) for rank, (s, i) in enumerate(top[:negatives_], 1)]
    return sorted(out)


@pytest.mark.parametrize("levels,block", [(2, 3), (50, 1000)])
def test_hard_negatives(spark, levels, block, monkeypatch):
    """Few levels make many ties, of scores and of positives; small blocks make several cells."""
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", block)
    monkeypatch.setattr(negatives, "CELL_ROWS", 40)
    monkeypatch.setattr(negatives, "ROWS_AT_ONCE", 16)
    rng = random.Random(levels)
    vector = lambda n: [rng.randint(-levels // 3, levels) / 16 for _ in range(n)]
    rows = [(i, vector(4 if i % 9 else 3), rng.randint(0, 2)) for i in range(150)]
    rows += [(200, None, 1), (204, [], 1), (208, [1.0, None, 0.0, 0.0], 1), (212, [float("nan")] * 4, 1), (216, [math.inf] * 4, 0)]
    rows += [(220, vector(4), None), (None, vector(4), 1), rows[8], rows[13], (240, [-1.0] * 4, 7), (241, [1.0] * 4, 7)]
    df = spark.createDataFrame([(*r, "x", "p", "s", "q") for r in rows], VECTORS)
    # the anchor's own scale is a power of two, so floor() sees what a float holds
    found = negatives.mine(df, F.col("vec_id") % 4 == 0, positives=3, negatives=2, percent=80, scale=16)
    assert sorted(tuple(r) for r in found.collect()) == brute_negatives(rows, 3, 2, 80, 16)
    assert negatives.mine(df.limit(0), F.col("vec_id") % 4 == 0).collect() == []


def brute_draw(rows, target, percent, runs, buckets, least):
    def features(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return [" ".join(w[i : i + n]) for n in range(1, runs + 1) for i in range(len(w) - n + 1)], len(w)

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for text in texts:
            for f in features(text)[0]:
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1.0) * (sum(s) + buckets) / ((a + 1.0) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    out, fit = [], []
    for key, text in rows:
        found, words = features(text)
        weight, score = sum(gain[bucket(f)] for f in found), None
        if key is not None:
            h = int(hashlib.sha256(f"2024:{key}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if words >= least:
                fit.append((-score, key, len(out)))
        out.append([key, len(found), weight, score, None])
    for rank, (_, _, at) in enumerate(sorted(fit)[: len(fit) * percent // 100], 1):
        out[at][4] = rank
    return sorted(map(tuple, out), key=lambda r: (repr(r[:4]), r[4] or 0))


@pytest.mark.parametrize("runs,buckets,percent", [(1, 10_000, 10), (3, 500, 40), (1, 7, 100)])
def test_draw(spark, runs, buckets, percent, monkeypatch):
    monkeypatch.setattr(resampling, "PIECE_BYTES", 40)
    rng = random.Random(runs)
    texts = [None, "", "-- !", "A-b\x7fc" * 30, "\x00é" * 25]
    texts += [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 60))) for _ in range(120)]
    rows = [*enumerate(texts), (7, texts[7]), (7, texts[7]), (9, texts[30]), (None, texts[8])]
    target = [texts[20], None, "kan KARI lost 7"]
    df = frame(spark, [t for _, t in rows], [i for i, _ in rows])
    goal = spark.createDataFrame([(1, t) for t in target], "score int, text string")
    found = resampling.resample(df, goal, percent=percent, runs=runs, buckets=buckets)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    plain = sorted((tuple(r) for r in found.collect()), key=lambda r: (repr(r[:4]), r[4] or 0))
    assert plain == brute_draw(rows, target, percent, runs, buckets, 20)
    assert resampling.resample(df.limit(0), goal).collect() == []


def test_a_wrong_bracket_is_widened(spark, monkeypatch):
    """Exact counts disprove a bracket that lacks the cutoff; ties straddle brackets of any width."""
    rows = spark.range(500).selectExpr("id", "id % 40 as score")
    monkeypatch.setattr(resampling, "SKETCH", 400)
    scores = sorted((r["score"] for r in rows.collect()), reverse=True)
    for wanted in (1, 13, 250, 500):
        least, above = resampling.cutoff(rows, wanted, 500)
        assert least == scores[wanted - 1] and above == sum(s > least for s in scores)
    asked, real = [], F.percentile_approx

    def wrong_at_first(column, shares, accuracy):
        asked.append(shares)
        return F.array(F.lit(39), F.lit(39)) if len(asked) == 1 else real(column, shares, accuracy)

    monkeypatch.setattr(F, "percentile_approx", wrong_at_first)
    assert resampling.cutoff(rows, 13, 500) == (38, 12)  # twelve rows have 39
    assert len(asked) == 2
