"""Scores from runs of up to five words against a plain model with dictionaries."""

import binascii
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tabulight.llm import lm_scoring

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "ra", "si", "to", "vu", "ze") for b in ("n", "ri", "st", "lum", "dor")]


def prose(seed, count):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(count))


def quantised(count):
    return int(lm_scoring.level(np.array([count]))[0])


def plain_scores(texts, train):
    """The model's definition, token by token, with exact counts before they are quantised."""
    tokens = [["<start>", *(t or "").lower().split(), "<end>"] for t in texts]
    counts = [Counter() for _ in range(5)]
    for i in train:
        for at in range(1, len(tokens[i])):
            for kind in range(5):
                if at - kind >= 0 and (kind or at):
                    counts[kind][tuple(tokens[i][at - kind : at + 1])] += 1
    total, kinds = sum(counts[0].values()), len(counts[0])
    value = lm_scoring.COUNTS

    def known(kind, run):
        count = counts[kind][run]
        return 0 if kind > 1 and count < 2 else quantised(count)

    def views(i, left_out):
        for at in range(1, len(tokens[i])):
            own = known(0, (tokens[i][at],))
            base = (max(value[own] - left_out, 0) + 0.5) / (total + 0.5 * (kinds + 1))
            steps = []
            for kind in range(1, 5):
                if at - kind < 0:
                    break
                before = tuple(tokens[i][at - kind : at])
                context = quantised(len(train)) if before == ("<start>",) else known(kind - 1, before)
                run = known(kind, (*before, tokens[i][at]))
                part = min(max(value[run] - left_out, 0) / max(value[context] - left_out, 1), 1) if context else 0.0
                steps.append((kind, context, part))
            yield base, steps

    share = {(1, c): 0.1 for c in range(len(value))}
    wins, times, seen = defaultdict(float), defaultdict(float), []
    for i in train:
        for base, steps in views(i, 1):
            best = base
            for kind, context, part in steps:
                if kind == 1:
                    seen.append((context, part, base))
                elif context:
                    times[kind, context] += 1
                    wins[kind, context] += part > 0 and part >= best
                best = max(best, part)
    for _ in range(30):
        sums, sizes = defaultdict(float), defaultdict(float)
        for context, part, base in seen:
            mixed = share[1, context] * part
            sums[context] += mixed / (mixed + (1 - share[1, context]) * base)
            sizes[context] += 1
        share = {(1, c): (sums[c] + 0.1) / (sizes[c] + 1) for c in range(len(value))}
    share |= {k: (wins[k] + 0.1) / (n + 1) for k, n in times.items()}
    out = []
    for i in range(len(texts)):
        score = 0.0
        for chance, steps in views(i, 0):
            for kind, context, part in steps:
                weight = share.get((kind, context), 0.0) if kind == 1 or context else 0.0
                chance = weight * part + (1 - weight) * chance
            score += np.log10(chance)
        out.append(score)
    return out


def test_scores_are_those_of_a_plain_model(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BITS_PER_ENTRY", 512)  # next to nothing is found that is not there
    common = prose(500, 12)
    texts = [prose(s, 25) + (" " + common + " " if s % 6 == 0 else " ") + prose(s + 900, 20) for s in range(60)]
    texts += [texts[4], texts[9].upper(), texts[11], None, "", "  ", "ka", "zzz unseen zzz", "a b", prose(77, 20_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in lm_scoring.lm_score(df.repartition(3)).collect()}
    train = [i for i in range(len(texts)) if binascii.crc32(str(i).encode()) % 5 != 1]
    expected = plain_scores(texts, train)
    for i, score in enumerate(expected):
        assert found[i]["score"] == pytest.approx(score, rel=1e-3), texts[i]
    gap = {i: (found[i]["score"] - found[i]["base_score"]) / found[i]["n_tokens"] for i in range(60) if i % 6 and i in train}
    twice = [i for i, j in ((4, 60), (9, 61), (11, 62)) if i in gap and j in train]
    assert twice and min(gap[i] for i in twice) > 2 * max(v for i, v in gap.items() if i not in (4, 9, 11))


def test_parts_of_the_filter_add_up(spark, monkeypatch):
    texts = [prose(s % 5, 60) + prose(s, 30) for s in range(40)] + [None, "", "x"]
    df = spark.createDataFrame([*enumerate(texts), (None, texts[0])], "doc_id long, text string")
    whole = {r["doc_id"]: r for r in lm_scoring.lm_score(df).collect()}
    monkeypatch.setattr(lm_scoring, "ROUND_BYTES", 1)  # every kind and shard is a part of its own
    assert {r["doc_id"]: r for r in lm_scoring.lm_score(df).collect()} == whole


def test_candidates_cover_every_repeated_run():
    rng = np.random.default_rng(3)
    edges = np.array([0, 9, 10, 12, 40])
    for low, kind in ((1, 2), (2, 3), (2, 4)):
        levels = rng.integers(0, 4, 40).astype(np.uint8)
        may = lm_scoring.repeatable(levels, low, kind, edges)
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            for at in range(start, end):
                inside = range(at - (kind - low), at + 1)
                assert may[at] == (at - start >= kind - 1 and all(levels[j] >= 2 for j in inside))


def test_packed_numbers_come_back():
    rng = np.random.default_rng(4)
    for top in (1, 255, 256, 2**40 - 1, 2**64 - 1):
        values = np.sort(rng.integers(0, top, 50, dtype=np.uint64, endpoint=True))
        assert lm_scoring.unpacked(lm_scoring.packed(values)).tolist() == values.tolist()
    assert lm_scoring.unpacked(lm_scoring.packed(values[:0])).tolist() == []
