"""Language identification with interpolated Kneser-Ney character models.

A text becomes its lower-cased letters, every run of other characters one space. Each
language has an interpolated Kneser-Ney model over ORDER characters, fitted on a bounded
sample of whole texts. The models are stored as sorted hash arrays, one per order, with
a column of log probabilities for each language; a text takes the language with the
lowest cross-entropy per character, and is rejected when that is far above what the
language's own texts showed in calibration.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import arrow_filter, arrow_map, stage
from .sampling import bounded_sample, fold, held_out
from .words import mix, text_parts

ORDER = 5
SPACE = 32
SAMPLE_ROWS, SAMPLE_BYTES = 300, 2_000_000
PIECE = 1 << 17  # characters scored at once
STEP = np.uint64(0x9E3779B97F4A7C15)
_TABLES: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Lower-case code point of every letter, a space for all other characters."""
    if not _TABLES:
        table = np.full(0x110000, SPACE, np.uint32)
        for point in range(0x110000):
            char = chr(point)
            if char.isalpha():
                low = char.lower()
                table[point] = ord(low) if len(low) == 1 else point
        _TABLES.append(table)
    return _TABLES[0]


def letters(body: bytes | None) -> np.ndarray:
    """Code points of the normal form, with a space at either end; empty without letters."""
    if not body:
        return np.zeros(0, np.uint32)
    points = letter_table()[np.frombuffer(body.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)]
    solid = points != SPACE
    if not solid.any():
        return np.zeros(0, np.uint32)
    points = points[solid | np.concatenate(([True], solid[:-1]))]
    head = [] if points[0] == SPACE else [SPACE]
    tail = [] if points[-1] == SPACE else [SPACE]
    return np.concatenate((np.array(head, np.uint32), points, np.array(tail, np.uint32)))


def windows_hash(points: np.ndarray, ends: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order`` characters that end at each of ``ends``."""
    total = np.full(len(ends), np.uint64(order))
    for back in range(order - 1, -1, -1):
        total = total * STEP + points[ends - back] + np.uint64(1)
    return mix(total)


def padded(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts in one array, each after ORDER - 1 spaces; the scored positions and each text's count."""
    pad = np.full(ORDER - 1, SPACE, np.uint32)
    counts = np.array([max(0, len(t) - 1) for t in texts], np.int64)
    points = np.concatenate([part for t in texts for part in (pad, t)] or [pad])
    starts = np.cumsum([0] + [ORDER - 1 + len(t) for t in texts])[:-1] + ORDER
    total = int(counts.sum())
    first = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) if len(texts) else starts
    return points.astype(np.uint64), first + np.arange(total), counts


@dataclass
class Models:
    """Per order: sorted gram hashes, log p by language; sorted context hashes, log backoff weight by language."""

    languages: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    unknown: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def log_probs(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Natural log probability of each character, by language."""
        out = np.zeros((len(ends), len(self.languages)), np.float32)
        left = np.arange(len(ends))
        for order in range(ORDER, 0, -1):
            keys, values = self.grams[order - 1]
            hashes = windows_hash(points, ends[left], order)
            at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            found = keys[at] == hashes
            out[left[found]] += values[at[found]]
            left = left[~found]
            if not len(left):
                return out
            if order > 1:
                keys, values = self.contexts[order - 1]
                hashes = windows_hash(points, ends[left] - 1, order - 1)
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                found = keys[at] == hashes
                out[left[found]] += values[at[found]]
        out[left] += self.unknown
        return out

    def entropies(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per scored character by text and language (0 without any), and the counts."""
        points, ends, counts = padded(texts)
        sums = np.zeros((len(texts), len(self.languages)))
        owner = np.repeat(np.arange(len(texts)), counts)
        for start in range(0, len(ends), PIECE):
            part = slice(start, start + PIECE)
            values = self.log_probs(points, ends[part])
            first = np.flatnonzero(np.concatenate(([True], np.diff(owner[part]) > 0)))
            sums[owner[part][first]] += np.add.reduceat(values, first, axis=0, dtype=np.float64)
        return -sums / np.maximum(counts, 1)[:, None], counts


def distinct(points: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of ``points`` and the sum of their counts."""
    ends = np.full(len(points), points.shape[1] - 1)
    hashes = np.full(len(points), np.uint64(points.shape[1]))
    for back in range(points.shape[1]):
        hashes = hashes * STEP + points[np.arange(len(points)), ends * 0 + back].astype(np.uint64) + np.uint64(1)
    _, first, where = np.unique(mix(hashes), return_index=True, return_inverse=True)
    return points[first], np.bincount(where, weights=counts, minlength=len(first))


def row_hash(points: np.ndarray) -> np.ndarray:
    if not points.shape[1]:
        return np.zeros(len(points), np.uint64)
    flat = points.astype(np.uint64).ravel()
    return windows_hash(flat, np.arange(len(points)) * points.shape[1] + points.shape[1] - 1, points.shape[1])


def kneser_ney(points: np.ndarray, counts: np.ndarray, alphabet: int):
    """By order: (gram rows, share left after discount, gram's context hash), and context hash -> backoff weight."""
    by_order = [None] * (ORDER + 1)
    rows, weights = points, counts
    for order in range(ORDER, 0, -1):
        by_order[order] = (rows, weights)
        rows, weights = distinct(rows[:, 1:], np.ones(len(rows)))  # continuation counts
    grams, contexts = [], []
    for order in range(1, ORDER + 1):
        rows, weights = by_order[order]
        once, twice = (weights == 1).sum(), (weights == 2).sum()
        cut = once / (once + 2 * twice) if once else 0.5
        heads, where = np.unique(row_hash(rows[:, :-1]), return_inverse=True)
        total = np.bincount(where, weights=weights, minlength=len(heads))
        kinds = np.bincount(where, minlength=len(heads))
        grams.append((rows, np.maximum(weights - cut, 0) / total[where], row_hash(rows[:, :-1])))
        contexts.append((heads, cut * kinds / total))
    return grams, contexts


def fit(samples: dict[str, tuple[np.ndarray, np.ndarray]]) -> Models:
    """Models from each language's distinct ORDER-grams (rows of code points) and their counts."""
    languages = sorted(samples)
    alphabet = len(np.unique(np.concatenate([s[0][:, -1] for s in samples.values()]))) + 1
    parts = [kneser_ney(*samples[name], alphabet) for name in languages]
    grams, contexts = [], []
    unknown = np.zeros(len(languages))
    lower_keys, lower = None, None
    for order in range(ORDER):
        rows = np.concatenate([p[0][order][0] for p in parts])
        keys, first = np.unique(row_hash(rows), return_index=True)
        rows = rows[first]
        heads = np.unique(np.concatenate([p[1][order][0] for p in parts]))
        backoff = np.ones((len(heads), len(languages)))
        p = np.zeros((len(keys), len(languages)))
        for column, (own, own_heads) in enumerate((q[0][order], q[1][order]) for q in parts):
            backoff[np.searchsorted(heads, own_heads[0]), column] = own_heads[1]
            p[np.searchsorted(keys, row_hash(own[0])), column] = own[1]
        at_head = np.searchsorted(heads, row_hash(rows[:, :-1]))
        if order == 0:
            below = np.full((len(keys), len(languages)), 1 / alphabet)
            unknown = np.log(backoff[0] / alphabet)
        else:
            below = lower[np.searchsorted(lower_keys, row_hash(rows[:, 1:]))]
        p += backoff[at_head] * below
        lower_keys, lower = keys, p
        grams.append((keys, np.log(p).astype(np.float32)))
        contexts.append((heads, np.log(backoff).astype(np.float32)))
    size = len(languages)
    return Models(languages, grams, contexts, unknown.astype(np.float32), np.zeros(size), np.ones(size))


def sample_grams(chosen: DataFrame) -> DataFrame:
    """(lang, gram, times) over whole texts of (lang, body): grams as packed code points."""

    def make():
        def work(batch):
            langs, packed, times = [], [], []
            names = np.array(batch["lang"].to_pylist(), object)
            for name in np.unique(names.astype(str)):
                texts = [letters(batch["body"][int(i)].as_py()) for i in np.flatnonzero(names == name)]
                points, ends, _ = padded(texts)
                if not len(ends):
                    continue
                rows = np.stack([points[ends - back] for back in range(ORDER - 1, -1, -1)], axis=1).astype(np.uint32)
                rows, counts = distinct(rows, np.ones(len(rows)))
                langs += [name] * len(rows)
                packed += [r.tobytes() for r in rows]
                times += counts.astype(np.int64).tolist()
            return {"lang": langs, "gram": packed, "times": times}

        return work

    made = arrow_map(chosen.select("lang", "body"), make, "lang string, gram binary, times long")
    return made.groupBy("lang", "gram").agg(F.sum("times").alias("times"))


def train(
    df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
    sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, parts: int = 3,
) -> Models | None:
    """Models from rows with a language whose fold is not 1; None if there are none.

    ``sample_rows`` and ``sample_bytes`` bound the whole texts taken a language. A fifth
    of them is left out of the counts and gives each language's usual cross-entropy.
    """
    rows = df.filter(fold(key, parts) != 1).filter(F.col(lang).isNotNull() & (F.length(F.trim(text)) > 0))
    light = rows.select(
        F.col(key).cast("long").alias("id"), F.col(lang).alias("lang"), F.octet_length(text).cast("long").alias("size")
    )
    picked = stage(bounded_sample(light, "lang", sample_rows, sample_bytes))
    named = rows.select(
        F.col(key).cast("long").alias("id"), F.col(lang).alias("lang"), F.col(text).cast("binary").alias("body")
    )
    chosen = stage(named.join(F.broadcast(picked), ["id", "lang"], "left_semi").dropDuplicates(["id", "lang"]))
    apart = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(5)) == 0
    found = sample_grams(chosen.filter(~apart)).toArrow()
    if not found.num_rows:
        found = sample_grams(chosen).toArrow()
    if not found.num_rows:
        return None
    names = np.array(found["lang"].to_pylist(), object)
    rows = np.frombuffer(b"".join(found["gram"].to_pylist()), np.uint32).reshape(-1, ORDER)
    times = found["times"].to_numpy().astype(float)
    models = fit({name: (rows[names == name], times[names == name]) for name in sorted(set(names))})
    checked = chosen.filter(apart).select("lang", "body").toArrow()
    own = np.array(checked["lang"].to_pylist(), object)
    entropy, counts = models.entropies([letters(b) for b in checked["body"].to_pylist()])
    for column, name in enumerate(models.languages):
        mine = entropy[(own == name) & (counts > 0), column]
        models.mean[column] = mine.mean() if len(mine) else 2.5
        models.spread[column] = mine.std() if len(mine) > 1 else 0.5
    return models


def accepted(excess: np.ndarray, spread: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether a text's cross-entropy above its language's mean is still usual; short texts vary more."""
    return excess <= np.maximum(8 * spread, 1.0) + 30 / np.maximum(counts, 1)


def identify(df: DataFrame, models: Models | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, entropy, rejected) for each row of ``df``.

    A null text, or one without a letter, gets ``und``, score 0 and is rejected, as does
    every text if nothing could be learned. Else the language with the lowest
    cross-entropy a character wins, ties go to the name that sorts first. The score is
    its share of the languages' likelihoods over 20 characters. Rows with a null or
    repeated key are rows like others; other columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(models)

    def make():
        held = shared.value

        def work(batch):
            names, score, lowest, usual = judged(held, batch["body"].to_pylist())
            return {"id": batch["id"], "lang_pred": names, "score": score, "entropy": lowest, "rejected": ~usual}

        return work

    source = df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("body"))
    made = arrow_map(
        source, make, "id long, lang_pred string, score double, entropy double, rejected boolean"
    )
    return made.withColumnRenamed("id", key)


def judged(models: Models | None, bodies: list) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, cross-entropy and acceptance of each text; about PART_BYTES of text at once."""
    made = [judged_part(models, part) for part in text_parts(bodies)]
    names = [name for part in made for name in part[0]]
    return names, *(np.concatenate([part[i] for part in made]) for i in (1, 2, 3))


def judged_part(models: Models | None, bodies: list) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    texts = [letters(b) for b in bodies]
    has = np.array([len(t) > 0 for t in texts], bool) & (models is not None)
    if models is None:
        return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), has
    entropy, counts = models.entropies(texts)
    best = entropy.argmin(axis=1)
    lowest = entropy.min(axis=1)
    score = 1 / np.exp(-20 * (entropy - lowest[:, None])).sum(axis=1)
    usual = has & accepted(lowest - models.mean[best], models.spread[best], counts)
    names = [models.languages[b] if h else "und" for b, h in zip(best, has, strict=True)]
    return names, np.where(has, score, 0.0), np.where(has, lowest, 0.0), usual


def drop_rejected(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``df`` whose language is recognised, by models trained on ``df``."""
    shared = df.sparkSession.sparkContext.broadcast(train(df, key, text, lang))
    return arrow_filter(df, text, lambda: lambda bodies: judged(shared.value, bodies)[3])


def language_id(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Train on the folds other than 1 and identify every row: key, held_out, lang_pred, score, …."""
    found = identify(df, train(df, key, text, lang), key, text)
    return found.withColumn("held_out", held_out(key, 3)).select(
        key, "held_out", "lang_pred", "score", "entropy", "rejected"
    )
