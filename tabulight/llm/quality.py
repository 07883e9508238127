"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are computed in Arrow batches wherever the texts lie. Trees are fitted on
a bounded sample of labelled rows and flattened into three arrays (feature, threshold,
leaf value of complete binary trees), which numpy walks for all rows and trees at once.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import arrow_filter, arrow_map, stage
from .sampling import bounded_sample, fold, held_out

SAMPLE_ROWS = 10_000
BINS, DEPTH, TREES, RATE, SMOOTH = 64, 4, 80, 0.15, 1.0
STATISTICS = (
    "bytes", "words", "lines", "word_length", "longest_word", "line_length", "upper", "digit", "space", "newline",
    "non_ascii", "stop", "exclaim", "pipe", "symbol", "other_mark", "distinct_words", "top_word", "top_three",
    "repeated_next", "distinct_lines", "capital_words", "marked_words", "distinct_pairs",
)


def _class_table() -> np.ndarray:
    table = np.zeros((256, 10))
    for byte in range(256):
        char = chr(byte)
        column = (
            0 if "A" <= char <= "Z" else 1 if "0" <= char <= "9" else 2 if char == " " else 3 if char == "\n"
            else 4 if byte >= 128 else 5 if char in ".,;:?" else 6 if char == "!" else 7 if char == "|"
            else 8 if char in "#$%&*+<=>@^_~\\{}[]" else 9 if not char.isalpha() else None
        )
        if column is not None:
            table[byte, column] = 1
    return table


CLASSES = _class_table()


def statistics(body: bytes | None) -> list[float]:
    """The STATISTICS of a whole text; all 0 for a null, empty or blank one."""
    words = body.lower().split() if body else []
    if not words:
        return [0.0] * len(STATISTICS)
    size, count = len(body), len(words)
    shares = np.bincount(np.frombuffer(body, np.uint8), minlength=256) @ CLASSES / size
    times = Counter(words)
    top = [n for _, n in times.most_common(3)] if len(times) < 2000 else sorted(times.values())[-3:][::-1]
    lines = [line for line in body.split(b"\n") if line]
    pairs = len(set(zip(words, words[1:]))) if count > 1 else 1
    repeated = sum(map(bytes.__eq__, words, words[1:]))
    own = body.split()
    return [
        np.log1p(size), np.log1p(count), np.log1p(len(lines)), sum(map(len, words)) / count,
        float(np.log1p(max(map(len, words)))), np.log1p(size / max(1, len(lines))), *shares.tolist(),
        len(times) / count, top[0] / count, sum(top) / count, repeated / count, len(set(lines)) / max(1, len(lines)),
        sum(map(bytes.istitle, own)) / count, sum(not w.isalpha() for w in own) / count, pairs / max(1, count - 1),
    ]


def with_statistics(df: DataFrame) -> DataFrame:
    """(id, stats) for (id, body)."""

    def make():
        def work(batch):
            return {"id": batch["id"], "stats": [statistics(b.as_py()) for b in batch["body"]]}

        return work

    return arrow_map(df.select("id", "body"), make, "id long, stats array<double>")


@dataclass
class Trees:
    """Complete trees of equal depth: feature and threshold by inner node, value by leaf, all by tree."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def scores(self, stats: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        trees = np.arange(len(self.feature))[None, :]
        node = np.zeros((len(stats), len(self.feature)), np.int64)
        rows = np.arange(len(stats))[:, None]
        for _ in range(DEPTH):
            right = stats[rows, self.feature[trees, node]] > self.threshold[trees, node]
            node = 2 * node + 1 + right
        raw = self.base + self.value[trees, node - (2**DEPTH - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-raw))


def fit_trees(stats: np.ndarray, labels: np.ndarray) -> Trees:
    """Boosted logistic trees by histogram splits; ties go to the first feature and lowest bin."""
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, BINS)[1:-1])) for column in stats.T]
    binned = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, stats.T, strict=True)], 1)
    raw = np.full(len(labels), base)
    inner = 2**DEPTH - 1
    features, thresholds, values = (np.zeros((TREES, n)) for n in (inner, inner, inner + 1))
    thresholds[:] = np.inf
    for tree in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        gradient, weight = labels - p, p * (1 - p)
        node = np.zeros(len(labels), np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            at = node - first
            best = np.full(width, 1e-9)
            for f, cut in enumerate(cuts):
                place = at * BINS + binned[:, f]
                g = np.bincount(place, gradient, width * BINS).reshape(width, BINS)
                h = np.bincount(place, weight, width * BINS).reshape(width, BINS)
                gl, hl = g.cumsum(1), h.cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + SMOOTH) + (gt - gl) ** 2 / (ht - hl + SMOOTH) - gt**2 / (ht + SMOOTH)
                gain = gain[:, : len(cut)]
                if not len(cut):
                    continue
                place = gain.argmax(1)
                won = np.flatnonzero(gain.max(1) > best + 1e-9)
                best[won] = gain.max(1)[won]
                features[tree, first + won], thresholds[tree, first + won] = f, cut[place[won]]
            f, t = features[tree, node].astype(int), thresholds[tree, node]
            node = 2 * node + 1 + (stats[np.arange(len(stats)), f] > t)
        leaf = node - inner
        g, h = np.bincount(leaf, gradient, inner + 1), np.bincount(leaf, weight, inner + 1)
        values[tree] = RATE * g / (h + SMOOTH)
        raw = raw + values[tree, leaf]
    return Trees(features.astype(np.int64), thresholds, values, base)


def train(
    df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    sample_rows: int = SAMPLE_ROWS, parts: int = 3,
) -> Trees | None:
    """Trees from at most ``sample_rows`` rows of either label outside fold 1; None if there are none.

    A document with several labels counts with the lowest. Only the text is an input.
    """
    given = (
        labels.filter(fold(key, parts) != 1).filter(F.col(label).isin(0, 1))
        .groupBy(F.col(key).cast("long").alias("id")).agg(F.min(F.col(label).cast("int")).alias("label"))
        .withColumn("size", F.lit(1))
    )
    picked = stage(bounded_sample(given, "label", sample_rows, sample_rows))
    texts = df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("body"))
    rows = with_statistics(texts.join(F.broadcast(picked.select("id")), "id", "left_semi"))
    found = rows.join(F.broadcast(picked), "id").orderBy("id", "stats").toArrow()
    if not found.num_rows:
        return None
    stats = found["stats"].combine_chunks().flatten().to_numpy().reshape(-1, len(STATISTICS))
    return fit_trees(stats, found["label"].to_numpy().astype(float))


def score(df: DataFrame, trees: Trees | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted) for every row; without a model every score is 0.5.

    Null, empty and blank texts have all statistics 0 and are scored like others; null
    or repeated keys and other columns change nothing.
    """
    shared = df.sparkSession.sparkContext.broadcast(trees)

    def make():
        model = shared.value

        def work(batch):
            scores = scores_of(model, batch["body"].to_pylist())
            return {"id": batch["id"], "score": scores, "predicted": (scores >= 0.5).astype(np.int32)}

        return work

    source = df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("body"))
    return arrow_map(source, make, "id long, score double, predicted int").withColumnRenamed("id", key)


def scores_of(model: Trees | None, bodies: list) -> np.ndarray:
    return np.full(len(bodies), 0.5) if model is None else model.scores(np.array([statistics(b) for b in bodies]))


def drop_low(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` predicted to have label 1, by trees trained on ``df``."""
    shared = df.sparkSession.sparkContext.broadcast(train(df, labels, key, text))
    return arrow_filter(df, text, lambda: lambda bodies: scores_of(shared.value, bodies) >= 0.5)


def quality(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Train on the folds other than 1 and score every row: key, held_out, score, predicted."""
    found = score(df, train(df, labels, key, text), key, text)
    return found.withColumn("held_out", held_out(key, 3)).select(key, "held_out", "score", "predicted")
