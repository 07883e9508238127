"""Draw the documents that look most like a target, at random by importance.

Every run of one to ``runs`` words falls into a bucket by its crc32. Buckets are counted
over all documents and over the target; a bucket's gain is the log of the target's
smoothed share over the corpus's, in thousandths. A document's weight is the sum of its
gains, looked up in an array of one number a bucket, and its score adds Gumbel noise
made from its id, so that the highest scores are a draw without replacement.

The cutoff is found without sorting the scores. A quantile sketch gives a bracket around
it; exact counts of the rows above and inside the bracket either prove that the cutoff is
inside or widen it; and only the rows inside are sorted, or counted by score where they
are still many.
"""

from __future__ import annotations

import math
import zlib
from itertools import islice

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import arrow_map, keyed_text, stage

BUCKETS = 10_000
SKETCH = 1000  # a bracket reaches this part of all rows to either side of the sketch's answer, and twice that when widened
PIECE_BYTES = 1 << 20

# Words are runs of digits, a-z (A-Z in lower case) and all bytes beyond ASCII.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def word_pieces(body: bytes):
    """The words of a text in order, a list for each piece of about PIECE_BYTES, so that a long text stays small."""
    start = 0
    while start < len(body):
        end = start + PIECE_BYTES
        if end < len(body):
            while end < len(body) and TO_WORDS[body[end]] != 32:
                end += 1
        words = body[start:end].translate(TO_WORDS).split()
        if words:
            yield words
        start = end


def feature_buckets(body: bytes | None, runs: int, buckets: int):
    """(buckets of the features that end in a piece, words of the piece), piece by piece."""
    before: list[bytes] = []
    for words in word_pieces(body or b""):
        parts = [np.fromiter(map(zlib.crc32, words), np.uint32, len(words))]
        if runs > 1:
            held = before + words
            for size in range(2, runs + 1):
                # a run of this size ends in the piece if it starts less than its size before the piece
                first = max(0, len(before) - size + 1)
                slid = [islice(held, first + k, None) for k in range(size)]
                parts.append(np.array([zlib.crc32(b" ".join(run)) for run in zip(*slid)], np.uint32))
            before = held[len(held) - min(len(held), runs - 1) :]
        yield np.concatenate(parts).astype(np.int64) % buckets, len(words)


def bucket_counts(df: DataFrame, text: str, runs: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket.

    A slice of texts gives at most one row a bucket, and the result has one number a bucket at any input size.
    """

    def make():
        def work(batch):
            counts = np.zeros(buckets, np.int64)
            for body in batch["body"].to_pylist():
                for found, _ in feature_buckets(body, runs, buckets):
                    counts += np.bincount(found, minlength=buckets)
            seen = np.flatnonzero(counts)
            return {"bucket": seen.astype(np.int32), "n": counts[seen]}

        return work

    bodies = df.select(F.col(text).cast("binary").alias("body"))
    sums = arrow_map(bodies, make, "bucket int, n long", 64 << 20).groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(...)) of the target's smoothed share of each bucket over the corpus's."""
    size, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array(
        [math.floor(1000 * math.log((b + 1.0) * (s + size) / ((a + 1.0) * (t + size)))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)],
        np.int64,
    )


def weights(df: DataFrame, key: str, text: str, gain: np.ndarray, runs: int) -> DataFrame:
    """(id, n_words, n_features, weight) of every row."""
    shared = df.sparkSession.sparkContext.broadcast(gain)

    def make():
        table = shared.value

        def work(batch):
            out: dict[str, list] = {"n_words": [], "n_features": [], "weight": []}
            for body in batch["body"].to_pylist():
                words = features = weight = 0
                for found, count in feature_buckets(body, runs, len(table)):
                    words += count
                    features += len(found)
                    weight += int(table[found].sum())
                out["n_words"].append(words)
                out["n_features"].append(features)
                out["weight"].append(weight)
            return out | {"id": batch["id"]}

        return work

    return arrow_map(keyed_text(df, key, text), make, "id long, n_words long, n_features long, weight long")


def gumbel(key: str, seed: int) -> Column:
    """Noise in thousandths from the first 32 bits of the digest of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share)))


def cutoff(rows: DataFrame, wanted: int, count: int) -> tuple[int, int]:
    """(score, how many rows above it): the score of the row at place ``wanted`` from the top."""
    spread = 2.0 * count / SKETCH + 1
    while True:
        shares = [min(1.0, max(0.0, 1 - (wanted + side * spread) / count)) for side in (1, -1)]
        low, high = rows.agg(F.percentile_approx("score", F.array(*map(F.lit, shares)), SKETCH * 10)).first()[0]
        score = F.col("score")
        above, inside = rows.agg(
            F.count_if(score > high), F.count_if((score <= high) & (score >= low))
        ).first()
        if above < wanted <= above + inside:
            break
        spread *= 2  # the exact counts disprove the bracket
    # Scores are whole, so the bracket is sorted as (score, how many): ties are one row, made in each task first.
    bracket = rows.filter((F.col("score") <= high) & (F.col("score") >= low)).groupBy("score").count()
    ranked = number(bracket.repartitionByRange(F.desc("score")).sortWithinPartitions(F.desc("score")), F.col("count"))
    at = ranked.filter(F.col("upto") >= wanted - above).orderBy("upto").select("score", "upto", "count").first()
    return at["score"], above + at["upto"] - at["count"]


def number(sorted_rows: DataFrame, amount: Column) -> DataFrame:
    """``upto``: the sum of ``amount`` over all rows up to this one, of rows that are range-partitioned and sorted.

    Sums are made within each partition; what is before a partition is the sum over at
    most as many rows as there are partitions.
    """
    placed = stage(sorted_rows.withColumn("__at", F.monotonically_increasing_id()).withColumn("__amount", amount))
    part = F.shiftright("__at", 33)
    totals = {r["part"]: r["total"] for r in placed.groupBy(part.alias("part")).agg(F.sum("__amount").alias("total")).collect()}
    before, so_far = [], 0
    for name in sorted(totals):
        before.append((name, so_far))
        so_far += totals[name]
    offsets = placed.sparkSession.createDataFrame(before, "__part long, __before long")
    running = F.sum("__amount").over(Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
    return (
        placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")
        .withColumn("upto", F.col("__before") + running).drop("__at", "__amount", "__part", "__before")
    )


def resample(
    df: DataFrame, target: DataFrame, percent: int = 10, seed: int = 2024, least_words: int = 20, runs: int = 1,
    key: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS,
) -> DataFrame:
    """(key, n_features, weight, score, rank) of every row of ``df``; rank 1, 2, … of the drawn rows, else null.

    Of the rows with an id and ``least_words`` words or more, floor(percent · rows / 100)
    are drawn: the highest scores, ties to the smaller id, repeated rows each on their own.
    A null or empty text has no feature and weight 0; it is too short to be drawn. A row
    without an id counts into the corpus, has no score and is not drawn. An empty table
    gives an empty result, an empty target gives gains all the same. Other columns of
    ``df`` and ``target`` are ignored, whatever they are called.
    """
    gain = gains(bucket_counts(df, text, runs, buckets), bucket_counts(target, target_text, runs, buckets))
    scored = stage(
        weights(df, key, text, gain, runs)
        .withColumn("score", F.col("weight") + gumbel("id", seed))
        .withColumn("copy", F.monotonically_increasing_id())
    )
    named = [F.col("id").alias(key), "n_features", "weight", "score"]
    fit = F.col("id").isNotNull() & (F.col("n_words") >= least_words)
    eligible = scored.filter(fit)
    count = eligible.count()
    wanted = count * percent // 100
    if not wanted:
        return scored.select(*named, F.lit(None).cast("long").alias("rank"))
    least, above = cutoff(eligible, wanted, count)
    # Rows of the last score go by id; the draw has all scores above it.
    upper = eligible.filter(F.col("score") >= least)
    order = [F.desc("score"), F.asc("id"), F.asc("copy")]
    drawn = number(upper.repartitionByRange(*order).sortWithinPartitions(*order), F.lit(1))
    rank = F.when(F.col("upto") <= wanted, F.col("upto"))
    lower = scored.filter(~(fit & (F.col("score") >= least)))
    return drawn.select(*named, rank.alias("rank")).unionByName(lower.select(*named, F.lit(None).cast("long").alias("rank")))
