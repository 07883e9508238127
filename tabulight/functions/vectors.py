"""Vector expressions: similarity, normalisation and the built-in embeddings."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import BLANK_CHARS, bind

# The vocabulary, in index order; a repeated word keeps its last index.
VOCABULARY = (
    "table column row database sql query select insert update delete "
    "primary foreign key index constraint join where group order limit "
    "customer product order sale revenue price quantity total date time "
    "analysis report metric trend performance efficiency optimization "
    "marketing sales customer segment campaign conversion retention churn "
    "acquisition lifetime value cohort funnel engagement loyalty brand "
    "channel roi kpi metric analytics insight strategy growth"
).split()
COMMON_PARTS = ("customer", "product")
COMMON_WEIGHT, RARE_WEIGHT = 1.0, 2.0
# Marks read as blanks, and terms counted in the last positions.
MARKS = ".,:;!?"
COUNTED_TERMS = ("分析", "查詢", "銷售", "客戶", "產品", "數據")
TAIL = 4 + len(COUNTED_TERMS)
CHAR_DIM = 384
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def dot(left: Column, right: Column) -> Column:
    pairs = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    return F.sqrt(
        F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    )


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity; 0 where lengths differ or a norm is 0."""

    def scaled(scale: Column) -> Column:
        usable = (F.size(left) == F.size(right)) & (scale > 0)
        return F.when(usable, dot(left, right) / scale).otherwise(F.lit(0.0))

    return bind(norm(left) * norm(right), scaled)


def l2_normalize(vector: Column) -> Column:
    """Unit length; a zero vector is left as it is."""

    def scaled(v: Column) -> Column:
        return bind(
            norm(v),
            lambda length: F.transform(
                v, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(x.cast("double"))
            ),
        )

    return bind(vector, scaled)


def embed_hash(text: Column, dim: int = 256) -> Column:
    """Eight numbers from the SHA-256 of the text, zeros after, unit length."""
    used = min(dim, 8)

    def numbers(digest: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(used - 1)),
            lambda i: F.conv(F.substring(digest, i * 8 + 1, F.lit(8)), 16, 10).cast("double") / F.lit(2.0**64),
        )

    zeros = F.array_repeat(F.lit(0.0), dim - used)
    return l2_normalize(F.concat(bind(F.sha2(text, 256), numbers), zeros))


# Bytes counted, and rows of vectors built, at once.
PIECE, ROWS = 1 << 16, 1024


def _lists(values: np.ndarray, unknown: np.ndarray | None = None) -> pa.Array:
    """The rows of a matrix as lists, null where it says so."""
    rows, width = values.shape
    mask = None if unknown is None else unknown.ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(values.ravel(), mask=mask))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _charstats(texts: pa.Array) -> pa.Array:
    counted = np.frombuffer((" .," + LETTERS).encode(), dtype=np.uint8)
    out = np.zeros((len(texts), 1 + len(counted)))
    bodies = texts.cast(pa.large_binary())
    ends = np.frombuffer(bodies.buffers()[1], dtype=np.int64)[bodies.offset :]
    data = np.frombuffer(bodies.buffers()[2] or b"", dtype=np.uint8)
    for row in np.flatnonzero(pc.greater(pc.binary_length(bodies), 0).fill_null(False)):
        body = data[ends[row] : ends[row + 1]]
        counts = sum(np.bincount(body[at : at + PIECE], minlength=256) for at in range(0, len(body), PIECE))
        out[row, 0] = len(body) / 1000.0
        out[row, 1:] = counts[counted] / len(body)
    lengths = np.linalg.norm(out, axis=1, keepdims=True)
    return _lists(np.divide(out, lengths, out=out, where=lengths > 0))


def embed_charstats(text: Column) -> Column:
    """Length, blank/stop/comma densities and letter frequencies; 384 numbers.

    No built-in counts all characters in one pass, and 55 counting passes over whole
    texts cost many times more than sending them to numpy in Arrow batches. The texts stay
    the batch's bytes and only the numbers that can differ from zero come back.
    """
    return F.concat(_charstats(text), F.array_repeat(F.lit(0.0), CHAR_DIM - 1 - 3 - len(LETTERS)))


def _tfidf(dim: int, with_tail: bool) -> Callable[[Column], Column]:
    """Unit vectors of clean texts."""
    last = {term: index for index, term in enumerate(VOCABULARY) if index < dim}
    known = frozenset(VOCABULARY)
    weights = np.zeros(dim)
    for term, index in last.items():
        weights[index] = COMMON_WEIGHT if any(part in term for part in COMMON_PARTS) else RARE_WEIGHT
    word = re.compile(f"[^{BLANK_CHARS}]+")
    places = np.arange(dim)

    def raw(texts: list[str]) -> np.ndarray:
        counts, tails = np.zeros((len(texts), 1)), np.zeros((len(texts), TAIL))
        made = np.zeros((len(texts), dim))
        for row, text in enumerate(texts):
            tokens = word.findall(text)
            size, count = len(text.encode()), len(tokens)
            hits = [token for token in tokens if token in known]
            for term in set(hits):
                if term in last:
                    made[row, last[term]] = hits.count(term) / len(hits)
            counts[row] = count
            if with_tail:
                tails[row] = [
                    size / 1000.0, count / 100.0, size / (count + 1), len(set(tokens)) / (count + 1),
                    *[text.count(term) / 10.0 for term in COUNTED_TERMS],
                ]
        made *= weights
        made += np.where(places < counts, 0.1 * places / np.maximum(counts, 1), 0.0)
        if with_tail:
            made[:, dim - TAIL :] = tails
        return made

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def built(texts: pa.Array) -> pa.Array:
        out = np.zeros((len(texts), dim))
        for at in range(0, len(texts), ROWS):
            made = raw([text or "" for text in texts[at : at + ROWS].to_pylist()])
            lengths = np.sqrt(np.einsum("ij,ij->i", made, made))[:, None]
            np.divide(made, lengths, out=out[at : at + ROWS], where=lengths > 0)
        if not with_tail or not texts.null_count:
            return _lists(out)
        # The statistics of no text are unknown.
        unknown = np.zeros(out.shape, bool)
        unknown[np.flatnonzero(texts.is_null()), dim - TAIL :] = True
        return _lists(out, unknown)

    return built


def embed_tfidf(text: Column, dim: int = 256, stats: bool = True) -> Column:
    """Vocabulary TF-IDF with a position ramp; the last ten numbers are text statistics.

    Texts are cleaned by built-ins and go to numpy in Arrow batches: expressions over the
    slots of each vector cost several times more than a look at the few known words.
    """
    clean = F.translate(F.lower(text), MARKS, " " * len(MARKS))
    return _tfidf(dim, stats and dim >= TAIL)(clean)


# Embeddings by name; callers may add a builder, such as one made of a pandas_udf.
EMBEDDERS: dict[str, Callable[[Column], Column]] = {
    "hash": embed_hash,
    "charstats": embed_charstats,
    "tfidf": embed_tfidf,
}


def embed(text: Column, embedder: str | Callable[[Column], Column] = "tfidf") -> Column:
    """Embed with a registered builder or with one that is passed in."""
    build = EMBEDDERS[embedder] if isinstance(embedder, str) else embedder
    return build(text)
