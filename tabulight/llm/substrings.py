"""Remove passages of many words that a document with a smaller id has too, by recompression.

Recompression turns a text's words into ever longer symbols. A round names either runs,
a symbol k times in a row, or pairs: each symbol falls to one of two sides by its name
and the round, and a left one followed by a right one becomes one symbol. A name is a
hash of what it stands for, so all tasks give equal runs and pairs equal names, without
a table of names. Equal passages therefore get equal symbols but for some at both ends,
where a neighbour outside has a say; every symbol carries the range of words that its
making depends on.

1. Spark counts, for the symbols of a middle round and for the long symbols of all later
   rounds, up to one for the whole document, the smallest and largest document.
2. A passage is a window of ``words`` consecutive words. Each middle symbol that depends
   on words of a window alone occurs wherever the window does. So a window with a symbol that
   only one document has cannot repeat, and is out.
3. A long symbol that a smaller document has too covers its words at once: all of its
   windows repeat there. They are neither compared, nor needed as the smallest.
4. Spark groups the windows that are left by their words' hash, 128 bits, and finds the
   smallest document of each; this verifies them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import arrow_map, in_filter, stage
from .words import EXACT_VALUES, MULTIPLIERS, PART_BYTES, mix, powers, text_parts, word_hashes

BLANK = re.compile(rb"[\x09-\x0d\x20]")
LONG_ROUNDS = 16
LONG, WHOLE = np.uint64(0x452821E638D01377), np.uint64(0xBE5466CF34E90C6C)
SLICE = 8 << 20
# Bits of the filter of shared names: 16 a name up to 32 MB. A fuller filter lets more windows
# through to the exact comparison; it never changes a result.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28


class Symbols:
    """Consecutive symbols of some documents: first word, length, name, document, and the words they depend on."""

    def __init__(self, hashes: np.ndarray, doc: np.ndarray):
        self.start = np.arange(len(hashes))
        self.size = np.ones(len(hashes), np.int64)
        self.name, self.doc = hashes, doc
        self.low, self.high = self.start, self.start + 1

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """How far each symbol's making reaches if its neighbours have a say; over a document's edge it is outside any window."""
        same = self.doc[1:] == self.doc[:-1]
        end = self.start + self.size
        before = np.concatenate((self.start[:1] - 1, np.where(same, self.low[:-1], self.start[1:] - 1)))
        after = np.concatenate((np.where(same, self.high[1:], end[:-1] + 1), end[-1:] + 1))
        return before, after

    def join(self, first: np.ndarray, name: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """One symbol, with a name, for each group that begins at ``first``; ``low`` and ``high`` are by old symbol."""
        self.size = np.add.reduceat(self.size, first)
        self.low, self.high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
        self.start, self.doc, self.name = self.start[first], self.doc[first], name

    def runs(self) -> np.ndarray:
        """Name runs of equal symbols; gives which symbols are new."""
        equal = (self.name[1:] == self.name[:-1]) & (self.doc[1:] == self.doc[:-1])
        first = np.flatnonzero(np.concatenate(([True], ~equal)))
        last = np.concatenate((first[1:], [len(self.name)])) - 1
        count = (last - first + 1).astype(np.uint64)
        before, after = self.neighbours()
        named = mix(self.name[first] * MULTIPLIERS[0] + count * MULTIPLIERS[1])
        self.join(first, np.where(count > 1, named, self.name[first]), np.minimum(self.low, before), np.maximum(self.high, after))
        return count > 1

    def pairs(self, seed: int) -> np.ndarray:
        """Name pairs of a left and a right symbol; gives which symbols are new."""
        sides = mix(self.name ^ mix(np.full(1, seed, np.uint64) * MULTIPLIERS[1]))
        right = (sides & np.uint64(1)).astype(bool)
        paired = np.concatenate((~right[:-1] & right[1:] & (self.doc[1:] == self.doc[:-1]), [False]))
        second = np.concatenate(([False], paired[:-1]))
        before, after = self.neighbours()
        low = np.where(right & ~second, np.minimum(self.low, before), self.low)
        high = np.where(~right & ~paired, np.maximum(self.high, after), self.high)
        first = np.flatnonzero(~second)
        new = paired[first]
        last = first + new
        named = mix(self.name[first] * MULTIPLIERS[0] + (self.name[last] ^ MULTIPLIERS[1]))
        self.join(first, np.where(new, named, self.name[first]), low, high)
        return new

    def round(self, number: int) -> np.ndarray:
        return self.runs() if number % 5 == 0 else self.pairs(number)


def middle_rounds(words: int) -> int:
    """Rounds after which about eight symbols fill a window; a round of pairs leaves three quarters of the symbols."""
    pairs = max(1, round(math.log(max(1.0, words / 8.66)) / math.log(4 / 3)))
    return pairs + 1 + (pairs - 1) // 4


class Parsed:
    """The words of some documents, their middle symbols, and the long symbols of the later rounds."""

    def __init__(self, bodies: list[bytes], words: int):
        hashes, edges = exact_words(bodies)
        sizes = np.diff(edges)
        self.words, self.sizes, self.starts = words, sizes, edges[:-1]
        self.doc = np.repeat(np.arange(len(bodies)), sizes)
        self.hashes = hashes
        use = np.flatnonzero((sizes >= words)[self.doc]) if len(hashes) else np.zeros(0, np.int64)
        self.long_start = self.long_size = self.long_doc = np.zeros(0, np.int64)
        self.long_name = self.name = np.zeros(0, np.uint64)
        self.low = self.high = self.middle_doc = np.zeros(0, np.int64)
        if not len(use):
            return
        symbols = Symbols(hashes[use], self.doc[use])
        middle = middle_rounds(words)
        long = [self.whole(use)]
        for number in range(middle + LONG_ROUNDS):
            new = symbols.round(number)
            at = np.flatnonzero(new & (symbols.size >= words))
            long.append((use[symbols.start[at]], symbols.size[at], symbols.name[at] ^ LONG, symbols.doc[at]))
            if number == middle - 1:
                low, high, doc = symbols.low, symbols.high, self.doc[use]
                inside = (low >= 0) & (high <= len(use)) & (high - low <= words)
                inside &= (doc[np.maximum(low, 0)] == symbols.doc) & (doc[np.minimum(high, len(use)) - 1] == symbols.doc)
                near = np.flatnonzero(inside)
                self.name, self.middle_doc = symbols.name[near], symbols.doc[near]
                self.low, self.high = use[low[near]], use[high[near] - 1] + 1  # places among all words
        self.long_start, self.long_size, self.long_name, self.long_doc = map(np.concatenate, zip(*long))

    def whole(self, use: np.ndarray):
        """A symbol for each document: the top of its parse."""
        rows = np.flatnonzero(self.sizes >= self.words)
        place = (use - np.repeat(self.starts[rows], self.sizes[rows])).astype(np.uint64)
        parts = mix(self.hashes[use] + mix(place * MULTIPLIERS[0] + WHOLE))
        first = np.concatenate(([0], np.cumsum(self.sizes[rows])[:-1]))
        return self.starts[rows], self.sizes[rows], mix(np.add.reduceat(parts, first) + self.sizes[rows].astype(np.uint64)) ^ LONG, rows

    def hashed(self, at: np.ndarray, salt: np.uint64) -> np.ndarray:
        """A hash of the words of the windows at some places."""
        up, down = powers(len(self.hashes) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(self.hashes ^ salt) * up[:-1])))
        return mix((sums[at + self.words] - sums[at]) * down[at])

    def windows(self, shared: np.ndarray) -> np.ndarray:
        """First words of the windows all of whose symbols are ``shared``."""
        count = len(self.hashes)
        if count < self.words:
            return np.zeros(0, np.int64)
        fits = self.doc[: count - self.words + 1] == self.doc[self.words - 1 :]
        out = ~shared
        steps = np.bincount(np.maximum(self.high[out] - self.words, 0), minlength=count + 1)
        steps -= np.bincount(self.low[out] + 1, minlength=count + 1)[: count + 1]
        return np.flatnonzero(fits & (np.cumsum(steps)[: len(fits)] == 0))


def exact_words(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts and where each text's start; a long text is hashed piece by piece."""
    if len(bodies) > 1 or len(bodies[0]) <= 2 * PART_BYTES:
        return word_hashes(bodies, EXACT_VALUES)
    found = [word_hashes([piece], EXACT_VALUES)[0] for piece in pieces(bodies[0])]
    hashes = np.concatenate(found)
    return hashes, np.array([0, len(hashes)])


def pieces(body: bytes) -> Iterator[bytes]:
    """A text cut between words every PART_BYTES or so."""
    start = 0
    while start < len(body):
        blank = BLANK.search(body, start + PART_BYTES)
        end = blank.start() if blank else len(body)
        yield body[start:end]
        start = end


def names(docs: DataFrame, words: int) -> DataFrame:
    """(name, long, low, high): the smallest and largest document of each middle or long symbol."""

    def make():
        def work(batch):
            ids = batch["id"].to_numpy()
            found, row = [], 0
            for part in text_parts(batch["body"].to_pylist()):
                parsed, own = Parsed(part, words), ids[row : row + len(part)]
                row += len(part)
                found.append((parsed.name, np.zeros(len(parsed.name), bool), own[parsed.middle_doc]))
                found.append((parsed.long_name, np.ones(len(parsed.long_name), bool), own[parsed.long_doc]))
            if not found:
                return None
            name, long, doc = map(np.concatenate, zip(*found))
            order = np.lexsort((doc, name))
            name, long, doc = name[order], long[order], doc[order]
            if not len(name):
                return None
            first = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
            last = np.concatenate((first[1:], [len(name)])) - 1
            return {"name": name[first].view(np.int64), "long": long[first], "low": doc[first], "high": doc[last]}

        return work

    rows = arrow_map(docs.select("id", "body"), make, "name long, long boolean, low long, high long", SLICE)
    return rows.groupBy("name", "long").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def name_filter(shared: DataFrame) -> np.ndarray:
    """A bitmap with a bit set for each shared name, of a size by their number; its length is a power of two."""
    count = shared.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << math.ceil(math.log2(16 * count + 1))))
    slot = F.col("name").bitwiseAND(F.lit(bits - 1))
    words = (
        shared.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    ).toArrow()
    bitmap = np.zeros(bits // 64, np.uint64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return bitmap


def held(bitmap: np.ndarray, found: np.ndarray) -> np.ndarray:
    return in_filter(bitmap, found & np.uint64(len(bitmap) * 64 - 1))


def candidates(docs: DataFrame, words: int, bitmap: np.ndarray) -> DataFrame:
    """(id, copy, at, first, second, long) of documents with something shared: places and hashes of windows, long symbols."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    schema = "id long, copy long, at binary, first binary, second binary, long_name array<long>, long_start array<long>, long_size array<long>"

    def make():
        bits = shared.value

        def work(batch):
            ids, copies = batch["id"].to_numpy(), batch["copy"].to_numpy()
            out: dict[str, list] = {n: [] for n in ("id", "copy", "at", "first", "second", "long_name", "long_start", "long_size")}
            row = 0
            for part in text_parts(batch["body"].to_pylist()):
                parsed = Parsed(part, words)
                at = parsed.windows(held(bits, parsed.name))
                first, second = parsed.hashed(at, LONG), parsed.hashed(at, WHOLE)
                hits = np.flatnonzero(held(bits, parsed.long_name))
                hits = hits[np.argsort(parsed.long_doc[hits], kind="stable")]
                edges = np.searchsorted(parsed.doc[at], np.arange(len(part) + 1))
                long_edges = np.searchsorted(parsed.long_doc[hits], np.arange(len(part) + 1))
                for doc in np.flatnonzero((np.diff(edges) > 0) | (np.diff(long_edges) > 0)).tolist():
                    own, long = slice(edges[doc], edges[doc + 1]), hits[long_edges[doc] : long_edges[doc + 1]]
                    out["id"].append(ids[row + doc])
                    out["copy"].append(copies[row + doc])
                    out["at"].append((at[own] - parsed.starts[doc]).tobytes())
                    out["first"].append(first[own].tobytes())
                    out["second"].append(second[own].tobytes())
                    out["long_name"].append(parsed.long_name[long].view(np.int64))
                    out["long_start"].append(parsed.long_start[long] - parsed.starts[doc])
                    out["long_size"].append(parsed.long_size[long])
                row += len(part)
            return out

        return work

    return arrow_map(docs, make, schema, SLICE)


def spans(rows: DataFrame) -> DataFrame:
    """(id, copy, spans) of rows (id, copy, start, size): the spans of a document's row, in order."""
    own = F.array_sort(F.collect_set(F.struct("start", "size")))
    return rows.groupBy("id", "copy").agg(own.alias("spans"))


def open_windows(found: DataFrame, covered: DataFrame, words: int) -> DataFrame:
    """(id, copy, at, first, second), a row a window, of those that no covered span holds."""

    def make():
        def work(batch):
            out: dict[str, list] = {n: [] for n in ("id", "copy", "at", "first", "second")}
            ids, copies = batch["id"].to_pylist(), batch["copy"].to_pylist()
            packed = {n: batch[n].to_pylist() for n in ("at", "first", "second")}
            starts, sizes = batch["start"].to_pylist(), batch["size"].to_pylist()
            for row in range(len(ids)):
                at, first, second = (np.frombuffer(packed[n][row], np.int64) for n in ("at", "first", "second"))
                if starts[row] and len(at):
                    start = np.array(starts[row], np.int64)
                    reach = np.maximum.accumulate(start + np.array(sizes[row], np.int64))
                    place = np.searchsorted(start, at, side="right") - 1
                    left = (place < 0) | (reach[place] < at + words)
                    at, first, second = at[left], first[left], second[left]
                if len(at):
                    out["id"].append(np.full(len(at), ids[row]))
                    out["copy"].append(np.full(len(at), copies[row]))
                    for n, values in (("at", at), ("first", first), ("second", second)):
                        out[n].append(values)
            return {n: np.concatenate(v) for n, v in out.items()} if out["id"] else None

        return work

    rows = found.select("id", "copy", "at", "first", "second").join(covered, ["id", "copy"], "left").select(
        "id", "copy", "at", "first", "second", F.col("spans.start").alias("start"), F.col("spans.size").alias("size")
    )
    return arrow_map(rows, make, "id long, copy long, at long, first long, second long", SLICE)


def repeats(docs: DataFrame, words: int) -> DataFrame:
    """(id, copy, start, size): spans of words that windows of smaller documents cover, of rows (id, copy, body)."""
    shared = stage(names(docs, words).filter(F.col("low") < F.col("high")))
    found = stage(candidates(docs, words, name_filter(shared)))
    long = found.select("id", "copy", F.explode(F.arrays_zip("long_name", "long_start", "long_size")).alias("s")).select(
        "id", "copy", F.col("s.long_name").alias("name"), F.col("s.long_start").alias("start"), F.col("s.long_size").alias("size")
    )
    known = shared.filter("long").select("name", "low")
    covered = stage(spans(long.join(known, "name").filter(F.col("low") < F.col("id")).select("id", "copy", "start", "size")))
    windows = stage(open_windows(found, covered, words))
    least = (
        windows.groupBy("first", "second").agg(F.min("id").alias("low"), F.max("id").alias("high"))
        .filter(F.col("low") < F.col("high")).select("first", "second", "low")
    )
    verified = windows.join(least, ["first", "second"]).filter(F.col("low") < F.col("id"))
    whole = covered.select("id", "copy", F.explode("spans").alias("s")).select("id", "copy", "s.start", "s.size")
    return verified.select("id", "copy", F.col("at").alias("start"), F.lit(words).cast("long").alias("size")).unionByName(whole)


def kept_words(body: bytes, starts: list[int] | None, sizes: list[int] | None) -> tuple[int, int, bytes]:
    """(words, removed words, the kept words joined by a space)."""
    found, count, removed = [], 0, 0
    if starts:
        low = np.array(starts, np.int64)
        reach = np.maximum.accumulate(low + np.array(sizes, np.int64))
    for piece in pieces(body):
        words = piece.split()
        if not words:
            continue
        if starts:
            place = np.arange(count, count + len(words))
            at = np.searchsorted(low, place, side="right") - 1
            gone = (at >= 0) & (reach[at] > place)
            removed += int(gone.sum())
            if gone.any():
                words_kept = [words[i] for i in np.flatnonzero(~gone).tolist()]
                count += len(words)
                if words_kept:
                    found.append(b" ".join(words_kept))
                continue
        count += len(words)
        found.append(b" ".join(words))
    return count, removed, b" ".join(found)


def remove_repeats(df: DataFrame, words: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_removed, kept) of every row; ``kept`` is what is left of its words, joined by one space.

    Words are runs of bytes other than space and 0x09-0x0D, unchanged. A word goes if a
    window of ``words`` consecutive words over it also starts in a row with a smaller id;
    windows are those of the input. A text without words, empty or null, gives no words and
    an empty ``kept``; one shorter than a window stays whole. Rows with the same id never
    remove each other's words, each is judged against smaller ids. A row without an id
    neither loses nor removes words. Other columns are ignored, whatever they are called;
    an empty table gives an empty result.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("copy"), F.col(text).cast("binary").alias("body"))
    gone = stage(spans(repeats(rows.filter("id is not null and body is not null"), words)))
    slot = F.xxhash64("id", "copy")
    bitmap = df.sparkSession.sparkContext.broadcast(name_filter(gone.select(slot.alias("name"))))

    @F.pandas_udf("boolean")
    def touched(name: pd.Series) -> pd.Series:
        return pd.Series(held(bitmap.value, name.to_numpy().view(np.uint64)))

    # Only texts that lose words, and a few that look like it, are shuffled to their spans. The others are
    # told apart in the task that joins their words, so that no task keeps two Python workers.
    hit = rows.filter(touched(slot)).join(gone, ["id", "copy"], "left").select(
        "id", "body", F.col("spans.start").alias("start"), F.col("spans.size").alias("size")
    )

    def result(batch, starts, sizes):
        bodies = batch["body"].to_pylist()
        made = [kept_words(b or b"", s, z) for b, s, z in zip(bodies, starts, sizes, strict=True)]
        return {"id": batch["id"], **{n: [m[i] for m in made] for i, n in enumerate(("n_words", "n_removed", "kept"))}}

    def shorten():
        return lambda batch: result(batch, batch["start"].to_pylist(), batch["size"].to_pylist())

    def leave():
        bits = bitmap.value

        def work(batch):
            left = pa.array(~held(bits, batch["slot"].to_numpy().view(np.uint64)))
            none = [None] * left.true_count
            return result({n: batch[n].filter(left) for n in ("id", "body")}, none, none)

        return work

    schema = "id long, n_words long, n_removed long, kept binary"
    every = arrow_map(hit, shorten, schema, SLICE).unionByName(
        arrow_map(rows.select("id", "body", slot.alias("slot")), leave, schema, SLICE)
    )
    return every.select(
        F.col("id").alias(key), "n_words", "n_removed", F.col("kept").cast("string").alias("kept")
    )
