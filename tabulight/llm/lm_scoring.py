"""Language-model scoring from a log-frequency Bloom filter.

Words and runs of two to five words of the training texts are counted, their counts
quantised on a logarithmic scale, and an n-gram of level q is put into a Bloom filter q
times, as (n-gram, 1) … (n-gram, q). The filter is broadcast; a count is read back by
probing for level 1, 2, … until a probe fails. A token's probability starts from the
smoothed word frequency and is mixed, run length by run length, with the run's relative
frequency after its context, with a weight for each level of the context: for pairs by
EM, for longer runs by deleted interpolation (how often the run's frequency is not below
all of shorter runs), both leaving one out over all training tokens.

All words and pairs are kept. A longer run says something about other texts only if it
is repeated, and then all runs inside it are; so runs of three are counted only where
both pairs are seen twice or more, runs of four and five only where all runs of three
are, and those seen once are not put into the filter. What is found repeated is exact.

N-grams are dealt by hash to shards. What is counted in a batch is shuffled as one
packed row a shard, so a frequent n-gram is one entry a batch, and a shard's part of the
filter is made where its counts meet. Filter parts are broadcast a bounded number of
bytes at a time; a filter beyond that takes more passes over the texts.

Exact word counts, for the base score, are looked up in shards too; only the words that
make up more than 1/HOT_SHARE of all tokens, at most HOT_SHARE, are broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .frames import arrow_map, release, slices, small_batches, stage_at, to_batch
from .jaccard_join import group_runs
from .sampling import held_out
from .words import MULTIPLIERS, mix, text_parts, word_hashes

SHARD_BYTES = 8 << 20  # text a shard
BITS_PER_ENTRY = 12
ROUND_BYTES = 256 << 20
HOT_SHARE = 20_000
START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
LEVELS = np.unique(np.ceil(1.25 ** np.arange(190)).astype(np.int64))  # lowest count of each level
COUNTS = np.concatenate(([0.0], np.sqrt(LEVELS * np.maximum(LEVELS, np.append(LEVELS[1:], LEVELS[-1]) - 1.0))))
TOKENS_AT_ONCE = 1 << 21
REMEMBERED = 1 << 18
RUN_BYTES = 1 << 20  # text whose words of a shard are moved as one row
MOVED_BYTES = 4 << 20  # an Arrow batch: beside the filter, executors and their workers hold little else
# Of staged texts two tables lie on disk at once, and a writing task holds a row group.
LEVEL_FILES = {"compression": "zstd", "parquet.compression.codec.zstd.level": 1, "parquet.block.size": 16 << 20}
LOW = np.uint64((1 << 40) - 1)
TWO_BITS = ((np.uint64(1) << np.arange(64, dtype=np.uint64))[:, None] | (np.uint64(1) << np.arange(64, dtype=np.uint64))).ravel()
ORDERS = 5  # kind 0 is words, kind n runs of n + 1 words
GROUPS = ((0, 1), (2,), (3, 4))  # kinds counted together, each where the longest runs of the group before are repeated
COLUMNS = tuple(f"level{kind}" for kind in range(ORDERS))


def level(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEVELS, counts, side="right")


def shard_of(grams: np.ndarray, shards: int) -> np.ndarray:
    """By the high bits; within a shard the low ones tell runs apart (LOW), so that they need fewer bytes to move."""
    return ((grams >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)


def by_shard(own: np.ndarray, shards: int) -> np.ndarray:
    """The order by shard, within a shard as before; numbers of 16 bits are dealt without comparing them."""
    return np.argsort(own.astype(np.uint16) if shards <= 1 << 16 else own, kind="stable")


class Sorted:
    """Sorted hashes in which many others are looked up, from where their leading bits say."""

    def __init__(self, grams: np.ndarray):
        self.grams = np.append(grams, ~np.uint64(0))
        inside = np.bincount((grams >> np.uint64(48)).view(np.int64), minlength=1 << 16)
        self.first = np.cumsum(inside) - inside

    def places(self, asked: np.ndarray) -> np.ndarray:
        """As ``np.searchsorted`` gives them."""
        at = self.first.take((asked >> np.uint64(48)).view(np.int64))
        left = np.flatnonzero(self.grams.take(at) < asked)
        while len(left):
            at[left] += 1
            left = left[self.grams.take(at.take(left)) < asked.take(left)]
        return at


def packed(values: np.ndarray) -> bytes:
    """Sorted numbers as the gaps between them, each in as many bytes as the widest gap takes."""
    if not len(values):
        return b""
    gaps = np.concatenate((values[:1], np.diff(values)))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    return bytes([width]) + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    gaps = np.frombuffer(data, np.uint8, offset=1).reshape(-1, data[0])
    wide = np.zeros((len(gaps), 8), np.uint8)
    wide[:, : data[0]] = gaps
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def probe_words(grams: np.ndarray, at_level: np.ndarray | int, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The filter word of each (n-gram, level) within its shard, and the bits that stand for it there."""
    keys = mix((grams & LOW) + np.asarray(at_level).astype(np.uint64) * MULTIPLIERS[0])
    bits = TWO_BITS.take((keys & np.uint64(4095)).view(np.int64))
    bits |= TWO_BITS.take(((keys >> np.uint64(12)) & np.uint64(4095)).view(np.int64))
    keys >>= np.uint64(32)
    keys *= sizes.astype(np.uint64, copy=False)
    keys >>= np.uint64(32)
    return keys.view(np.int64), bits


def filter_bits(grams: np.ndarray, counts: np.ndarray, per_entry: int = BITS_PER_ENTRY) -> np.ndarray:
    """The filter part of one shard."""
    levels = level(counts)
    size = max(1, -(-int(levels.sum()) * per_entry // 64))
    bits = np.zeros(size, np.uint64)
    for step in range(1, int(levels.max(initial=0)) + 1):
        grams, levels = grams[levels >= step], levels[levels >= step]
        words, own = probe_words(grams, step, np.full(len(grams), size))
        np.bitwise_or.at(bits, words, own)
    return bits


@dataclass
class Filter:
    """Filter parts of some shards, one after the other; a shard that is not here has size 0."""

    bits: np.ndarray
    start: np.ndarray  # by kind and shard
    size: np.ndarray

    def levels(self, grams: np.ndarray, order: int) -> np.ndarray:
        """The level of each n-gram, 0 if it is not found or belongs to another part."""
        shard = shard_of(grams, self.start.shape[1])
        out = np.zeros(len(grams), np.uint8)
        start, size = self.start[order].take(shard), self.size[order].astype(np.uint64).take(shard)
        left = np.flatnonzero(size)
        grams, start, size = grams.take(left), start.take(left), size.take(left)
        for step in range(1, len(LEVELS) + 1):
            if not len(left):
                break
            words, bits = probe_words(grams, step, size)
            words += start
            here = np.flatnonzero(self.bits.take(words) & bits == bits)
            left, grams, start, size = left.take(here), grams.take(here), start.take(here), size.take(here)
            out[left] = step
        return out


class Lookup:
    """Levels of the n-grams of one order in a filter part; frequent ones, which take many probes, are remembered."""

    def __init__(self, known: Filter, order: int):
        self.known, self.order = known, order
        self.name = np.arange(1, REMEMBERED + 1, dtype=np.uint64)  # by low bits; at first, none is where it belongs
        self.level = np.zeros(REMEMBERED, np.uint8)

    def levels(self, grams: np.ndarray) -> np.ndarray:
        """As ``Filter.levels``; an n-gram may come more than once."""
        slot = (grams & np.uint64(REMEMBERED - 1)).view(np.int64)
        out = self.level.take(slot)
        other = np.flatnonzero(self.name.take(slot) != grams)
        asked, back = grams.take(other), slice(None)
        if not self.order:  # few words are new, but most runs are
            asked, back = np.unique(asked, return_inverse=True)
        found = self.known.levels(asked, self.order)
        out[other] = found[back]
        often = np.flatnonzero(found >= 4)
        slot = (asked.take(often) & np.uint64(REMEMBERED - 1)).view(np.int64)
        self.name[slot], self.level[slot] = asked.take(often), found.take(often)
        return out


def tokens_of(part: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of texts, each with one END, the tokens before them (START first), and where texts begin."""
    hashes, edges = word_hashes(part)
    tokens = np.insert(hashes, edges[1:], END)
    edges = edges + np.arange(len(edges))
    before = np.concatenate((tokens[:1], tokens[:-1]))
    before[edges[:-1]] = START
    return tokens, before, edges


def pair_hash(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mix(before * MULTIPLIERS[1] + tokens)


def runs_of(tokens: np.ndarray, before: np.ndarray, kinds: tuple[int, ...]) -> dict[int, np.ndarray]:
    """The hashes of the runs of each kind that end at each token; START counts as a word.

    Those at the first tokens of a text, where longer runs would begin before START, stand for nothing.
    """
    out = {0: tokens, 1: pair_hash(before, tokens)}
    for kind in range(2, max(kinds) + 1):
        last = out[kind - 1]
        out[kind] = pair_hash(np.concatenate((last[:1], last[:-1])), tokens)
    return {kind: out[kind] for kind in kinds}


def repeatable(levels: np.ndarray, low: int, kind: int, edges: np.ndarray) -> np.ndarray:
    """Where a run of ``kind`` can be repeated, by the levels of the runs of kind ``low``: all inside it are."""
    place = np.arange(len(levels)) - np.repeat(edges[:-1], np.diff(edges))
    twice = levels >= 2
    out = place >= kind - 1
    for back in range(kind - low + 1):
        out[back:] &= twice[: len(twice) - back]
    return out


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows of a binary column without nulls, and where each row's start (one more entry)."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in rows], dtype=np.int64)))


def summed(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams in order and their counts."""
    order = np.argsort(grams)
    grams, counts = grams[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))) if len(grams) else np.zeros(0, np.int64)
    return grams[first], np.add.reduceat(counts, first) if len(first) else counts


def packed_counts(texts: DataFrame, shards: int, kinds: tuple[int, ...]) -> DataFrame:
    """(kind, shard, once, more, counts): the n-grams of some kinds that a run of texts counts, one row a shard.

    A run has up to about TOKENS_AT_ONCE counted tokens, from however many batches; n-grams
    it has once need no count. Words are whole hashes, longer runs the low bits.
    Kinds above 1 are counted where the levels of the longest runs known so far allow a repeat.
    """
    low = min(kinds) - 1
    parsed = StructType.fromDDL("kind int, shard int, once binary, more binary, counts binary")
    target = to_arrow_schema(parsed)

    def counted(kind, held):
        out = {"kind": [], "shard": [], "once": [], "more": [], "counts": []}
        every = np.concatenate([h[kind] for h in held])
        if kind:
            # One number for shard and low bits, so that plain sorting deals and counts at once.
            every = (shard_of(every, shards).astype(np.uint64) << np.uint64(40)) | (every & LOW)
        grams, counts = np.unique(every, return_counts=True)
        if kind:
            own = (grams >> np.uint64(40)).astype(np.int64)
            grams = grams & LOW
        else:
            own = shard_of(grams, shards)
            order = by_shard(own, shards)
            own, grams, counts = own[order], grams[order], counts[order]
        alone = counts == 1
        sides = []
        for chosen in (alone, ~alone):
            sides += [grams[chosen], np.searchsorted(own[chosen], np.arange(shards + 1)).tolist()]
        once, once_at, more, more_at = sides
        times = counts[~alone].astype(np.uint32)
        for shard in np.unique(own).tolist():
            repeated = slice(more_at[shard], more_at[shard + 1])
            out["kind"].append(kind)
            out["shard"].append(shard)
            out["once"].append(packed(once[once_at[shard] : once_at[shard + 1]]))
            out["more"].append(packed(more[repeated]))
            out["counts"].append(times[repeated].tobytes())
        return to_batch(out, target)

    def run(batches):
        held: list[dict[int, np.ndarray]] = []
        waiting = 0
        for batch in slices(batches):
            levels = batch.column(1).to_pylist() if low > 0 else None
            first = 0
            for part in text_parts(batch.column(0).to_pylist()):
                tokens, before, edges = tokens_of(part)
                runs = runs_of(tokens, before, kinds)
                if levels is not None:
                    known = np.frombuffer(b"".join(levels[first : first + len(part)]), np.uint8)
                    runs = {kind: grams[repeatable(known, low, kind, edges)] for kind, grams in runs.items()}
                first += len(part)
                held.append(runs)
                waiting += max(map(len, runs.values()))
                if waiting >= TOKENS_AT_ONCE:
                    for kind in kinds:
                        yield counted(kind, held)
                    held, waiting = [], 0
        if held:
            for kind in kinds:
                yield counted(kind, held)

    rows = texts.select("body", *([COLUMNS[low]] if low > 0 else []))
    return rows.mapInArrow(run, parsed)


def merged_counts(packed: DataFrame) -> DataFrame:
    """A row a kind and shard: filter bits, sums, and for words the exact counts; longer runs only if repeated."""
    schema = "kind int, shard int, tokens long, kinds long, bits binary, grams binary, counts binary"
    parsed = StructType.fromDDL(schema)
    target = to_arrow_schema(parsed)
    per_entry = BITS_PER_ENTRY

    def run(batches):
        for group in group_runs(batches, ("kind", "shard")):
            once = [unpacked(g) for g in group["once"].to_pylist()]
            more = [unpacked(g) for g in group["more"].to_pylist()]
            times = [np.frombuffer(c, np.uint32).astype(np.int64) for c in group["counts"].to_pylist()]
            alone = np.ones(sum(len(g) for g in once), np.int64)
            grams, counts = summed(np.concatenate(once + more), np.concatenate([alone, *times]))
            kind = group["kind"][0].as_py()
            words = kind == 0
            if kind > 1:
                grams, counts = grams[counts > 1], counts[counts > 1]
            yield to_batch(
                {
                    "kind": [kind], "shard": [group["shard"][0].as_py()], "tokens": [int(counts.sum())],
                    "kinds": [len(grams)], "bits": [filter_bits(grams, counts, per_entry).tobytes()],
                    "grams": [grams.tobytes() if words else b""], "counts": [counts.tobytes() if words else b""],
                },
                target,
            )

    return packed.repartition("kind", "shard").sortWithinPartitions("kind", "shard").mapInArrow(run, parsed)


def filter_plan(counted: DataFrame) -> list[list[tuple[int, int, int]]]:
    """(kind, shard, words) of what each part of the filter holds, parts of at most about ROUND_BYTES; one part at least."""
    sizes = counted.select("kind", "shard", F.octet_length("bits").alias("size")).collect()
    rounds: list[list] = [[]]
    total = 0
    for row in sorted(sizes, key=lambda r: (r["shard"], r["kind"])):
        if total + row["size"] > ROUND_BYTES and rounds[-1]:
            rounds.append([])
            total = 0
        rounds[-1].append((row["kind"], row["shard"], row["size"] // 8))
        total += row["size"]
    return rounds


def filter_part(counted: DataFrame, shards: int, chosen: list[tuple[int, int, int]]):
    """One part of the filter as a broadcast; the driver holds it once."""
    start, size = np.zeros((ORDERS, shards), np.int64), np.zeros((ORDERS, shards), np.int64)
    at = 1
    for kind, shard, words in chosen:
        start[kind, shard], size[kind, shard] = at, words
        at += words
    bits = np.zeros(at, np.uint64)
    if chosen:
        low, high = min(s for _, s, _ in chosen), max(s for _, s, _ in chosen)
        rows = counted.filter(F.col("shard").between(low, high)).select("kind", "shard", "bits")
        for row in rows.toLocalIterator():
            here, words = start[row["kind"], row["shard"]], size[row["kind"], row["shard"]]
            if words:
                bits[here : here + words] = np.frombuffer(row["bits"], np.uint64)
    return counted.sparkSession.sparkContext.broadcast(Filter(bits, start, size))


def with_levels(rows: DataFrame, shared, kinds: tuple[int, ...], more: bool, following: int | None) -> DataFrame:
    """Add the levels that one filter part knows of n-grams of some kinds (a column a kind, a byte a token).

    The text is kept while ``more`` parts follow for these kinds; after the last, only
    where a run of the kind ``following`` can be repeated. A text left out has level 0.
    """
    low = min(kinds) - 1
    first_kind = low < 0
    older = COLUMNS[: low + 1]

    def make():
        known = {kind: Lookup(shared.value, kind) for kind in kinds}

        def work(batch):
            bodies = batch["body"].to_pylist()
            # Without a text: not needed any more, as no run of these kinds can be repeated there.
            here = [i for i, body in enumerate(bodies) if body is not None]
            lower = None if first_kind else batch[COLUMNS[low]].to_pylist()
            own = {kind: [None] * len(bodies) for kind in kinds}
            kept = list(bodies) if more else [None] * len(bodies)
            at = 0
            for part in text_parts([bodies[i] for i in here]):
                names = here[at : at + len(part)]
                at += len(part)
                tokens, before, edges = tokens_of(part)
                may = {}
                if lower is not None:
                    levels = np.frombuffer(b"".join(lower[i] for i in names), np.uint8)
                    may = {kind: repeatable(levels, low, kind, edges) for kind in kinds}
                for kind, grams in runs_of(tokens, before, kinds).items():
                    where = may.get(kind, slice(None))
                    found = np.zeros(len(tokens), np.uint8)
                    found[where] = known[kind].levels(grams[where])
                    old = [batch[COLUMNS[kind]][i].as_py() for i in names]
                    if old and old[0] is not None:
                        found += np.frombuffer(b"".join(old), np.uint8)
                    for i, a, b in zip(names, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                        own[kind][i] = found[a:b].tobytes()
                if not more and following is not None:
                    again = np.logical_or.reduceat(repeatable(found, kind, following, edges), edges[:-1])
                    for i, needed in zip(names, again.tolist(), strict=True):
                        kept[i] = bodies[i] if needed else None
            out = {n: batch[n] for n in ("id", "digest", "held_out", *older)}
            if len(here) < len(bodies):
                sizes = [len(v) for v in batch[COLUMNS[0]].to_pylist()]
                for values in own.values():
                    for i, value in enumerate(values):
                        if value is None:
                            values[i] = bytes(sizes[i])
            out |= {COLUMNS[kind]: own[kind] for kind in kinds}
            return out | ({"body": kept} if more or following is not None else {})

        return work

    rows = rows.select(
        "id", "digest", "held_out", "body", *older,
        *(F.col(c) if c in rows.columns else F.lit(None).cast("binary").alias(c) for c in (COLUMNS[k] for k in kinds)),
    )
    names = [*older, *(COLUMNS[kind] for kind in kinds)] + ["body"] * (more or following is not None)
    return arrow_map(rows, make, "id long, digest long, held_out boolean, " + ", ".join(f"{n} binary" for n in names))


def frequencies(levels: list[np.ndarray], edges: np.ndarray, start_level: int, left_out: int):
    """By kind from 1 up: the level of each token's context and the run's relative frequency after it."""
    for kind in range(1, ORDERS):
        context = np.concatenate((levels[kind - 1][:1], levels[kind - 1][:-1])).astype(np.int64)
        context[edges[:-1]] = start_level if kind == 1 else 0
        part = np.maximum(COUNTS[levels[kind]] - left_out, 0) / np.maximum(COUNTS[context] - left_out, 1)
        yield kind, context, np.where(context > 0, np.minimum(part, 1), 0.0)


def weights(levels: DataFrame, start_level: int, tokens: int, kinds: int) -> np.ndarray:
    """By kind and level of the context: how much the run's frequency counts, from all training tokens.

    Every training token is left out of its own counts. For pairs the tokens come as a
    histogram of their three levels, for longer runs as counts by level of the context;
    both have a bounded number of rows.
    """

    def make():
        base = (np.maximum(COUNTS - 1, 0) + 0.5) / (tokens + 0.5 * (kinds + 1))

        def work(batch):
            own, edges = flat(batch[COLUMNS[0]])
            every = [own] + [flat(batch[c])[0] for c in COLUMNS[1:]]
            best = base[own]
            keys, wins, times = [], [], []
            for kind, context, part in frequencies(every, edges, start_level, 1):
                if kind == 1:
                    packed, count = np.unique((context << 16) | (every[1].astype(np.int64) << 8) | own, return_counts=True)
                    won = np.zeros(len(packed), np.int64)
                else:
                    count = np.bincount(context, minlength=len(COUNTS))
                    won = np.bincount(context[(part > 0) & (part >= best)], minlength=len(COUNTS))
                    seen = np.flatnonzero(count)
                    packed, count, won = (kind << 32) | seen, count[seen], won[seen]
                best = np.maximum(best, part)
                keys.append(packed)
                wins.append(won)
                times.append(count)
            return {"key": np.concatenate(keys), "wins": np.concatenate(wins), "times": np.concatenate(times)}

        return work

    made = arrow_map(levels.filter(~F.col("held_out")).select(*COLUMNS), make, "key long, wins long, times long")
    found = made.groupBy("key").agg(F.sum("wins").alias("wins"), F.sum("times").alias("times")).toArrow()
    share = np.zeros((ORDERS, len(COUNTS)))
    share[1] = 0.1
    if not found.num_rows:
        return share
    keys, wins, times = (found[n].to_numpy() for n in ("key", "wins", "times"))
    for kind in range(2, ORDERS):
        chosen = (keys >> 32) == kind
        at = keys[chosen] & 255
        share[kind, at] = (wins[chosen] + 0.1) / (times[chosen] + 1)
        share[kind, 0] = 0
    keys, times = keys[keys >> 32 == 0], times[keys >> 32 == 0]
    before, pair, own = keys >> 16, (keys >> 8) & 255, keys & 255
    frequency = np.clip(np.maximum(COUNTS[pair] - 1, 0) / np.maximum(COUNTS[before] - 1, 1), 0, 1)
    base = (np.maximum(COUNTS[own] - 1, 0) + 0.5) / (tokens + 0.5 * (kinds + 1))
    pairs = share[1]
    for _ in range(30):
        mixed = pairs[before] * frequency
        part = times * mixed / (mixed + (1 - pairs[before]) * base)
        pairs = (np.bincount(before, part, len(pairs)) + 0.1) / (np.bincount(before, times, len(pairs)) + 1)
    share[1] = pairs
    return share


def scored(levels: DataFrame, share: np.ndarray, start_level: int, tokens: int, kinds: int) -> DataFrame:
    """(id, digest, held_out, n_tokens, score) from the levels."""
    shared = levels.sparkSession.sparkContext.broadcast(share)

    def make():
        mix_share = shared.value
        base = (COUNTS + 0.5) / (tokens + 0.5 * (kinds + 1))

        def work(batch):
            own, edges = flat(batch[COLUMNS[0]])
            every = [own] + [flat(batch[c])[0] for c in COLUMNS[1:]]
            chance = base[own]
            for kind, context, part in frequencies(every, edges, start_level, 0):
                # The context of a pair's first word is the text's start, which every text has.
                weight = mix_share[kind][context]
                chance = weight * part + (1 - weight) * chance
            scores = np.add.reduceat(np.log10(chance), edges[:-1])
            return {n: batch[n] for n in ("id", "digest", "held_out")} | {"n_tokens": np.diff(edges), "score": scores}

        return work

    return arrow_map(levels, make, "id long, digest long, held_out boolean, n_tokens long, score double")


def base_scores(texts: DataFrame, counted: DataFrame, shards: int, tokens: int, kinds: int) -> DataFrame:
    """(id, digest, n_known, base_score) with exact counts, by meeting each shard's words with its counts."""
    words = counted.filter("kind = 0")
    spark = texts.sparkSession
    least = max(1, tokens // HOT_SHARE + 1)
    total = tokens + 0.5 * (kinds + 1)

    def frequent(batches):
        for batch in batches:
            for grams, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams, counts = np.frombuffer(grams, np.uint64), np.frombuffer(counts, np.int64)
                keep = counts >= least
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[keep].view(np.int64)), pa.array(counts[keep])], names=["gram", "times"]
                )

    hot = words.select("grams", "counts").mapInArrow(frequent, "gram long, times long").toArrow()
    hot_grams = hot["gram"].to_numpy().view(np.uint64)
    order = np.argsort(hot_grams)
    known = spark.sparkContext.broadcast((hot_grams[order], hot["times"].to_numpy()[order]))

    def split():
        grams, counts = known.value
        logs = np.log10((counts + 0.5) / total)
        table = Sorted(grams)

        def work(batch):
            ids, digests = batch["id"].to_numpy(zero_copy_only=False), batch["digest"].to_numpy()
            missing = np.asarray(batch["id"].is_null())
            ids = np.where(missing, 0, ids).astype(np.int64)
            out = {n: [] for n in ("shard", "kind", "part", "grams", "counts", "owners")}
            first = 0
            for part in text_parts(batch["body"].to_pylist(), RUN_BYTES):
                tokens, _, edges = tokens_of(part)
                size = len(edges) - 1
                rows = slice(first, first + size)
                first += size
                owner = np.repeat(np.arange(size), np.diff(edges))
                at = np.minimum(table.places(tokens), max(0, len(grams) - 1))
                is_hot = grams[at] == tokens if len(grams) else np.zeros(len(tokens), bool)
                about = np.stack((ids[rows], digests[rows], missing[rows]))
                sums = np.bincount(owner[is_hot], logs[at[is_hot]], size)
                name = int(xxhash.xxh3_64_intdigest(about.tobytes())) - (1 << 63)
                pieces = [(-1, np.bincount(owner[is_hot], minlength=size).astype(np.int64), sums, about)]
                tokens, owner = tokens[~is_hot], owner[~is_hot]
                own = shard_of(tokens, shards)
                turn = by_shard(own, shards)
                cuts = np.searchsorted(own[turn], np.arange(shards + 1))
                for shard in np.flatnonzero(np.diff(cuts)):
                    place = turn[cuts[shard] : cuts[shard + 1]]
                    pieces.append((int(shard), tokens[place], np.zeros(0), owner[place].astype(np.uint32)))
                for shard, values, extra, owners in pieces:
                    for column, value in zip(
                        out, (shard, 1, name, values.tobytes(), extra.tobytes(), owners.tobytes()), strict=True
                    ):
                        out[column].append(value)
            return out

        return work

    # Shard -1 holds a run's rows and what frequent words give them; the others a run's words of a shard.
    packed = arrow_map(
        texts.select("id", "digest", "body"), split,
        "shard int, kind int, part long, grams binary, counts binary, owners binary", 8 << 20,
    )
    none = F.lit(None)
    tables = words.select(
        "shard", F.lit(0).alias("kind"), none.cast("long").alias("part"), "grams", "counts",
        none.cast("binary").alias("owners"),
    )
    looked = StructType.fromDDL("part long, owners binary, n_known binary, sums binary")
    looked_target = to_arrow_schema(looked)

    def look_up(batches):
        grams = counts = np.zeros(0, np.uint64)
        table = current = None
        for batch in batches:
            for number in range(batch.num_rows):
                row = batch.slice(number, 1).to_pylist()[0]
                if row["shard"] != current:
                    current, grams, counts = row["shard"], np.zeros(0, np.uint64), np.zeros(0, np.int64)
                if row["kind"] == 0:
                    grams, counts = np.frombuffer(row["grams"], np.uint64), np.frombuffer(row["counts"], np.int64)
                    table = Sorted(grams)
                    continue
                tokens, owner = np.frombuffer(row["grams"], np.uint64), np.frombuffer(row["owners"], np.uint32)
                found = np.zeros(len(tokens), np.int64)
                if len(grams):
                    at = np.minimum(table.places(tokens), len(grams) - 1)
                    found = np.where(grams[at] == tokens, counts[at], 0)
                rows, where = np.unique(owner, return_inverse=True)
                known_here = np.bincount(where[found > 0], minlength=len(rows)).astype(np.int64)
                sums = np.bincount(where, np.log10((found + 0.5) / total), len(rows))
                yield to_batch(
                    {
                        "part": [row["part"]], "owners": [rows.astype(np.uint32).tobytes()],
                        "n_known": [known_here.tobytes()], "sums": [sums.tobytes()],
                    },
                    looked_target,
                )

    parsed = StructType.fromDDL("id long, digest long, n_known long, sum double, rows long")
    target = to_arrow_schema(parsed)

    def gather(batches):
        for group in group_runs(batches, ("part",)):
            about = n_known = sums = None
            warm = 0
            rows = sorted(group.to_pylist(), key=lambda r: r["kind"])  # the run's own rows first
            for row in rows:
                if row["kind"] == 0:
                    warm += 1
                    if about is None:
                        about = np.frombuffer(row["owners"], np.int64).reshape(3, -1)
                        n_known, sums = np.zeros(about.shape[1], np.int64), np.zeros(about.shape[1])
                    n_known += np.frombuffer(row["n_known"], np.int64)
                    sums += np.frombuffer(row["sums"], np.float64)
                else:
                    owner = np.frombuffer(row["owners"], np.uint32)
                    n_known[owner] += np.frombuffer(row["n_known"], np.int64)
                    sums[owner] += np.frombuffer(row["sums"], np.float64)
            ids = pa.array(about[0], mask=about[2].astype(bool))
            yield to_batch(
                {"id": ids, "digest": about[1], "n_known": n_known, "sum": sums, "rows": np.full(len(sums), warm)}, target
            )

    cold = packed.filter("shard >= 0").unionByName(tables)
    cold = cold.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(look_up, looked)
    warm = packed.filter("shard < 0").select(
        "part", "owners", F.col("grams").alias("n_known"), F.col("counts").alias("sums"), F.lit(0).alias("kind")
    )
    every = warm.unionByName(cold.withColumn("kind", F.lit(1)))
    every = every.repartition("part").sortWithinPartitions("part").mapInArrow(gather, parsed)
    # Rows repeated with the same text add up to a multiple.
    return every.groupBy("id", "digest").agg(
        F.expr("sum(n_known) div sum(rows)").alias("n_known"), (F.sum("sum") / F.sum("rows")).alias("base_score")
    )


def both_scores(df: DataFrame, texts: DataFrame, text: str) -> tuple[DataFrame, DataFrame, int]:
    """Scores, exact base scores and the number of training tokens; all that holds texts or levels is done when it returns."""
    size = df.agg(F.sum(F.octet_length(text)).alias("size")).first()["size"] or 0
    shards = int(size // SHARD_BYTES) + 1
    training = texts.filter(~F.col("held_out"))
    levels = texts
    counted, counted_at = stage_at(merged_counts(packed_counts(training, shards, GROUPS[0])), MOVED_BYTES)
    sums = counted.filter("kind = 0").agg(F.sum("tokens").alias("tokens"), F.sum("kinds").alias("kinds")).first()
    tokens, kinds = sums["tokens"] or 0, sums["kinds"] or 0
    start_level = int(level(np.array([training.count()]))[0])
    found, last = counted, None
    for number, group in enumerate(GROUPS):
        if number:
            wanted = levels.filter(~F.col("held_out") & F.col("body").isNotNull())
            found, found_at = stage_at(merged_counts(packed_counts(wanted, shards, group)), MOVED_BYTES)
        following = GROUPS[number + 1][0] if number + 1 < len(GROUPS) else None
        plan = filter_plan(found)
        for part, chosen in enumerate(plan, 1):
            shared = filter_part(found, shards, chosen)
            made, made_at = stage_at(with_levels(levels, shared, group, part < len(plan), following), MOVED_BYTES, **LEVEL_FILES)
            shared.unpersist()  # the levels are written, executors need it no longer
            del shared  # nor does the driver, while it puts the next part together
            if last:
                release(levels, last)
            levels, last = made, made_at
        if number:
            release(found, found_at)
    share = weights(levels, start_level, tokens, kinds)
    scores, _ = stage_at(scored(levels, share, start_level, tokens, kinds), MOVED_BYTES)
    release(levels, last)
    exact, _ = stage_at(base_scores(texts, counted, shards, tokens, kinds), MOVED_BYTES)
    release(counted, counted_at)
    return scores, exact, tokens


def lm_score(df: DataFrame, key: str = "doc_id", text: str = "text", parts: int = 5) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``df``.

    Learns from rows whose fold is not 1. Null and empty texts are one END token. Rows
    with a null key are scored but not learned from. Repeated rows are counted, and
    scored, as often as they come. Without any training row every count is 0.
    """
    texts = df.select(
        F.col(key).cast("long").alias("id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("body"),
        held_out(key, parts).alias("held_out"),
    ).withColumn("digest", F.xxhash64("body"))
    with small_batches(df.sparkSession, MOVED_BYTES):
        scores, exact, tokens = both_scores(df, texts, text)
    exact = exact.withColumnsRenamed({"id": "other_id", "digest": "other_digest"})
    joined = scores.join(exact, scores.id.eqNullSafe(exact.other_id) & (scores.digest == exact.other_digest))
    return joined.select(
        F.col("id").alias(key), "held_out", "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"),
        "base_score", "score",
    )
