"""N-gram Jaccard join with signature trees.

Documents are sets of word shingles; two link when their Jaccard similarity reaches a
percentage. Equal sets are one class and are never compared. Candidates meet in buckets:

* first in the buckets of a few minimum hashes, which join most copies of a family, so
* that of the buckets of the exact prefix filter (all shingles a similar set must share
  at least one of) only those holding classes of different components are left.

In a bucket a *signature tree* is bulk-loaded: its nodes hold the OR of their members'
bitmaps, the range of set sizes and the largest number of shingles that share a bit. Two
trees (or one with itself) are walked together, level by level, and a pair of nodes is
dropped when the largest possible overlap is below what the smallest sizes demand, or
when all below it is one component already. Pairs of leaves that are left are verified on
the whole sets. A bucket of any size is dealt out as pairs of blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .components import components
from .frames import FILTER_BITS, arrow_map, filter_slot, id_filter, in_filter, release, stage, stage_at, to_batch
from .words import mix, shingle_sets, text_parts, word_hashes

SIGNATURE_BITS = 1 << 13  # most bits of a signature; a set of n shingles has about n
WIDE = 4  # how many times more bits the wide signature has
MINIMA = 3
BLOCK_ROWS, BLOCK_SHINGLES = 1500, 700_000
LIGHT_ROWS = 6000
COMMON, COUNTED = 100_000, 8
FANOUT = 8
CHUNK_BYTES = 4 << 20  # bitmaps compared at once
CHUNK = 1 << 15


def bitmap(shingles: np.ndarray, bits: int) -> np.ndarray:
    """Bits taken from the middle of the hash, as its top decides the order."""
    out = np.zeros(bits // 64, np.uint64)
    slot = (shingles >> np.uint64(20)) % np.uint64(bits)
    np.bitwise_or.at(out, (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63)))
    return out


def common_words(df: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the words that make up at least 1/COMMON of all words, and a weight by their logarithm.

    At most COMMON words can. Each batch of texts counts its own words and passes on those
    it has COUNTED times; so counts are slightly low, which moves cost but no result: any
    one order of all shingles is right for the prefix filter.
    """

    def make():
        def work(batch):
            tokens = np.concatenate([word_hashes(part)[0] for part in text_parts(batch["body"].to_pylist())])
            kinds, counts = np.unique(tokens, return_counts=True)
            keep = counts >= COUNTED
            return {
                "word": np.append(kinds[keep].view(np.int64), 0), "times": np.append(counts[keep], len(tokens)),
                "total": np.append(np.zeros(int(keep.sum()), bool), True),
            }

        return work

    rows = arrow_map(df.select(F.col(text).cast("binary").alias("body")), make, "word long, times long, total boolean")
    sums = stage(rows.groupBy("word", "total").agg(F.sum("times").alias("times")))
    total = sums.filter("total").first()
    least = total["times"] / COMMON if total else 1
    found = sums.filter(~F.col("total") & (F.col("times") >= least)).select("word", "times").toArrow()
    keys, times = found["word"].to_numpy().view(np.uint64), found["times"].to_numpy()
    order = np.argsort(keys)
    weights = np.clip(np.round(4 * np.log2(np.maximum(times / max(least, 1e-9), 1)) + 1), 1, 63).astype(np.int64)
    return keys[order], weights[order]


def describe(df: DataFrame, key: str, text: str, words: int, percent: int, common) -> DataFrame:
    """(id, n, digest, signature, minima, prefix) for every row."""

    def make():
        salts = [mix(np.uint64(0x5851F42D4C957F2D) * np.array([i + 1], np.uint64)) | np.uint64(1) for i in range(MINIMA)]

        def work(batch):
            sizes, digests, signatures, wides, minima, prefixes = [], [], [], [], [], []
            for found in shingle_sets(batch["body"].to_pylist(), words, common.value):
                n = len(found)
                sizes.append(n)
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                bits = min(SIGNATURE_BITS, max(64, 1 << (n - 1).bit_length()))
                wide = bitmap(found, WIDE * bits)
                signatures.append(np.bitwise_or.reduce(wide.reshape(WIDE, -1), axis=0).tobytes())
                wides.append(wide.tobytes())
                minima.append([int((found * s).min().view(np.int64)) for s in salts] if n else [])
                share = n - (percent * n + 99) // 100 + 1 if n else 0
                prefixes.append(found[:share].view(np.int64).copy())
            return {
                "id": batch["id"], "n": sizes, "digest": digests, "signature": signatures, "wide": wides, "minima": minima,
                "prefix": prefixes,
            }

        return work

    source = df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("body"))
    return arrow_map(
        source, make,
        "id long, n long, digest binary, signature binary, wide binary, minima array<long>, prefix array<long>",
    )


def shingles_of(df: DataFrame, key: str, text: str, words: int, common, wanted: DataFrame) -> DataFrame:
    """(digest, shingles) of the classes in ``wanted`` (id, digest), straight from the texts, dealt by digest.

    A bitmap of fixed size thins the rows inside the scan, so texts are never shuffled.
    """
    known = df.sparkSession.sparkContext.broadcast(id_filter(wanted, filter_slot("id")))

    def make():
        def work(batch):
            keep = np.flatnonzero(in_filter(known.value, np.asarray(batch["slot"])))
            digests, packed = [], []
            for found in shingle_sets(batch["body"].take(pa.array(keep)).to_pylist(), words, common.value):
                data = found.tobytes()
                digests.append(xxhash.xxh3_128_digest(data))
                packed.append(data)
            return {"digest": digests, "shingles": packed}

        return work

    source = (
        df.filter(F.col(key).isNotNull())
        .select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("body"))
        .withColumn("slot", filter_slot("id"))
    )
    made = arrow_map(source, make, "digest binary, shingles binary")
    return made.join(wanted.select("digest").distinct(), "digest", "left_semi").dropDuplicates(["digest"])


def dealt(rows: DataFrame, sizes: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` (bucket, code, n, …) dealt to pairs of blocks; ``sizes`` has rows and shingles of a bucket.

    A bucket of one block is one group. A larger one has a group for each pair of its
    blocks; ``side`` says which of the two a row is in (both, if the pair is one block).
    """
    blocks = F.ceil(F.col("bucket_rows") / block_rows)
    if block_rows == BLOCK_ROWS:
        blocks = F.greatest(blocks, F.ceil(F.col("bucket_shingles") / BLOCK_SHINGLES))
    known = sizes.select("bucket", blocks.cast("int").alias("blocks"))
    zero = F.lit(0)
    small = (
        rows.join(known.filter("blocks = 1").select("bucket"), "bucket")
        .withColumns({"first": zero, "second": zero, "side": F.lit(2)})
    )
    large = (
        rows.join(known.filter("blocks > 1"), "bucket")
        .withColumn("own", F.pmod("code", F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1)))
        .withColumn("first", F.least("own", "other")).withColumn("second", F.greatest("own", "other"))
        .withColumn("side", F.when(F.col("first") == F.col("second"), 2).when(F.col("own") == F.col("first"), 0).otherwise(1))
        .drop("blocks", "own", "other")
    )
    return small.unionByName(large)


class Tree:
    """Levels of nodes from leaves to root; node i of a level covers FANOUT nodes of the level below."""

    def __init__(self, bits, excess, sizes, groups, period):
        level = (bits, excess, sizes, sizes, groups, groups, period)
        self.levels = [level]
        joins = (np.bitwise_or, np.maximum, np.minimum, np.maximum, np.minimum, np.maximum, np.maximum)
        while len(level[1]) > 1:
            starts = np.arange(0, len(level[1]), FANOUT)
            level = tuple(join.reduceat(column, starts, axis=0) for join, column in zip(joins, level, strict=True))
            self.levels.append(level)


def possible(one, two, i, j, percent):
    """``fitting_nodes`` for any number of pairs, as many at once as CHUNK_BYTES of bitmaps allow."""
    step = max(1, CHUNK_BYTES // (8 * one[0].shape[1]))
    parts = [fitting_nodes(one, two, i[a : a + step], j[a : a + step], percent) for a in range(0, len(i), step)]
    return np.concatenate(parts)


def fitting_nodes(one, two, i, j, percent):
    """Whether some pair below nodes i and j can still be similar and is not one component already.

    Shingles that two sets share set bits in both, and at most ``excess`` of a set's shingles
    set no bit of their own. Bitmaps repeat with their ``period``, in words.
    """
    bits1, excess1, small1, large1, low1, high1, period1 = (c[i] for c in one)
    bits2, excess2, small2, large2, low2, high2, period2 = (c[j] for c in two)
    overlap = np.bitwise_count(bits1 & bits2).sum(axis=1, dtype=np.int64)
    overlap = overlap * np.maximum(period1, period2) // bits1.shape[1]
    overlap += np.minimum(excess1, excess2)
    overlap = np.minimum(overlap, np.minimum(large1, large2))
    fits = overlap * (100 + percent) >= percent * (small1 + small2)
    fits &= (large1 * 100 >= small2 * percent) & (large2 * 100 >= small1 * percent)
    return fits & ~((low1 == high1) & (low2 == high2) & (low1 == low2))


def walk(one: Tree, two: Tree | None, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of leaves that may be similar, in bounded chunks; with ``two`` None, pairs within ``one``."""
    same = two is None
    two = one if same else two
    top1, top2 = len(one.levels) - 1, len(two.levels) - 1
    stack = [(top1, top2, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level1, level2, i, j = stack.pop()
        keep = possible(one.levels[level1], two.levels[level2], i, j, percent)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if level1 == 0 and level2 == 0:
            if same:
                apart = i != j
                i, j = i[apart], j[apart]
            yield i, j
            continue
        for start in range(0, len(i), CHUNK // FANOUT**2):
            a, b = i[start : start + CHUNK // FANOUT**2], j[start : start + CHUNK // FANOUT**2]
            next1, next2 = level1, level2
            if level1 >= level2 and level1 > 0:
                a, b, next1 = *children(a, b, len(one.levels[level1 - 1][1])), level1 - 1
            if level2 >= level1 and level2 > 0:
                b, a, next2 = *children(b, a, len(two.levels[level2 - 1][1])), level2 - 1
            if same:
                ordered = a <= b
                a, b = a[ordered], b[ordered]
            stack.append((next1, next2, a, b))


def children(opened: np.ndarray, kept: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    below = (opened[:, None] * FANOUT + np.arange(FANOUT)[None, :]).ravel()
    kept = np.repeat(kept, FANOUT)
    real = below < count
    return below[real], kept[real]


def group_runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [np.asarray(batch.column(batch.schema.get_field_index(k))) for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        edges = [0, *change.tolist(), batch.num_rows]
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(c[start] for c in columns)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


GROUP = ("bucket", "first", "second")


def by_group(rows: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on each block pair; many small groups share a task and its Arrow batches."""
    parsed = StructType.fromDDL(schema)
    target = to_arrow_schema(parsed)
    names = [f.name for f in parsed]

    def run(batches):
        out = {n: [] for n in names}
        for group in group_runs(batches, GROUP):
            if group.num_rows > 1:
                for name, values in zip(names, work(group), strict=True):
                    out[name].extend(values)
            if len(out[names[0]]) >= 5000:
                yield to_batch(out, target)
                out = {n: [] for n in names}
        yield to_batch(out, target)

    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(run, parsed)


def fitting(group: pa.Table, percent: int) -> tuple[list]:
    """Rows of a bucket with a partner of another component that their sizes and the shingle's places allow.

    A shingle at place p of a set of n is the first of at most n - p that two sets share
    if they share none before; where they do, they meet in that one's bucket too.
    """
    n, place, groups = (np.asarray(group[c]) for c in ("n", "place", "component"))
    left, right = sides(np.asarray(group["side"]), n)
    right = left if right is None else right
    rest = n - place
    pairs = Pairs(group["code"])
    for start in range(0, len(left), 500):
        i = left[start : start + 500][:, None]
        j = right[None, :]
        fits = np.minimum(rest[i], rest[j]) * (100 + percent) >= percent * (n[i] + n[j])
        fits &= groups[i] != groups[j]
        a, b = np.nonzero(fits)
        pairs.add(i[a, 0], j[0, b])
    return pairs.buckets()


class Pairs:
    """Pairs of rows that may be similar, given on as buckets named by their members.

    While there are no more pairs than rows, each pair is a bucket, so that a pair that
    meets in many buckets is one in the end; else, or if ``whole``, all rows in pairs are
    one bucket.
    """

    def __init__(self, codes: pa.ChunkedArray, whole: bool = False):
        self.codes = np.asarray(codes)
        self.seen = np.zeros(len(self.codes), bool)
        self.found: set[tuple[int, int]] | None = None if whole else set()

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self.seen[i] = True
        self.seen[j] = True
        if self.found is not None and len(i) <= 2 * len(self.codes):
            one, two = self.codes[i], self.codes[j]
            self.found.update(zip(np.minimum(one, two).tolist(), np.maximum(one, two).tolist(), strict=True))
        if len(i) > 2 * len(self.codes) or self.found is not None and len(self.found) > len(self.codes):
            self.found = None

    def buckets(self) -> tuple[list, list]:
        if self.found is None:
            return named(self.codes[self.seen].tolist())
        names, members = [], []
        for pair in self.found:
            name, both = named(pair)
            names += name
            members += both
        return names, members


def named(members) -> tuple[list, list]:
    """Bucket name from the members, and the members."""
    members = sorted(members)
    return [xxhash.xxh3_64_intdigest(repr(members).encode()) - (1 << 63)] * len(members), members


def sides(side: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Rows of either side in tree order; one block with itself has one side only."""
    place = np.argsort(order, kind="stable")
    if side[0] == 2:
        return place, None
    return place[side[place] == 0], place[side[place] == 1]


def meeting(group: pa.Table, percent: int, column: str, whole: bool = False) -> tuple[list]:
    """Rows of a bucket that may be similar to a row of another component, by signatures alone.

    They get a bucket named by the hash of its members, so equal ones fall together; ``whole``
    keeps those of a bucket in one.
    """
    n = np.asarray(group["n"])
    own = [np.frombuffer(s, np.uint64) for s in group[column].to_pylist()]
    width = max(map(len, own))
    # A narrow signature repeated to a wider width still has a bit wherever a shared shingle sets one.
    bits = np.stack([np.tile(s, width // len(s)) for s in own])
    excess = n - np.array([np.bitwise_count(s).sum(dtype=np.int64) for s in own])
    period = np.array([len(s) for s in own])
    groups = np.asarray(group["component"])
    left, right = sides(np.asarray(group["side"]), n)
    if not len(left) or right is not None and not len(right):
        return [], []
    trees = [None if p is None else Tree(bits[p], excess[p], n[p], groups[p], period[p]) for p in (left, right)]
    pairs = Pairs(group["code"], whole)
    for i, j in walk(*trees, percent):
        pairs.add(left[i], (left if right is None else right)[j])
    return pairs.buckets()


def linked(group: pa.Table, percent: int) -> tuple[list, list]:
    """(member, smallest member) of the verified components of a group's rows."""
    sets = [np.frombuffer(s, np.uint64) for s in group["shingles"].to_pylist()]
    ids, groups = np.asarray(group["id"]), np.asarray(group["component"])
    n = np.array([len(s) for s in sets], np.int64)
    width = int(min(1 << 16, max(1024, 1 << int(4 * n.max() - 1).bit_length())))
    bits = np.stack([bitmap(s, width) for s in sets])
    excess = n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    parent = np.arange(len(ids))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    known: dict[int, int] = {}
    for at, value in enumerate(groups.tolist()):
        parent[at] = known.setdefault(value, at)
    left, right = sides(np.asarray(group["side"]), n)
    made = []
    if len(left) and (right is None or len(right)):
        period = np.full(len(n), width // 64)
        trees = [None if p is None else Tree(bits[p], excess[p], n[p], groups[p], period[p]) for p in (left, right)]
        for i, j in walk(*trees, percent):
            i, j = left[i], (left if right is None else right)[j]
            roots = np.fromiter(map(root, range(len(ids))), np.int64, len(ids))
            apart = roots[i] != roots[j]
            for a, b in zip(i[apart].tolist(), j[apart].tolist(), strict=True):
                one, two = root(a), root(b)
                if one == two:
                    continue
                shared = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if shared * 100 >= percent * (n[a] + n[b] - shared):
                    parent[two] = one
                    made.append((ids[a], ids[b]))
    firsts: dict[int, int] = {}
    if not made:
        return [], []
    touched = {x for pair in made for x in pair}
    places = {int(ids[at]): at for at in range(len(ids)) if ids[at] in touched}
    for value, at in places.items():
        top = root(at)
        firsts[top] = min(firsts.get(top, value), value)
    return list(places), [firsts[root(at)] for at in places.values()]


def verified(df, key, text, words, percent, common, rows: DataFrame, sizes: DataFrame, whole=True) -> DataFrame:
    """Links (a, b) found in the buckets of ``rows`` (bucket, id, digest, n, component); not ``whole``: one block each."""
    sets = shingles_of(df, key, text, words, common, stage(rows.select("id", "digest").distinct()))
    light = rows.select("bucket", "code", "id", "digest", "n", "component")
    one = {"first": F.lit(0), "second": F.lit(0), "side": F.lit(2)}
    ready = (dealt(light, sizes) if whole else light.withColumns(one)).join(sets, "digest")
    return by_group(ready, lambda group: linked(group, percent), "a long, b long")


def family_rows(near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and sizes of the minimum-hash buckets; a large bucket is cut into blocks that are buckets of their own.

    Blocks are cut differently for each minimum, so what one cut parts another joins; what
    all of them part is left to the exact buckets.
    """
    sizes = stage(
        near.groupBy("bucket")
        .agg(F.count("*").alias("bucket_rows"), F.sum("n").alias("bucket_shingles")).filter("bucket_rows > 1")
    )
    blocks = F.greatest(F.ceil(F.col("bucket_rows") / BLOCK_ROWS), F.ceil(F.col("bucket_shingles") / BLOCK_SHINGLES))
    block = F.pmod(F.xxhash64("code", "bucket"), blocks)
    cut = near.join(sizes, "bucket").withColumn(
        "bucket", F.when(blocks > 1, F.xxhash64("bucket", block)).otherwise(F.col("bucket"))
    ).drop("bucket_rows", "bucket_shingles")
    return cut, stage(bucket_sizes(cut))


def likely(part: DataFrame, families: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows and sizes of the family buckets, without the rows whose signature fits none of their bucket's.

    Most sets that share a minimum by chance go here, before any whole set is moved; buckets
    that are left with equal members are one.
    """
    one = {"first": F.lit(0), "second": F.lit(0), "side": F.lit(2)}
    signs = part.select("digest", "wide").dropDuplicates(["digest"])
    wanted = stage(families.select("digest").distinct())
    rows = families.withColumns(one).join(signs.join(wanted, "digest", "left_semi"), "digest")
    fits = by_group(rows, lambda g: meeting(g, percent, "wide", whole=True), "bucket long, code long")
    about = families.select("code", "id", "digest", "n", "component").distinct()
    left = stage(fits.distinct().join(about, "code"))
    sizes = stage(bucket_sizes(left))
    return left.join(sizes, "bucket", "left_semi"), sizes


def bucket_sizes(rows: DataFrame) -> DataFrame:
    """Buckets that hold more than one component, with their rows and shingles; one of those with equal members."""
    members = [F.bit_xor("code").alias("one"), F.bit_xor(F.xxhash64("code")).alias("two")]
    return (
        rows.groupBy("bucket")
        .agg(
            F.count("*").alias("bucket_rows"), F.sum("n").alias("bucket_shingles"),
            F.min("component").alias("low"), F.max("component").alias("high"), *members,
        )
        .filter("low < high")
        .groupBy("one", "two", "bucket_rows", "bucket_shingles").agg(F.min("bucket").alias("bucket"))
        .select("bucket", "bucket_rows", "bucket_shingles")
    )


def mixed_rows(classes: DataFrame) -> DataFrame:
    """(bucket, code, n, component, place) of the prefix buckets that hold more than one component.

    Buckets are pre-aggregated to two labels each. A bitmap of the mixed ones thins the
    prefixes inside the scan, so only rows of mixed buckets are shuffled whole.
    """
    mixed = stage(
        classes.select("component", F.explode("prefix").alias("bucket"))
        .groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .filter("low < high").select("bucket")
    )
    slot = F.col("bucket").bitwiseAND(F.lit(FILTER_BITS - 1))
    known = classes.sparkSession.sparkContext.broadcast(id_filter(mixed, slot))

    def make():
        def work(batch):
            tokens = batch["prefix"].flatten().to_numpy()
            edges = batch["prefix"].offsets.to_numpy() - batch["prefix"].offsets[0].as_py()
            owner = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            keep = in_filter(known.value, tokens & (FILTER_BITS - 1))
            own = pa.array(owner[keep])
            taken = {name: batch[name].take(own) for name in ("code", "n", "component")}
            return {"bucket": tokens[keep], "place": (np.arange(len(tokens)) - edges[owner])[keep]} | taken

        return work

    source = classes.select("code", "n", "component", "prefix")
    rows = arrow_map(source, make, "bucket long, code long, n long, component long, place int")
    return rows.join(mixed, "bucket", "left_semi")


def jaccard_components(
    df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, percent: int = 85
) -> DataFrame:
    """(key, n_shingles, component_id) for each row of ``df``.

    Null and empty texts have no shingles and link with nothing. Rows with a null key
    take no part in links and have a null component. Rows sharing a key are one
    document: each of their sets is compared, and all are in one component. Other
    columns of ``df`` play no part. An empty table gives an empty result.
    """
    common = df.sparkSession.sparkContext.broadcast(common_words(df, text))
    every = stage(describe(df, key, text, words, percent, common))
    part = every.filter("n > 0 and id is not null")
    classes = stage(
        part.groupBy("digest").agg(F.min(F.struct("id", "n", "minima")).alias("first"))
        .select("digest", "first.*", F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long").alias("code"))
    )
    copies = part.select("id", "digest").join(classes.select("digest", F.col("id").alias("b")), "digest")
    links = copies.select(F.col("id").alias("a"), "b").filter("a <> b")

    light = ["id", "digest", "code", "n", F.col("id").alias("component")]
    near = stage(
        classes.select(*light, F.posexplode("minima").alias("which", "value"))
        .select(F.xxhash64("which", "value").alias("bucket"), "id", "digest", "code", "n", "component")
    )
    near, sizes = family_rows(near)
    families, sizes = likely(part, stage(near.join(sizes, "bucket", "left_semi")), percent)
    links = stage(links.unionByName(verified(df, key, text, words, percent, common, families, sizes, whole=False)).distinct())
    found = components(links)

    known = stage(
        classes.drop("minima").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    )
    merged, merged_at = stage_at(
        part.select("digest", "id", "prefix").groupBy("digest").agg(F.min(F.struct("id", "prefix")).alias("first"))
        .select("digest", "first.prefix").join(known.select("digest", "code", "n", "component"), "digest")
        .drop("digest")
    )
    about = known.select("code", "id", "digest", "n", "component")
    spread = stage(mixed_rows(merged))
    release(merged, merged_at)
    fit = by_group(dealt(spread, stage(bucket_sizes(spread)), LIGHT_ROWS), lambda g: fitting(g, percent), "bucket long, code long")
    fit = stage(fit.distinct().join(about, "code"))
    close = fit
    for column in ("signature", "wide"):
        mixed = stage(bucket_sizes(close))
        signs = part.select("digest", column).dropDuplicates(["digest"])
        wanted = stage(close.join(mixed, "bucket", "left_semi").select("digest").distinct())
        met = dealt(close, mixed).join(signs.join(wanted, "digest", "left_semi"), "digest")
        close = by_group(met, lambda g, c=column: meeting(g, percent, c), "bucket long, code long")
        close = stage(close.distinct().join(about, "code"))
    late = stage(bucket_sizes(close))
    more = stage(verified(df, key, text, words, percent, common, close.join(late, "bucket", "left_semi"), late))
    if more.limit(1).count():
        found = components(links.unionByName(more))
    return every.join(found, "id", "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    )


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of ``df``: the one whose key names it. Rows with a null key all stay."""
    kept = jaccard_components(df, key, text, words, percent).filter(F.col(key) == F.col("component_id"))
    kept = stage(kept.select(F.col(key).alias("kept_key")).distinct())
    one = df.join(kept, F.col(key).cast("long") == kept.kept_key, "left_semi").dropDuplicates([key])
    return one.unionByName(df.filter(F.col(key).isNull()))
