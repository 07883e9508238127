"""Hard negatives of labelled vectors: near the anchor, but of another label.

A row's score is its integer inner product with the anchor. An anchor's positives are
its best rows of the same label; each positive asks for the best rows of other labels
whose score lies in a window from a share of its own score up to it. Windows of one
anchor overlap, so they are not searched one by one: the positives' scores, as upper
limits, cut all scores into disjoint slots, a task keeps the best few of each slot, and
the merge of a slot with all lower slots, from the lowest up, answers the window that
ends there. Its lower limit only cuts the end of that answer.

Anchors and rows meet in cells, a block of anchors and a part of all rows each. A cell
is a key of one shuffle; its anchors come first and are held, its rows stream by, and
only the best few leave it. So the plan has the same size for any number of anchors, and
nothing passes through the driver but counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .frames import stage, to_batch

BLOCK_ANCHORS = 65_536
CELL_ROWS = 131_072
ROWS_AT_ONCE, ANCHORS_AT_ONCE = 1024, 1024
EXACT = 2.0**53


def usable(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, vec) of rows that have an id, a label and a vector of finite components."""
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    fit = F.col(key).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~bad
    return df.filter(fit).select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), x.alias("vec"))


class Best:
    """The ``k`` highest scores of each of some lists, ties to smaller ids; ``least`` is what a new score must reach."""

    def __init__(self, lists: int, k: int):
        self.k = k
        self.count = np.zeros(lists, np.int64)
        self.scores = np.zeros((lists, k), np.int64)
        self.ids = np.zeros((lists, k), np.int64)
        self.least = np.full(lists, np.iinfo(np.int64).min)

    def add(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = scores >= self.least[lists]
        lists, scores, ids = lists[keep], scores[keep], ids[keep]
        if not len(lists):
            return
        seen = np.unique(lists)
        old = np.arange(self.k) < self.count[seen][:, None]
        lists = np.concatenate((lists, np.broadcast_to(seen[:, None], old.shape)[old]))
        scores = np.concatenate((scores, self.scores[seen][old]))
        ids = np.concatenate((ids, self.ids[seen][old]))
        order = np.lexsort((ids, ~scores, lists))
        lists = lists[order]
        first = np.flatnonzero(np.concatenate(([True], lists[1:] != lists[:-1])))
        place = np.arange(len(lists)) - np.repeat(first, np.diff(np.append(first, len(lists))))
        top = place < self.k
        lists, place, order = lists[top], place[top], order[top]
        self.scores[lists, place], self.ids[lists, place] = scores[order], ids[order]
        self.count[seen] = np.bincount(np.searchsorted(seen, lists), minlength=len(seen))
        full = seen[self.count[seen] == self.k]
        self.least[full] = self.scores[full, self.k - 1]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, score, id) of all that is held."""
        held = np.arange(self.k) < self.count[:, None]
        return np.broadcast_to(np.arange(len(held))[:, None], held.shape)[held], self.scores[held], self.ids[held]


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products, through doubles where those are exact."""
    if np.abs(anchors).max(initial=0) * np.abs(rows).max(initial=0) * rows.shape[1] < EXACT:
        return (anchors @ rows.T).astype(np.int64)
    return anchors.astype(np.int64) @ rows.T.astype(np.int64)


class Cell:
    """A block of anchors and what its lists keep of the rows that stream by."""

    def __init__(self, anchors: dict, scale: int, k: int, least: int, percent: int):
        order = np.argsort(anchors["label"], kind="stable")
        self.ids, self.labels = anchors["id"][order], anchors["label"][order]
        self.vectors = np.floor(scale * np.stack(anchors["vec"][order]).astype(np.float64))
        self.scale, self.percent = scale, percent
        # without limits a list keeps an anchor's positives; with them, an anchor has a list a slot
        self.uppers = None
        if "uppers" in anchors:
            self.uppers = np.full((len(order), least), np.iinfo(np.int64).min)
            for row, own in enumerate(anchors["uppers"][order]):
                self.uppers[row, : len(own)] = own
            self.counts = np.array([len(own) for own in anchors["uppers"][order]])
            lowest = self.uppers[np.arange(len(order)), self.counts - 1]
            self.floors = -(-percent * lowest // 100)
        self.slots = 1 if self.uppers is None else least
        self.best = Best(len(order) * self.slots, k)

    def add(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        for start in range(0, len(ids), ROWS_AT_ONCE):
            at = slice(start, start + ROWS_AT_ONCE)
            rows = np.floor(self.scale * vectors[at].astype(np.float64))
            if self.uppers is None:
                own = np.argsort(labels[at], kind="stable")
                self.positives(ids[at][own], labels[at][own], rows[own])
            else:
                self.negatives(ids[at], labels[at], rows)

    def positives(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> None:
        for label in np.unique(labels):
            a, b = np.searchsorted(labels, [label, label + 1])
            low, high = np.searchsorted(self.labels, [label, label + 1])
            for start in range(low, high, ANCHORS_AT_ONCE):
                some = np.arange(start, min(high, start + ANCHORS_AT_ONCE))
                scores = products(self.vectors[some], rows[a:b])
                fit = (scores >= self.best.least[some][:, None]) & (self.ids[some][:, None] != ids[None, a:b])
                anchor, row = np.nonzero(fit)
                self.best.add(some[anchor], scores[anchor, row], ids[a:b][row])

    def negatives(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> None:
        for start in range(0, len(self.ids), ANCHORS_AT_ONCE):
            some = slice(start, start + ANCHORS_AT_ONCE)
            scores = products(self.vectors[some], rows)
            fit = (scores <= self.uppers[some, :1]) & (scores >= self.floors[some][:, None])
            fit &= (self.labels[some][:, None] != labels[None, :]) & (self.ids[some][:, None] != ids[None, :])
            anchor, row = np.nonzero(fit)
            found, anchor = scores[anchor, row], anchor + start
            # the slot of the lowest upper limit that is not below the score
            slot = np.minimum((self.uppers[anchor] >= found[:, None]).sum(axis=1), self.counts[anchor]) - 1
            self.best.add(anchor * self.slots + slot, found, ids[row])

    def result(self) -> dict:
        lists, scores, ids = self.best.rows()
        anchor, slot = lists // self.slots, lists % self.slots
        return {"anchor_id": self.ids[anchor], "slot": slot.astype(np.int32), "score": scores, "id": ids}


def cells(anchors: DataFrame, rows: DataFrame, scale: int, k: int, least: int, percent: int) -> DataFrame:
    """(anchor_id, slot, score, id): the ``k`` best of each list of each cell.

    ``anchors`` has id, label, vec and, for negatives, ``uppers``. Vectors meet those of
    the same length.
    """
    spark = rows.sparkSession
    asked, count = anchors.count(), rows.count()
    blocks = max(1, math.ceil(asked / BLOCK_ANCHORS))
    # enough parts to keep the cores busy, each of a bounded number of rows
    parts = max(1, math.ceil(count / CELL_ROWS), min(2 * spark.sparkContext.defaultParallelism // blocks, count // 2048))
    uppers = F.col("uppers") if "uppers" in anchors.columns else F.lit(None).cast("array<long>")
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    part = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).cast("int")
    kind = F.size("vec").alias("dims")
    held = anchors.select(
        kind, block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("side"),
        "id", "label", "vec", uppers.alias("uppers"),
    )
    passing = rows.select(
        kind, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), part.alias("part"), F.lit(1).alias("side"),
        "id", "label", "vec", F.lit(None).cast("array<long>").alias("uppers"),
    )
    cell = ["dims", "block", "part"]
    dealt = held.unionByName(passing).repartition(max(1, blocks * parts), *cell).sortWithinPartitions(*cell, "side")
    parsed = StructType.fromDDL("anchor_id long, slot int, score long, id long")
    target = to_arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, waiting, open_cell = None, [], None

        def begin() -> Cell | None:
            if not waiting:
                return None
            table = {n: np.concatenate([w[n] for w in waiting]) for n in ("id", "label")}
            for n in ("vec", "uppers"):
                if waiting[0].get(n) is not None:
                    table[n] = np.empty(len(table["id"]), object)
                    table[n][:] = [v for w in waiting for v in w[n]]
            return Cell(table, scale, k, least, percent)

        def close():
            made = open_cell or begin()
            if made is not None:
                yield to_batch(made.result(), target)

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            side = batch.column(3).to_numpy()
            change = (keys[1:] != keys[:-1]).any(axis=1) | (side[1:] != side[:-1])
            edges = np.concatenate(([0], np.flatnonzero(change) + 1, [len(side)])) if len(side) else [0]
            for start, end in zip(edges[:-1], edges[1:]):
                own = tuple(keys[start].tolist())
                if own != name:
                    if name is not None:
                        yield from close()
                    name, waiting, open_cell = own, [], None
                ids, labels = (batch.column(i).slice(start, end - start).to_numpy() for i in (4, 5))
                vectors = batch.column(6).slice(start, end - start).flatten().to_numpy(zero_copy_only=False).reshape(end - start, own[0])
                if side[start] == 0:
                    limits = batch.column(7).slice(start, end - start).to_pylist()
                    waiting.append({"id": ids, "label": labels, "vec": list(vectors), "uppers": limits if limits[0] is not None else None})
                    continue
                if open_cell is None:
                    open_cell = begin()
                if open_cell is not None:
                    open_cell.add(ids, labels, vectors)
        if name is not None:
            yield from close()

    return dealt.mapInArrow(run, parsed)


def top(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The ``k`` highest scores by key, ties to smaller ids."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).filter(F.col("place") <= k)


def mine(
    df: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, percent: int = 80, scale: int = 256,
    key: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows for which ``is_anchor`` holds. A component x counts as
    floor(scale · x), x as double. The ``positives`` of an anchor are the first other rows
    of its label, by score, ties to the smaller id; for each, the first ``negatives`` rows
    of other labels with percent · positive score <= 100 · score <= 100 · positive score
    are returned, ranked from 1. A negative positive score has an empty window.
    Rows with a null id or label, and vectors that are null, empty or hold null or
    non-finite components take no part; vectors of different lengths never meet. A row
    with the anchor's own id is never its positive or negative. Repeated rows are
    candidates each, the copies of an anchor are one anchor, that of the smallest label
    and vector; among positives with one id the copies give their rows each. Other columns
    are ignored; an empty table gives an empty result.
    """
    marked = df.withColumn("__anchor", is_anchor)
    rows = stage(usable(marked.drop("__anchor"), key, vector, label))
    first = F.min(F.struct("label", "vec"))
    chosen = usable(marked.filter("__anchor"), key, vector, label).groupBy("id").agg(first.alias("a"))
    anchors = stage(chosen.select("id", "a.label", "a.vec"))
    best = stage(top(cells(anchors, rows, scale, positives, positives, percent), ["anchor_id"], positives))
    limits = best.filter(F.col("score") >= 0).groupBy("anchor_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda p: p["score"]).alias("uppers")
    )
    limited = stage(anchors.join(limits, anchors["id"] == limits["anchor_id"]).drop("anchor_id"))
    slots = top(cells(limited, rows, scale, negatives, positives, percent), ["anchor_id", "slot"], negatives)
    held = slots.groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("slot"), F.col("score"), F.col("id"))).alias("slots"))
    asked = best.filter(F.col("score") >= 0).groupBy("anchor_id").agg(
        F.array_sort(F.collect_list(F.struct("place", F.col("score").alias("positive_score"), F.col("id").alias("positive_id")))).alias("asked")
    )
    # From the lowest slot up, the best of a slot and of all below it; at most ``negatives`` rows are carried.
    better = lambda a, b: F.when(
        (a["score"] > b["score"]) | ((a["score"] == b["score"]) & (a["id"] < b["id"])), -1
    ).when((a["score"] == b["score"]) & (a["id"] == b["id"]), 0).otherwise(1)
    rows_kind = "array<struct<score:bigint,id:bigint>>"
    state_kind = f"struct<below:{rows_kind},answers:array<{rows_kind}>>"
    none = F.from_json(F.lit('{"below":[],"answers":[]}'), state_kind)

    def merged(state, slot):
        own = F.transform(F.filter("slots", lambda s: s["slot"] == slot), lambda s: F.struct(s["score"].alias("score"), s["id"].alias("id")))
        below = F.slice(F.array_sort(F.concat(state["below"], own), better), 1, negatives)
        return F.struct(below.alias("below"), F.concat(F.array(below), state["answers"]).alias("answers")).cast(state_kind)

    downward = F.sequence(F.size("asked") - 1, F.lit(0), F.lit(-1))
    answers = F.aggregate(downward, none, merged)["answers"]
    made = held.join(asked, "anchor_id").select("anchor_id", F.explode(F.arrays_zip("asked", answers.alias("top"))).alias("a")).select(
        "anchor_id", "a.asked.positive_id", "a.asked.positive_score", F.posexplode("a.top").alias("at", "n")
    )
    return made.filter(F.col("n.score") * 100 >= F.col("positive_score") * percent).select(
        "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.id").alias("negative_id"),
        "positive_score", F.col("n.score").alias("negative_score"),
    )
