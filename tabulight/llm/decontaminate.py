"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k edits is split into k + 1 pieces: wherever the item
occurs with at most k edits, some piece occurs unchanged. An Aho-Corasick automaton finds
all piece hits of a text in one pass; around each hit Myers' bit-parallel algorithm
computes the lowest edit distance of the item to any passage there.
"""

from __future__ import annotations

from functools import cached_property

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import arrow_filter, arrow_map, stage

ERROR_SHARE = 0.1
BLOCK_CHARS = 1_000_000  # of items searched at once; bounds what a Python worker holds


def normal(text: str | None) -> str:
    """Lower case, single spaces."""
    return " ".join(text.lower().split()) if text else ""


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget`` + 1 consecutive pieces that cover the item, with their places."""
    count = budget + 1
    edges = [len(item) * i // count for i in range(count + 1)]
    return [(a, item[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def masks(item: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for place, char in enumerate(item):
        found[char] = found.get(char, 0) | 1 << place
    return found


def myers(item_masks: dict[str, int], size: int, window: str) -> tuple[int, int]:
    """Lowest edit distance of the item to a substring of ``window``, and where the first such one ends."""
    ones, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, distance = ones, 0, size
    best, end = size, 0
    get = item_masks.get
    for place, char in enumerate(window, 1):
        equal = get(char, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (ones & ~(horizontal | plus))
        down = plus & horizontal
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        up = (up << 1) & ones
        plus = ((down << 1) & ones) | (ones & ~(vertical | up))
        minus = up & vertical
        if distance < best:
            best, end = distance, place
    return best, end


def ancestors(edges: list[int], low: int, high: int, path: list, found: list) -> None:
    """For each piece, the runs of pieces above it, smallest first, without the whole item.

    A run of j pieces has a budget of j - 1. If both halves of a run were over their
    budgets, the run would be over its own; so where an item fits, some piece occurs
    unchanged and every run above it is within its budget.
    """
    if high - low == 1:
        found.append(path[::-1])
        return
    middle = (low + high + 1) // 2
    for a, b in ((low, middle), (middle, high)):
        ancestors(edges, a, b, [*path, (a, b)] if b - a > 1 else path, found)


class Item:
    """A test item, its pieces, and for each piece what is verified on the way to the whole item.

    Bit masks are made when a text first hits the item or run, so most items never have any.
    """

    def __init__(self, item_id: int, item: str, share: float):
        self.id, self.text, self.budget = item_id, item, int(len(item) * share)
        self.pieces = pieces(item, self.budget)
        edges = [place for place, _ in self.pieces] + [len(item)]
        paths: list = []
        ancestors(edges, 0, len(self.pieces), [], paths)
        runs: dict = {}
        self.paths = [
            [
                runs.setdefault((a, b), (edges[a], edges[b] - edges[a], b - a - 1))
                for a, b in path
            ]
            for path in paths
        ]
        self.known: dict[tuple[int, int], dict[str, int]] = {}

    def masks_of(self, start: int, size: int) -> dict[str, int]:
        """Bit masks of a run of the item."""
        found = self.known.get((start, size))
        if found is None:
            found = self.known[start, size] = masks(self.text[start : start + size])
        return found

    def promising(self, text: str, start: int, piece: int) -> bool:
        """Whether every run above a piece fits, if the item would start near ``start``."""
        for place, size, budget in self.paths[piece]:
            begin = max(0, start + place - budget)
            if myers(self.masks_of(place, size), size, text[begin : start + place + size + budget])[0] > budget:
                return False
        return True

    def best(self, text: str, hits: set[tuple[int, int]]) -> tuple[int, int] | None:
        """Lowest distance and its first end among the places of ``hits`` (start, piece); None if over budget."""
        exact = [start for start in {s for s, _ in hits} if start >= 0 and text.startswith(self.text, start)]
        if exact:
            return 0, min(exact) + len(self.text)
        best, where = self.budget + 1, 0
        held = sorted({start for start, piece in hits if self.promising(text, start, piece)})
        while held:
            near = [s for s in held if s <= held[0] + len(self.text)]
            held = held[len(near) :]
            begin = max(0, near[0] - self.budget)
            window = text[begin : near[-1] + len(self.text) + self.budget]
            distance, end = myers(self.masks_of(0, len(self.text)), len(self.text), window)
            if distance < best:
                best, where = distance, begin + end
        return (best, where) if best <= self.budget else None


class Block:
    """Items as (id, normal form); their matcher is made once a Python worker and kept with the broadcast."""

    def __init__(self, rows: list[tuple[int, str]], share: float):
        self.rows, self.share = rows, share

    @cached_property
    def matcher(self) -> "Matcher":
        return Matcher(self.rows, self.share)


class Matcher:
    """Finds a block of items in texts."""

    def __init__(self, items: list[tuple[int, str]], share: float):
        self.items = [Item(item_id, item, share) for item_id, item in items]
        table: dict[str, list[tuple[int, int, int]]] = {}
        for number, item in enumerate(self.items):
            for piece, (place, part) in enumerate(item.pieces):
                table.setdefault(part, []).append((number, piece, place))
        self.automaton = ahocorasick.Automaton()
        for part, places in table.items():
            self.automaton.add_word(part, (len(part), places))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item id, distance, end in the normal form) of each item within its budget, at its best place."""
        hits: dict[int, set[tuple[int, int]]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for number, piece, place in places:
                hits.setdefault(number, set()).add((end + 1 - size - place, piece))
        found = []
        for number, starts in hits.items():
            best = self.items[number].best(text, starts)
            if best:
                found.append((self.items[number].id, *best))
        return found


def contaminated(
    df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", share: float = ERROR_SHARE,
) -> DataFrame:
    """(key, item_id, distance, end_at): each item found in each row within ``share`` of its length in edits.

    Texts and items are compared in lower case with single spaces; ``end_at`` counts
    characters of that form. Null and empty texts or items match nothing. Rows with a
    null or repeated key are rows like others; items with a null key take no part, and
    equal item ids with different texts are searched each. The item table is taken in
    blocks of at most about BLOCK_CHARS characters, each broadcast for one pass.
    """
    texts = df.filter(F.length(text) > 0).select(F.col(key).cast("long").alias("id"), F.col(text).alias("body"))
    schema = "id long, item_id long, distance int, end_at long"
    made = df.sparkSession.createDataFrame([], schema)
    for shared in item_blocks(items, item_key, item_text, share):

        def make(shared=shared):
            matcher = shared.value.matcher

            def work(batch):
                out = {"id": [], "item_id": [], "distance": [], "end_at": []}
                for row_id, body in zip(batch["id"], batch["body"], strict=True):
                    for item_id, distance, end in matcher.find(normal(body.as_py())):
                        for name, value in zip(out, (row_id.as_py(), item_id, distance, end), strict=True):
                            out[name].append(value)
                return out

            return work

        made = made.unionByName(arrow_map(texts, make, schema))
    return made.withColumnRenamed("id", key)


def item_blocks(items: DataFrame, item_key: str, item_text: str, share: float):
    """The items as broadcast blocks, one at a time."""
    listed = stage(
        items.filter(F.col(item_key).isNotNull() & F.col(item_text).isNotNull())
        .select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).alias("item")).distinct()
    )
    total = listed.agg(F.sum(F.length("item")).alias("chars")).first()["chars"] or 0
    blocks = int(total // BLOCK_CHARS) + 1
    for block in range(blocks):
        part = listed.filter(F.pmod(F.xxhash64("item_id", "item"), F.lit(blocks)) == block)
        rows = sorted({(r["item_id"], normal(r["item"])) for r in part.collect()})
        if rows := [r for r in rows if r[1]]:
            yield items.sparkSession.sparkContext.broadcast(Block(rows, share))


def drop_contaminated(
    df: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
    share: float = ERROR_SHARE,
) -> DataFrame:
    """The rows of ``df``, null keys included, in which no item is found; one pass a block of items."""
    for shared in item_blocks(items, item_key, item_text, share):

        def make(shared=shared):
            matcher = shared.value.matcher
            return lambda bodies: [not matcher.find(normal((b or b"").decode("utf-8", "replace"))) for b in bodies]

        df = arrow_filter(df, text, make)
    return df
