"""SentencePiece encoding and decoding.

The pieces of a model file become one Aho-Corasick automaton over UTF-8 bytes. A single
pass over a segment keeps the best score at every position: at each byte the automaton
moves on, and the output links of its state name every piece that ends there, each of
which may improve the position's score. Segments of a batch are walked side by side, a
byte of each at a time, so numpy does the work. Where few segments are left, as in texts
without blanks, each is walked by itself in constant time a byte, so a text of any kind
takes time in proportion to its length.

Spaces stand for the model's space mark inside the automaton, so a mark that a text has
itself is spelled in byte pieces and decoding gives back the very text.
"""

from __future__ import annotations

import re
from array import array
from collections import deque
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .frames import arrow_map, slices

SPACE_MARK = "▁"
UNKNOWN_PENALTY = 10.0
PART_BYTES = 4 << 20  # text walked at once
DECODED_BYTES = 2 << 20  # of a batch at once
WIDTH = 64  # with fewer segments left, numpy's fixed cost a step exceeds that of a plain loop
SPLIT = re.compile(rb" *[^ \n]+| +|\n")
NEVER = np.float64(-1e300)


@dataclass
class Model:
    """A vocabulary as arrays: sorted trie edges, suffix and output links by state, pieces by id."""

    edge_keys: np.ndarray  # state << 8 | byte
    edge_next: np.ndarray
    suffix: np.ndarray
    output: np.ndarray  # nearest state on the suffix chain, itself included, that ends a piece
    after: np.ndarray  # the same from the suffix on
    piece: np.ndarray  # piece id by state, -1 if none
    length: np.ndarray  # bytes by state
    single: np.ndarray  # the state's piece is one character
    score: np.ndarray  # by state
    texts: list[bytes]  # what each id decodes to
    byte_ids: np.ndarray  # id of each byte piece
    unknown_score: float
    splits: bool  # no piece goes on after a space that follows another character, or over a line end

    @cached_property
    def plain(self) -> tuple:
        """Edges, suffix links and the pieces that end in each state, longest first, for walks of one segment.

        A piece is (bytes, score, state). Made once a Python worker, of the vocabulary's size.
        """
        edges = dict(zip(self.edge_keys.tolist(), self.edge_next.tolist(), strict=True))
        output, after = self.output.tolist(), self.after.tolist()
        length, score = self.length.tolist(), self.score.tolist()
        chains: dict[int, tuple] = {0: ()}
        for state in sorted({s for s in output if s}, key=length.__getitem__):
            chains[state] = ((length[state], score[state], state), *chains[after[state]])
        return edges, self.suffix.tolist(), [chains[s] for s in output]


def load_model(path: str) -> Model:
    """A SentencePiece model file with byte pieces; its scores are the costs of the Viterbi pass."""
    import sentencepiece

    reader = sentencepiece.SentencePieceProcessor(model_file=path)
    size = reader.get_piece_size()
    entries, texts, bytes_of = [], [], np.full(256, -1, np.int32)
    for piece in range(size):
        name = reader.id_to_piece(piece)
        if reader.is_byte(piece):
            value = int(name[3:5], 16)
            bytes_of[value] = piece
            texts.append(bytes([value]))
        elif reader.is_control(piece) or reader.is_unknown(piece) or reader.is_unused(piece):
            texts.append(b"")
        else:
            text = name.replace(SPACE_MARK, " ").encode()
            texts.append(text)
            entries.append((text, piece, reader.get_score(piece)))
    if (bytes_of < 0).any():
        raise ValueError("the model has no byte pieces, so texts could not be given back")
    return build_model(entries, texts, bytes_of)


def build_model(entries: list[tuple[bytes, int, float]], texts: list[bytes], bytes_of: np.ndarray) -> Model:
    """The automaton over (bytes, id, score) entries; of equal entries the first counts."""
    children: list[dict[int, int]] = [{}]
    piece, depth, score = [-1], [0], [0.0]
    for text, number, value in entries:
        state = 0
        for byte in text:
            state = children[state].setdefault(byte, len(children))
            if state == len(children):
                children.append({})
                piece.append(-1)
                depth.append(0)
                score.append(0.0)
        if state and piece[state] < 0:
            piece[state], depth[state], score[state] = number, len(text), value
    suffix, output, after = [0] * len(children), [0] * len(children), [0] * len(children)
    waiting = deque([0])
    while waiting:
        state = waiting.popleft()
        after[state] = output[suffix[state]] if state else 0
        output[state] = state if piece[state] >= 0 else after[state]
        for byte, child in children[state].items():
            back = suffix[state]
            while state and back and byte not in children[back]:
                back = suffix[back]
            suffix[child] = children[back].get(byte, 0) if state else 0
            waiting.append(child)
    keys = np.array([s << 8 | b for s, nexts in enumerate(children) for b in nexts], np.int64)
    nexts = np.array([c for nexts in children for c in nexts.values()], np.int32)
    order = np.argsort(keys)
    names = {number: text for text, number, _ in entries}
    single = [p >= 0 and len(names[p].decode()) == 1 for p in piece]
    lowest = min((value for _, _, value in entries), default=0.0)
    splits = all(b" " not in text.lstrip(b" ") and b"\n" not in text for text, _, _ in entries)
    return Model(
        keys[order], nexts[order], np.array(suffix, np.int32), np.array(output, np.int32), np.array(after, np.int32),
        np.array(piece, np.int32), np.array(depth, np.int32), np.array(single), np.array(score), texts, bytes_of,
        lowest - UNKNOWN_PENALTY, splits,
    )


def moved(model: Model, states: np.ndarray, bytes_now: np.ndarray) -> np.ndarray:
    """The automaton's next states: along the trie, else along suffix links until a byte fits."""
    out = np.zeros(len(states), np.int32)
    left = np.arange(len(states))
    at = states.astype(np.int64)
    while len(left):
        keys = at << 8 | bytes_now[left]
        place = np.minimum(np.searchsorted(model.edge_keys, keys), len(model.edge_keys) - 1)
        hit = model.edge_keys[place] == keys
        out[left[hit]] = model.edge_next[place[hit]]
        on = ~hit & (at > 0)
        left, at = left[on], model.suffix[at[on]].astype(np.int64)
    return out


def lone_ids(model: Model, segment: bytes) -> np.ndarray:
    """``segment_ids`` of one segment: the same path, a byte at a time in a plain loop."""
    edges, suffix, pieces = model.plain
    best = array("d", [NEVER]) * (len(segment) + 1)
    back = array("i", [0]) * (len(segment) + 1)
    best[0] = 0.0
    state = char_at = 0
    size = len(segment)
    for place, byte in enumerate(segment):
        if byte & 0xC0 != 0x80:
            char_at = place
        to = edges.get(state << 8 | byte)
        while to is None and state:
            state = suffix[state]
            to = edges.get(state << 8 | byte)
        state = to or 0
        end = place + 1
        top, link = NEVER, 0
        for length, score, piece in pieces[state]:
            value = best[end - length] + score
            if value > top:
                top, link = value, piece
        if end == size or segment[end] & 0xC0 != 0x80:
            if not any(length == end - char_at for length, _, _ in pieces[state]):
                value = best[char_at] + model.unknown_score
                if value > top:
                    top, link = value, 0
        best[end], back[end] = top, link
    ids = array("i")
    piece, length, byte_ids = model.piece, model.length, model.byte_ids
    place = size
    while place:
        link = back[place]
        if link:
            ids.append(int(piece[link]))
            place -= int(length[link])
            continue
        while True:  # an unknown character, back to its first byte
            place -= 1
            ids.append(int(byte_ids[segment[place]]))
            if not place or segment[place] & 0xC0 != 0x80:
                break
    return np.array(ids, np.int32)[::-1]


def segment_ids(model: Model, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all segments in a row, and where each one's start (one more entry than segments).

    Segments longer than the WIDTH-th longest go one by one, so that numpy always has many to step through.
    """
    sizes = np.array([len(s) for s in segments], np.int64)
    wide = np.partition(sizes, -WIDTH)[-WIDTH] if len(sizes) >= WIDTH else 0
    lone = {int(i): lone_ids(model, segments[i]) for i in np.flatnonzero(sizes > wide)}
    ids, starts = wide_ids(model, [b"" if i in lone else s for i, s in enumerate(segments)])
    if not lone:
        return ids, starts
    counts = np.diff(starts)
    own = np.repeat(np.arange(len(segments)), counts)
    own = np.concatenate([own, *[np.full(len(found), i) for i, found in lone.items()]])
    ids = np.concatenate([ids, *lone.values()])
    for i, found in lone.items():
        counts[i] = len(found)
    return ids[np.argsort(own, kind="stable")], np.concatenate(([0], np.cumsum(counts)))


def wide_ids(model: Model, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all segments in a row, and where each segment's ids start (one more entry than segments).

    The best path has the highest sum of scores; of equal ones that with the longest last
    piece. A character that is no piece of its own may be taken as unknown, at the lowest
    score less UNKNOWN_PENALTY, and becomes its bytes.
    """
    sizes = np.array([len(s) for s in segments], np.int64)
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    data = np.frombuffer(b"".join([segments[i] for i in order]) or b"\0", np.uint8)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    slots = starts + np.arange(len(sizes))  # one position more than bytes for each segment
    best = np.full(int(sizes.sum()) + len(sizes), NEVER)
    back = np.zeros(len(best), np.int32)  # state of the piece that ends there; 0: unknown character
    best[slots] = 0
    states = np.zeros(len(sizes), np.int32)
    char_at = np.zeros(len(sizes), np.int64)  # place in the segment where the current character starts
    active = len(sizes)
    falling = -sizes
    for place in range(int(sizes[0]) if len(sizes) else 0):
        active = int(np.searchsorted(falling, -place, side="left"))  # segments longer than place
        at = starts[:active] + place
        now = data[at]
        char_at[:active][(now & 0xC0) != 0x80] = place
        states[:active] = moved(model, states[:active], now)
        ends = slots[:active] + place + 1
        link = model.output[states[:active]]
        row = np.flatnonzero(link)
        whole = np.zeros(active, bool)
        link = link[row]
        while len(row):
            size = model.length[link]
            value = best[ends[row] - size] + model.score[link]
            better = value > best[ends[row]]
            to = ends[row[better]]
            best[to], back[to] = value[better], link[better]
            whole[row[model.single[link]]] = True
            link = model.after[link]
            row, link = row[link > 0], link[link > 0]
        last = np.ones(active, bool)
        more = np.flatnonzero(sizes[:active] > place + 1)
        last[more] = (data[at[more] + 1] & 0xC0) != 0x80
        row = np.flatnonzero(last & ~whole)
        value = best[slots[row] + char_at[row]] + model.unknown_score
        better = value > best[ends[row]]
        best[ends[row[better]]], back[ends[row[better]]] = value[better], 0
    return traced(model, data, starts, slots, sizes, back, order)


def traced(model, data, starts, slots, sizes, back, order) -> tuple[np.ndarray, np.ndarray]:
    """Follow the best path of every segment from its end; an unknown character gives one id for each byte."""
    rows, ids = [], []
    row, place = np.arange(len(sizes)), sizes.copy()
    row, place = row[place > 0], place[place > 0]
    in_char = np.zeros(len(row), bool)
    while len(row):
        state = np.where(in_char, 0, back[slots[row] + place])
        byte = data[starts[row] + place - 1]
        known = state > 0
        ids.append(np.where(known, model.piece[state], model.byte_ids[byte]))
        rows.append(row)
        place = place - np.where(known, model.length[state], 1)
        in_char = ~known & ((byte & 0xC0) == 0x80)
        on = place > 0
        row, place, in_char = row[on], place[on], in_char[on]
    if not rows:
        return np.zeros(0, np.int32), np.zeros(len(sizes) + 1, np.int64)
    rows, ids = np.concatenate(rows)[::-1], np.concatenate(ids)[::-1]
    own = order[rows]
    turn = np.argsort(own, kind="stable")
    counts = np.bincount(own, minlength=len(sizes))
    return ids[turn].astype(np.int32), np.concatenate(([0], np.cumsum(counts)))


def encode_batch(model: Model, bodies: list[bytes | None]) -> list[np.ndarray]:
    """The ids of each text; equal segments of the batch are walked once."""
    out: list[np.ndarray] = []
    part: list[bytes] = []
    size = 0
    for body in [*bodies, None]:
        if size > PART_BYTES or len(out) + len(part) == len(bodies):
            out += encode_part(model, part)
            part, size = [], 0
        part.append(body or b"")
        size += len(part[-1])
    return out


def encode_part(model: Model, bodies: list[bytes]) -> list[np.ndarray]:
    places: dict[bytes, int] = {}
    runs = []
    for body in bodies:
        marked = b" " + body if body else b""
        cut = SPLIT.findall(marked) if model.splits else [marked] * bool(marked)
        runs.append(np.fromiter((places.setdefault(s, len(places)) for s in cut), np.int64, len(cut)))
    ids, starts = segment_ids(model, list(places))
    counts = np.diff(starts)
    out = []
    for run in runs:
        taken = counts[run]
        total = int(taken.sum())
        shift = np.repeat(starts[run] - np.concatenate(([0], np.cumsum(taken)[:-1])), taken) if total else 0
        out.append(ids[shift + np.arange(total)])
    return out


def decode_ids(model: Model, ids) -> bytes:
    """The text's bytes: all pieces in a row without the space set before the first word."""
    data = b"".join([model.texts[i] for i in ids])
    return data[1:] if data[:1] == b" " else data


def ragged(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
    values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    field = pa.field("element", pa.int32(), True)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()), pa.list_(field))


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """(key, n_bytes, n_tokens, token_ids), and the text if it is to be kept, for each row of ``df``.

    Null and empty texts have no tokens; null or repeated keys and other columns change
    nothing. ``path`` names the model file on the driver; the vocabulary, whose size does
    not depend on the data, is broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(load_model(path))

    def make():
        def work(batch):
            bodies = batch["body"].to_pylist()
            ids = encode_batch(shared.value, bodies)
            out = {
                "id": batch["id"], "n_bytes": [len(b or b"") for b in bodies], "n_tokens": [len(i) for i in ids],
                "token_ids": ragged(ids),
            }
            return out | ({"text": batch["text"]} if keep_text else {})

        return work

    body = F.col(text).cast("binary").alias("body")
    source = df.select(F.col(key).cast("long").alias("id"), body, *[F.col(text).alias("text")] * keep_text)
    made = arrow_map(
        source, make, "id long, n_bytes long, n_tokens long, token_ids array<int>" + ", text string" * keep_text,
        PART_BYTES,
    )
    return made.withColumnRenamed("id", key)


def decode(df: DataFrame, path: str, ids: str = "token_ids") -> DataFrame:
    """``df`` with a column ``decoded``: the text of each row's ids; of null ids and an empty list, an empty text.

    A column named ``decoded`` before is replaced; all others stay.
    """
    shared = df.sparkSession.sparkContext.broadcast(load_model(path))
    rest = [c for c in df.columns if c != "decoded"]
    schema = StructType([*df.select(*rest).schema.fields, StructField("decoded", StringType())])

    def run(batches):
        model = shared.value
        texts = np.frombuffer(b"".join(model.texts), np.uint8)
        size = np.array([len(t) for t in model.texts], np.int64)
        start = np.cumsum(size) - size
        for batch in slices(batches, DECODED_BYTES):
            column = batch.column(batch.schema.get_field_index(ids))
            column = column.fill_null([]) if column.null_count else column
            flat = column.flatten().to_numpy()
            taken = size[flat]
            ends = np.concatenate(([0], np.cumsum(taken)))
            data = texts[np.repeat(start[flat] - ends[:-1], taken) + np.arange(ends[-1])].tobytes()
            edges = ends[column.offsets.to_numpy() - column.offsets[0].as_py()].tolist()
            found = [data[a + (data[a : a + 1] == b" " and b > a) : b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
            made = pa.array([f.decode("utf-8", "replace") for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*rest, "decoded"])

    return df.select(*rest).mapInArrow(run, schema)
