"""Transcripts to chat turns: a hidden Markov model over lines, decoded by Viterbi.

States are a role and whether a line opens a turn or goes on with it. A line shows a
speaker marker or none, a length class, whether it ends in a question mark and whether a
blank line stands before it. Probabilities are counts over labelled transcripts. The
best state sequence cuts a transcript into turns, rendered in one canonical form. Only the
line that opens a turn loses its marker; all other lines are rendered as they are.

A conversation of any length is decoded as a whole, in slices of a bounded number of rows.
A slice's (max, +) matrix tells the best score from any state before it to any state at
its end. Products of these, within a partition and then over a conversation's partitions,
give the scores that enter each slice, and the best ends are traced back the same way;
then each slice is decoded on its own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .frames import arrow_map, stage, to_batch
from .sampling import fold

ROLES = ("system", "user", "assistant")
STATES = len(ROLES) * 2  # role * 2 + (0: opens, 1: goes on)
MARKS = ("none", *ROLES)
LENGTHS = (1, 40, 160)
SHAPES = len(LENGTHS) + 1
SYMBOLS = len(MARKS) * SHAPES * 4
SLICE_ROWS = 256
# Words that name a speaker.
NAMES = {
    "system": "system", "sys": "system", "instruction": "system", "instructions": "system",
    "user": "user", "human": "user", "question": "user", "q": "user", "me": "user", "customer": "user",
    "assistant": "assistant", "ai": "assistant", "bot": "assistant", "gpt": "assistant", "answer": "assistant",
    "a": "assistant", "agent": "assistant",
}
WORD = "|".join(sorted(NAMES, key=len, reverse=True))
MARKER = re.compile(
    rf"^\s*(?:<\|(?:im_start\|>)?\s*({WORD})\s*(?:\|>)?|\[({WORD})\]:?|#+\s*({WORD})\s*:?|\**({WORD})\**\s*:\**)(?=\s|$)",
    re.IGNORECASE,
)
OPEN, CLOSE = "<|{role}|>\n", "<|end|>\n"


def marker(line: str) -> tuple[int, str | None]:
    """The place in MARKS of a line's speaker marker, and what follows it past one blank; None if nothing does."""
    found = MARKER.match(line)
    if not found:
        return 0, line
    name = next(g for g in found.groups() if g).lower()
    return MARKS.index(NAMES[name]), line[found.end() + 1 :] if found.end() < len(line) else None


def observed(lines: list[str]) -> np.ndarray:
    """A symbol for each line."""
    out, blank = [], True
    for line in lines:
        mark, rest = marker(line)
        rest = (rest or "").strip()
        shape = int(np.searchsorted(LENGTHS, len(rest), side="right"))
        out.append(((mark * SHAPES + shape) * 2 + rest.endswith("?")) * 2 + blank)
        blank = not line.strip()
    return np.array(out, np.int64)


@dataclass
class Model:
    """Log probabilities of first states, of moves and of symbols by state."""

    first: np.ndarray
    move: np.ndarray
    show: np.ndarray

    def decode(self, symbols: np.ndarray, before: np.ndarray | None = None, last: int | None = None) -> np.ndarray:
        """The most likely states; ties go to the lower state.

        ``before`` has the scores of the states before the first symbol, if it is not the
        first of all, and ``last`` the state it ends in, if that is known.
        """
        size = len(symbols)
        back = np.zeros((size, STATES), np.int8)
        score = self.first if before is None else (before[:, None] + self.move).max(axis=0)
        score = score + self.show[:, symbols[0]]
        for place in range(1, size):
            paths = score[:, None] + self.move
            back[place] = paths.argmax(axis=0)
            score = paths.max(axis=0) + self.show[:, symbols[place]]
        states = np.zeros(size, np.int64)
        states[-1] = score.argmax() if last is None else last
        for place in range(size - 1, 0, -1):
            states[place - 1] = back[place, states[place]]
        return states

    def passage(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best scores from each state before the symbols to each at their end, and from the start of a transcript."""
        through = self.move + self.show[:, symbols[0]]
        start = self.first + self.show[:, symbols[0]]
        both = np.vstack((through, start))
        for symbol in symbols[1:]:
            both = (both[:, :, None] + self.move[None]).max(axis=1) + self.show[:, symbol]
        return both[:-1], both[-1]


def logs(counts: np.ndarray) -> np.ndarray:
    counts = counts + 0.1
    return np.log(counts / counts.sum(axis=-1, keepdims=True))


def parse(model: Model, text: str | None) -> tuple[list[int], list[tuple[str, list[str]]]]:
    """The role of every line and the turns of a transcript, as lines; blank texts have none.

    A turn's lines are without the speaker marker of the first and without one blank line
    at the end, which parts turns. A turn without any line is kept, as an empty one.
    """
    lines = text.split("\n") if text else []
    if not any(line.strip() for line in lines):
        return [], []
    states = model.decode(observed(lines))
    return (states // 2).tolist(), cut(lines, states.tolist(), None)[1]


def cut(lines: list[str], states: list[int], before: str | None) -> tuple[list[str], list[tuple[str, list[str]]]]:
    """Lines that go on with the turn before, of role ``before``, and the turns that open here."""
    rest: list[str] = []
    turns: list[tuple[str, list[str]]] = []
    for line, state in zip(lines, states, strict=True):
        role = ROLES[state // 2]
        if state % 2 and role == (turns[-1][0] if turns else before):
            (turns[-1][1] if turns else rest).append(line)
            continue
        mark, text = marker(line)
        turns.append((role, [] if text is None else [text]))
    for part in (rest, *(t for _, t in turns)):
        if part and part[-1] == "":
            part.pop()
    return rest, turns


def written(lines: list[str]) -> str:
    return "".join(f"{line}\n" for line in lines)


def rendered(turns: list[tuple[str, list[str]]]) -> str:
    return "".join(OPEN.format(role=role) + written(lines) + CLOSE for role, lines in turns)


def train(labelled: DataFrame) -> Model:
    """A model from (text, states): transcripts with a state for each line; lines of state -1 are left out."""

    def make():
        def work(batch):
            first, move = np.zeros(STATES, np.int64), np.zeros((STATES, STATES), np.int64)
            show = np.zeros((STATES, SYMBOLS), np.int64)
            for text, states in zip(batch["text"].to_pylist(), batch["states"].to_pylist(), strict=True):
                states, symbols = np.array(states, np.int64), observed(text.split("\n"))
                known = states >= 0
                if known[0]:
                    first[states[0]] += 1
                both = known[1:] & known[:-1]
                np.add.at(move, (states[:-1][both], states[1:][both]), 1)
                np.add.at(show, (states[known], symbols[known]), 1)
            flat = np.concatenate((first, move.ravel(), show.ravel()))
            return {"cell": np.flatnonzero(flat), "times": flat[np.flatnonzero(flat)]}

        return work

    found = arrow_map(labelled.select("text", "states"), make, "cell long, times long")
    cells = found.groupBy("cell").agg(F.sum("times").alias("times")).toArrow()
    flat = np.zeros(STATES + STATES**2 + STATES * SYMBOLS)
    flat[cells["cell"].to_numpy()] = cells["times"].to_numpy()
    move = flat[STATES : STATES + STATES**2].reshape(STATES, STATES)
    return Model(logs(flat[:STATES]), logs(move), logs(flat[STATES + STATES**2 :].reshape(STATES, SYMBOLS)))


def parse_transcripts(df: DataFrame, model: Model, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, line_roles, roles, rendered): the parsed form of each row's transcript.

    ``line_roles`` has a place in ROLES for each line, ``roles`` the turns' roles. Null and
    blank texts have empty lists and an empty rendering; other columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kinds = dict(df.dtypes)
    names = [f"key{i}" for i in range(len(keys))]

    def make():
        def work(batch):
            made = [parse(shared.value, t) for t in batch["transcript"].to_pylist()]
            return {k: batch[k] for k in names} | {
                "line_roles": [m[0] for m in made], "roles": [[r for r, _ in m[1]] for m in made],
                "rendered": [rendered(m[1]) for m in made],
            }

        return work

    schema = "".join(f"{n} {kinds[k]}, " for n, k in zip(names, keys, strict=True))
    found = arrow_map(
        df.select(*[F.col(k).alias(n) for n, k in zip(names, keys, strict=True)], F.col(text).alias("transcript")), make,
        f"{schema}line_roles array<int>, roles array<string>, rendered string",
    )
    return found.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], "line_roles", "roles", "rendered")


SLICES = "conv_id long, part long, text string, states array<int>"


def written_turn(conv: int | None, turn: int | None, role: str | None, text: str) -> tuple[list[str], list[int]]:
    """A turn's lines in the style of its conversation, a blank one after them, and their states (-1: unknown role)."""
    known = role in ROLES
    state = 2 * ROLES.index(role) if known else -1
    body = text.split("\n")
    style, bare = (conv or 0) % 5, ((conv or 0) * 31 + (turn or 0) * 7) % 5 == 0
    name = role or "speaker"
    head = body if bare else {
        0: [f"{name.capitalize()}: {body[0]}", *body[1:]], 1: [f"### {name.capitalize()}:", *body],
        2: [f"<|{name}|>", *body], 3: [f"[{name.upper()}] {body[0]}", *body[1:]],
        4: [f"**{name.capitalize()}**: {body[0]}", *body[1:]],
    }[style]
    return [*head, ""], [state, *[state + 1 if known else -1] * len(head)]


def written_out(df: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as transcripts in mixed styles: (conv_id, part, text, states).

    A conversation is one transcript in one or more parts of at most SLICE_ROWS rows,
    numbered in their order; rows are range-partitioned, so that no conversation, however
    long, is gathered whole. The style of markers follows the conversation's id; about
    every fifth turn has none. Repeated rows are turns each; a null text is empty, rows
    without a turn come last, and a row without a known role has state -1.
    """
    rows = df.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("copy", F.monotonically_increasing_id())
    order = [F.asc("conv_id"), F.asc_nulls_last("turn"), F.asc("role"), F.asc("text"), F.asc("copy")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("copy").withColumn("at", F.spark_partition_id())
    parsed = StructType.fromDDL(SLICES)
    target = to_arrow_schema(parsed)

    def run(batches):
        held: list = []
        number = 0

        def slice_of(conv, at, held, number):
            turns = [written_turn(conv, *turn) for turn in held]
            columns = {
                "conv_id": [conv], "part": [(at << 32) + number], "text": ["\n".join(line for t in turns for line in t[0])],
                "states": [[state for t in turns for state in t[1]]],
            }
            return to_batch(columns, target)

        conv = at = None
        for batch in batches:
            for own, turn, role, text, place in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if held and (own != conv or len(held) == SLICE_ROWS):
                    yield slice_of(conv, at, held, number)
                    held, number = [], number + 1
                conv, at = own, place
                held.append((turn, role, text))
        if held:
            yield slice_of(conv, at, held, number)

    return dealt.mapInArrow(run, parsed)


def best_through(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """The (max, +) product; ``first`` is a matrix or a row of scores."""
    return (first[..., :, None] + then).max(axis=-2)


def passages(slices: DataFrame, shared) -> DataFrame:
    """(conv_id, at, part, through, start) of every slice; ``at`` is its partition."""

    def make():
        def work(batch):
            out = {"through": [], "start": []}
            for text in batch["text"].to_pylist():
                through, start = shared.value.passage(observed(text.split("\n")))
                out["through"].append(through.ravel())
                out["start"].append(start)
            return {"conv_id": batch["conv_id"], "part": batch["part"]} | out

        return work

    found = arrow_map(slices.select("conv_id", "part", "text"), make, "conv_id long, part long, through array<double>, start array<double>")
    return found.withColumn("at", F.shiftright("part", 32))


def entering(slices: DataFrame, shared) -> DataFrame:
    """(part, before, last): for every slice the scores of the states before it (null: it opens the conversation)
    and the state it ends in.

    Slices of a conversation meet by partition, and then one row a partition meets by
    conversation, so that a group has no more rows than a partition has slices, or than there are partitions.
    """
    square = (STATES, STATES)
    by_part = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    held = stage(
        passages(slices, shared).groupBy("conv_id", "at").agg(by_part("part", "through", "start").alias("own"))
        .withColumn("head", F.col("own")[0]["part"])
    )

    def product(batch):
        out = {"through": [], "start": []}
        for own in batch["own"].to_pylist():
            through, start = None, np.array(own[0]["start"])
            for i, s in enumerate(own):
                m = np.array(s["through"]).reshape(square)
                through = m if through is None else best_through(through, m)
                start = start if i == 0 else best_through(start, m)
            out["through"].append(through.ravel())
            out["start"].append(start)
        return {"conv_id": batch["conv_id"], "head": batch["head"]} | out

    def enter(batch):
        out = {"head": [], "before": [], "final": []}
        for own in batch["own"].to_pylist():
            score = None
            for i, p in enumerate(own):
                out["head"].append(p["head"])
                out["before"].append(score)
                score = np.array(p["start"]) if i == 0 else best_through(score, np.array(p["through"]).reshape(square))
                out["final"].append(int(score.argmax()) if i == len(own) - 1 else None)
        return out

    def trace(batch):
        """Scores into each slice, and from each state at the partition's end the state before the partition."""
        out = {"head": batch["head"], "befores": [], "back": []}
        for own, before in zip(batch["own"].to_pylist(), batch["before"].to_pylist(), strict=True):
            score, befores, back = None if before is None else np.array(before), [], np.arange(STATES)
            steps = []
            for s in own:
                m = np.array(s["through"]).reshape(square)
                befores.append(score)
                if score is None:
                    score = np.array(s["start"])
                    steps.append(np.zeros(STATES, np.int64))
                else:
                    steps.append((score[:, None] + m).argmax(axis=0))
                    score = best_through(score, m)
            for step in reversed(steps):
                back = step[back]
            out["befores"].append(befores)
            out["back"].append(back)
        return out

    def ends(batch):
        """The state each partition's slices end in, from the last partition back."""
        out = {"head": [], "last": [], "closes": []}
        for own in batch["own"].to_pylist():
            state = next(p["final"] for p in own if p["final"] is not None)
            for i, p in enumerate(reversed(own)):
                out["head"].append(p["head"])
                out["last"].append(state)
                out["closes"].append(i == 0)
                state = p["back"][state]
        return out

    def spread(batch):
        out = {"part": [], "before": [], "last": [], "closes": []}
        for own, befores, last, closes in zip(*(batch[n].to_pylist() for n in ("own", "befores", "last", "closes")), strict=True):
            state = last
            for i in range(len(own) - 1, -1, -1):
                out["part"].append(own[i]["part"])
                out["before"].append(befores[i])
                out["last"].append(state)
                out["closes"].append(closes and i == len(own) - 1)
                if befores[i] is not None:
                    m = np.array(own[i]["through"]).reshape(square)
                    state = int((np.array(befores[i]) + m[:, state]).argmax())
        return out

    double = "array<double>"
    products = arrow_map(held.select("conv_id", "head", "own"), lambda: product, f"conv_id long, head long, through {double}, start {double}")
    grouped = products.groupBy("conv_id").agg(by_part("head", "through", "start").alias("own"))
    entered = stage(arrow_map(grouped.select("own"), lambda: enter, f"head long, before {double}, final int"))
    traced = stage(arrow_map(held.select("head", "own").join(entered, "head").select("head", "own", "before"), lambda: trace, f"head long, befores array<{double}>, back array<int>"))
    chain = held.select("conv_id", "head").join(entered, "head").join(traced, "head").groupBy("conv_id").agg(by_part("head", "final", "back").alias("own"))
    ended = arrow_map(chain.select("own"), lambda: ends, "head long, last int, closes boolean")
    full = held.select("head", "own").join(traced, "head").join(ended, "head").select("own", "befores", "last", "closes")
    return arrow_map(full, lambda: spread, f"part long, before {double}, last int, closes boolean")


def parse_slices(slices: DataFrame, model: Model) -> DataFrame:
    """(conv_id, part, states, line_roles, roles, rendered) of slices of conversations, each decoded as a whole.

    Renderings of a conversation, joined in the order of ``part``, are its whole rendering;
    ``roles`` has the turns that open in the part.
    """
    shared = slices.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(batch):
            out: dict[str, list] = {"line_roles": [], "roles": [], "rendered": []}
            columns = (batch[n].to_pylist() for n in ("text", "before", "last", "closes", "opening"))
            for text, before, last, closes, opening in zip(*columns, strict=True):
                lines = text.split("\n")
                before = None if before is None else np.array(before)
                states = shared.value.decode(observed(lines), before, last)
                rest, turns = cut(lines, states.tolist(), None if opening is None else ROLES[opening // 2])
                whole = CLOSE.join(OPEN.format(role=role) + written(part) for role, part in turns)
                if opening is not None:
                    # a blank line ends every part; it belongs to a turn that goes on here
                    goes_on = states[0] % 2 == 1 and states[0] // 2 == opening // 2
                    whole = (written(["", *rest]) if goes_on else "") + (CLOSE + whole if turns else "")
                out["rendered"].append(whole + (CLOSE if closes else ""))
                out["line_roles"].append(states // 2)
                out["roles"].append([role for role, _ in turns])
            return {n: batch[n] for n in ("conv_id", "part", "states")} | out

        return work

    known = stage(entering(slices, shared))
    # the state before a slice is the last one of the slice before it, if that is of the same conversation
    order = Window.partitionBy("conv_id").orderBy("part")
    ends = slices.select("conv_id", "part").join(known, "part")
    ends = ends.withColumn("opening", F.lag("last").over(order)).drop("conv_id")
    return arrow_map(
        slices.join(ends, "part").select("conv_id", "part", "states", "text", "before", "last", "closes", "opening"), make,
        "conv_id long, part long, states array<int>, line_roles array<int>, roles array<string>, rendered string",
    )


def chat_format(df: DataFrame) -> DataFrame:
    """Write conversations out as transcripts, learn from folds other than 1, parse all transcripts.

    (conv_id, part, n_lines, n_right, n_turns, roles, rendered); ``n_right`` counts lines
    whose role was recovered, of those that have a known one (``n_lines``). A conversation
    has one row, and further ones, numbered in order, per SLICE_ROWS rows; see
    ``parse_slices``. Rows without a conversation form one; an empty table gives no rows;
    other columns are ignored.
    """
    slices = stage(written_out(df))
    model = train(slices.filter(F.coalesce(fold("conv_id", 3) != 1, F.lit(False))))
    parsed = parse_slices(slices, model)
    truth = F.transform("states", lambda s: F.floor(s / 2).cast("int"))
    pairs = F.zip_with("truth", "line_roles", lambda a, b: F.when(a >= 0, (a == b).cast("int")))
    return parsed.withColumn("truth", truth).withColumn("pairs", pairs).select(
        "conv_id", "part",
        F.size(F.filter("truth", lambda a: a >= 0)).cast("long").alias("n_lines"),
        F.aggregate("pairs", F.lit(0), lambda total, x: total + F.coalesce(x, F.lit(0))).cast("long").alias("n_right"),
        F.size("roles").cast("long").alias("n_turns"), F.array_join("roles", ",").alias("roles"), "rendered",
    )
