"""JSON documents as readable lines, to any depth."""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What each stage's findings are about.
PHASE_DESCRIPTIONS = {
    "phase1": "Database statistical analysis with table schemas, constraints, and sample data",
    "phase2": "AI-powered business logic analysis with LLM insights and recommendations",
    "phase3": "Business logic analysis and natural language description generation",
}


TOKEN = re.compile(
    r'[ \t\n\r]*(?:([\[\]{},:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?![0-9.]))|'
    r"(true|false|null|NaN|-?Infinity))"
)
WORDS = {"true": True, "false": False, "null": None}
LONE_SURROGATE = re.compile("[\ud800-\udfff]")


def _parsed(body: str) -> Any:
    """The decoded body, numbers as they are spelled; a body that is no JSON is one text."""
    try:
        return json.loads(body, parse_int=str, parse_float=str, parse_constant=str)
    except ValueError:
        return body
    except RecursionError:
        return _parsed_deep(body)


def _parsed_deep(body: str) -> Any:
    """The same for bodies that nest deeper than the parser goes: open objects and lists are kept in a stack."""
    document: list = []
    stack: list = [document]
    names: list = [None]
    want, at = "value", 0
    while want != "nothing":
        token = TOKEN.match(body, at)
        if token is None:
            return body
        at = token.end()
        mark, text, number, word = token.groups()
        top = stack[-1]
        try:
            text = None if text is None else json.loads(text)
        except ValueError:
            return body
        if text is not None and want in ("name", "name or end"):
            names[-1], want = text, "colon"
        elif mark == ":" and want == "colon":
            want = "value"
        elif mark == "," and want == "comma or end":
            want = "name" if isinstance(top, dict) else "value"
        elif mark in ("]", "}") and want.endswith("or end") and isinstance(top, dict) == (mark == "}"):
            stack.pop()
            names.pop()
            want = "comma or end" if len(stack) > 1 else "nothing"
        elif want in ("value", "value or end") and mark in ("[", "{", None):
            item = [] if mark == "[" else {} if mark == "{" else text if text is not None else number if number else WORDS.get(word, word)
            if isinstance(top, dict):
                top[names[-1]] = item
            else:
                top.append(item)
            if mark:
                stack.append(item)
                names.append(None)
                want = "name or end" if mark == "{" else "value or end"
            else:
                want = "comma or end" if len(stack) > 1 else "nothing"
        else:
            return body
    return body if body[at:].strip(" \t\n\r") else document[0]


def _writable(text: str) -> str:
    """Half of a surrogate pair is no character; each becomes U+FFFD."""
    return LONE_SURROGATE.sub("\ufffd", text)


def _inside(value: Any) -> list[tuple[str, Any]] | None:
    """Named parts of an object or list, null for anything else."""
    if isinstance(value, dict):
        return list(value.items())
    if isinstance(value, list):
        return [(f"[{i}]", item) for i, item in enumerate(value)]
    return None


def _scalar(value: Any) -> str:
    if value is None:
        return "<nil>"
    if isinstance(value, bool):
        return "true" if value else "false"
    return value


def _lines(value: Any) -> str:
    out, todo = [], [(False, value)]
    while todo:
        ready, item = todo.pop()
        parts = None if ready else _inside(item)
        if parts is None:
            out.append(item if ready else _scalar(item))
            continue
        for name, part in reversed(parts):
            todo += [(True, "\n"), (False, part), (True, f"{name}: ")]
    return "".join(out)


def _outline(value: Any) -> str:
    out, todo = [], [(0, None, value)]
    while todo:
        level, name, item = todo.pop()
        if name is not None:
            out.append(f"{'  ' * (level - 1)}{name}:\n")
        parts = _inside(item)
        if parts is None:
            out.append(f"{'  ' * level}{_scalar(item)}\n")
        else:
            todo += [(level + 1, n, part) for n, part in reversed(parts)]
    return "".join(out)


@F.pandas_udf(StringType())
def _lines_of(bodies: pd.Series) -> pd.Series:
    return bodies.map(lambda body: _writable(_lines(None if body is None else _parsed(body))))


@F.pandas_udf(StringType())
def _outline_of(bodies: pd.Series) -> pd.Series:
    return bodies.map(lambda body: _writable(_outline(None if body is None else _parsed(body))))


def json_lines(value: Column) -> Column:
    """``key: value`` and ``[i]: item`` lines of a JSON body, however deep it goes.

    Strings are written as they are, whatever they start with; null is ``<nil>``; half of
    a surrogate pair is written as U+FFFD. A body that is no JSON is kept as its text.
    """
    return _lines_of(value)


def json_outline(value: Column) -> Column:
    """Keys and items on their own lines, two blanks of indent per level; bodies as above."""
    return _outline_of(value)


def findings_text(phase: str, value: Column, timestamp: Column) -> Column:
    """A stage's findings under a header that names the stage."""
    return F.concat(
        F.lit(f"Phase: {phase}\nDescription: {PHASE_DESCRIPTIONS.get(phase, '')}\nTimestamp: "),
        timestamp.cast("string"),
        F.lit("\n\n"),
        json_outline(value),
    )
