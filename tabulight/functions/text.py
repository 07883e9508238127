"""Column builders for text: numbers, cuts, responses, names and chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that make a query unsafe, and the marks trimmed off a
# token before it is compared with them.
UNSAFE_WORDS = (
    "DROP", "DELETE", "UPDATE", "INSERT", "ALTER", "CREATE", "TRUNCATE",
    "EXEC", "EXECUTE", "MERGE", "BULK", "BACKUP", "RESTORE",
)
TOKEN_MARKS = ".,;()[]"
# Lines about tables, lines to skip, and the shape of a name.
TABLE_WORDS = ("table", "表格")
CONSTRAINT_WORDS = ("constraint", "foreign", "primary", "unique")
NAME_PATTERN = "^[A-Za-z0-9_]{1,50}$"
NAME_MARKS = ".,;:\"'"
# Blank characters: controls, the Unicode space separators and line separators.
BLANK_CHARS = (
    "\t\n\v\f\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
BLANKS = r"[\s\u0085\p{Z}]+"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trimmed(text: Column) -> Column:
    """Blank characters of any kind removed from both ends."""
    return F.btrim(text, F.lit(BLANK_CHARS))


def words(text: Column) -> Column:
    """The non-blank words of a text."""
    return F.filter(F.split(text, BLANKS), lambda word: word != "")


def leading_number(text: Column) -> Column:
    """Leading digits (or a whole signed number) as a long, else 0."""
    digits = F.regexp_extract(trimmed(text), r"^([0-9]+|[+-][0-9]+$)", 1)
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def text_summary(text: Column, limit: int = 200, least: int = 50) -> Column:
    """Texts over ``limit`` are cut at their last full stop past ``least``, else hard."""
    head = F.substring(text, 1, limit)
    back = F.locate(".", F.reverse(head))
    stop = F.when(back == 0, F.lit(-1)).otherwise(F.length(head) - back)
    cut = F.when(stop > least, F.substring(text, F.lit(1), stop + 1)).otherwise(F.concat(head, F.lit("...")))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def hard_cut(text: Column, limit: int = 500) -> Column:
    """The first ``limit`` characters and an ellipsis if there were more."""
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))
    ).otherwise(text)


def json_part(text: Column) -> Column:
    """From the first ``{`` to the last ``}``; null if there is none."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def json_from_text(text: Column, schema: str) -> Column:
    """The JSON object inside a response, decoded; null where none is found."""
    return F.from_json(json_part(text), schema)


def sql_from_text(text: Column) -> Column:
    """The first SELECT statement of a response, code fences and final ``;`` removed."""
    body = F.regexp_replace(trimmed(text), r"^```sql", "")
    body = F.regexp_replace(F.regexp_replace(body, r"^```", ""), r"```$", "")
    lines = F.transform(F.split(body, "\n"), trimmed)
    start = F.array_position(
        F.transform(lines, lambda line: F.startswith(F.upper(line), F.lit("SELECT"))), True
    ).cast("int")
    rest = F.slice(lines, start + 1, F.size(lines))
    stop = F.array_position(F.transform(rest, lambda line: F.contains(line, F.lit(";"))), True).cast("int")
    taken = F.slice(rest, F.lit(1), F.when(stop > 0, stop).otherwise(F.size(rest)))
    found = F.array_join(F.concat(F.slice(lines, start, F.lit(1)), taken), " ")
    return F.regexp_replace(trimmed(F.when(start > 0, found).otherwise(body)), ";$", "")


def unsafe_word(query: Column) -> Column:
    """The first forbidden token of a query text, null if there is none."""
    tokens = F.transform(words(F.upper(query)), lambda t: F.btrim(t, F.lit(TOKEN_MARKS)))
    return F.get(F.filter(tokens, lambda t: t.isin(*UNSAFE_WORDS)), F.lit(0))


def is_read_only(query: Column) -> Column:
    """True iff the text starts with SELECT and holds no forbidden token."""
    starts = F.startswith(F.upper(trimmed(query)), F.lit("SELECT"))
    return F.coalesce(starts & unsafe_word(query).isNull(), F.lit(False))


def names_in_text(content: Column) -> Column:
    """Table names of one document: keys of its ``tables`` object, else one per line."""
    tables = F.get_json_object(content, "$.tables")
    keys = F.filter(F.json_object_keys(tables), lambda name: name.rlike(NAME_PATTERN))

    def first_name(line: Column) -> Column:
        parts = F.transform(words(line), lambda word: F.btrim(word, F.lit(NAME_MARKS)))
        return F.get(F.filter(parts, lambda word: word.rlike(NAME_PATTERN)), F.lit(0))

    def about_table(line: Column) -> Column:
        low = F.lower(line)
        about = F.contains(low, F.lit(TABLE_WORDS[0])) | F.contains(line, F.lit(TABLE_WORDS[1]))
        skip = F.lit(False)
        for word in CONSTRAINT_WORDS:
            skip = skip | F.contains(low, F.lit(word))
        return about & ~skip

    lines = F.filter(F.split(content, "\n"), about_table)
    from_lines = F.filter(F.transform(lines, first_name), lambda name: name.isNotNull())
    return F.array_distinct(F.when(keys.isNotNull(), keys).otherwise(from_lines))


def line_chunks(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Windows of ``size`` lines, each sharing ``overlap`` lines with the one before.

    The windows are cut inside the row, so no line leaves its document and
    nothing is shuffled. Blank windows are null, to keep the numbering.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    stride = size - overlap

    def windows(lines: Column) -> Column:
        count = F.greatest(F.lit(1), F.ceil((F.size(lines) - overlap) / stride).cast("int"))
        pieces = F.transform(
            F.sequence(F.lit(0), count - 1),
            lambda number: trimmed(F.array_join(F.slice(lines, number * stride + 1, F.lit(size)), "\n")),
        )
        return F.transform(pieces, lambda piece: F.when(piece != "", piece))

    # Bound, so the text is split once and not once a window.
    return bind(F.split(text, "\n"), windows)


def collection_items(text: Column) -> Column:
    """Items of a text split by the first of ``, ; |`` it holds, trimmed, none blank."""
    parts = (
        F.when(F.contains(text, F.lit(",")), F.split(text, ","))
        .when(F.contains(text, F.lit(";")), F.split(text, ";"))
        .when(F.contains(text, F.lit("|")), F.split(text, r"\|"))
        .otherwise(F.array(text))
    )
    return F.filter(F.transform(parts, trimmed), lambda item: item != "")
