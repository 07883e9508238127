"""License scan by canonical digest: whole texts, and single lines, hash-joined to known licences.

The canonical form has A-Z in lower case, no copyright lines, blanks for punctuation and
one spelling where English has several. Two texts with the same form have the same
digest, so a scan is one join on digests. Everything is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COPYRIGHT_LINE = r"(^|\n)[ \t>*#/;-]*(copyright|\(c\)|©)[^\n]*"
PUNCTUATION = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F©«»‐‑‒–—―‘’‚‛“”„‟•…]+"
MOST_KNOWN = 10_000
# Spellings that count as equal, the second one is used.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"), ("favour", "favor"),
    ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("initialise", "initialize"),
    ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"),
    ("licenced", "licensed"), ("maximise", "maximize"), ("modelled", "modeled"), ("offence", "offense"),
    ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"),
    ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"),
    ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
)
# Texts of public licences and their usual notices.
MIT_TERMS = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
    "the Software.\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
    "SOFTWARE."
)
ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
)
ISC_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
    "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", MIT_TERMS),
    ("MIT", "MIT License\n" + MIT_TERMS),
    ("ISC", f"{ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{ISC_WARRANTY}"),
    ("0BSD", f"{ISC_GRANT}.\n{ISC_WARRANTY}"),
)


def canonical(text: Column) -> Column:
    """The canonical form, line by line: single blanks between words, line ends kept."""
    form = F.regexp_replace(F.translate(text, UPPER, LOWER), COPYRIGHT_LINE, "\n")
    form = F.regexp_replace(form, PUNCTUATION, " ")
    # Two blanks between words and at line ends, so that each word has its own on either side.
    form = F.concat(F.lit(" "), F.replace(F.replace(form, F.lit(" "), F.lit("  ")), F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for other, used in SPELLINGS:
        form = F.replace(form, F.lit(f" {other} "), F.lit(f" {used} "))
    return F.replace(form, F.lit("  "), F.lit(" "))


def words_by_line(form: Column) -> Column:
    """The lines of a canonical form that have words."""
    return F.filter(F.transform(F.split(form, "\n"), lambda line: F.trim(line)), lambda line: line != "")


def digest(form: Column) -> Column:
    return F.when(form != "", F.sha2(form.cast("binary"), 256))


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """(digest, license_id) of the known texts; of equal texts the first id in order."""
    rows = spark.createDataFrame(list(known), "license_id string, text string")
    return known_from(rows)


def known_from(rows: DataFrame) -> DataFrame:
    """(digest, license_id) of a table of (license_id, text)."""
    made = rows.select("license_id", digest(F.array_join(words_by_line(canonical(F.col("text"))), " ")).alias("digest"))
    return made.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(df: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text_digest, license_id, n_notices, notice_ids) for each row of ``df``.

    ``license_id`` is the licence the whole text is; ``notice_ids`` (sorted, with commas)
    are those that a line of it is, counted once. Null texts and such without words have
    no digest and match nothing. Rows with null or repeated keys are rows like others.
    The licences are broadcast while a count proves there are at most MOST_KNOWN.
    """
    lines = words_by_line(canonical(F.col(text)))
    rows = df.select(F.col(key).cast("long").alias("id"), lines.alias("lines"))
    units = F.transform("lines", lambda line: F.unhex(F.substring(F.sha2(line.cast("binary"), 256), 1, 32)))
    whole = digest(F.array_join("lines", " "))
    light = stage(rows.select("id", whole.alias("text_digest"), F.array_distinct(units).alias("units")))
    listed = stage(known)
    few = F.broadcast if listed.count() <= MOST_KNOWN else (lambda frame: frame)
    by_line = listed.select(F.unhex(F.substring("digest", 1, 32)).alias("unit"), F.col("license_id").alias("notice"))
    hits = (
        light.select("id", "text_digest", F.explode("units").alias("unit")).join(few(by_line), "unit")
        .groupBy("id", "text_digest").agg(F.sort_array(F.collect_set("notice")).alias("notices"))
        .withColumnsRenamed({"id": "hit_id", "text_digest": "hit_digest"})
    )
    whole = listed.withColumnRenamed("digest", "text_digest")
    return (
        light.drop("units").join(few(whole), "text_digest", "left")
        .join(hits, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("text_digest") == F.col("hit_digest")), "left")
        .select(
            F.col("id").alias(key), "text_digest", "license_id",
            F.coalesce(F.size("notices"), F.lit(0)).cast("int").alias("n_notices"),
            F.coalesce(F.array_join("notices", ","), F.lit("")).alias("notice_ids"),
        )
    )


def canonical_sql(text: str) -> str:
    """The canonical form as DuckDB SQL."""
    form = f"translate({text}, '{UPPER}', '{LOWER}')"
    form = f"regexp_replace({form}, '{COPYRIGHT_LINE}', chr(10), 'g')"
    form = f"regexp_replace({form}, '{PUNCTUATION}', ' ', 'g')"
    form = f"' ' || replace(replace({form}, ' ', '  '), chr(10), ' ' || chr(10) || ' ') || ' '"
    for other, used in SPELLINGS:
        form = f"replace({form}, ' {other} ', ' {used} ')"
    return f"replace({form}, '  ', ' ')"


def whole_sql(form: str) -> str:
    return f"regexp_replace(trim(regexp_replace({form}, ' *\\n *', ' ', 'g')), '  +', ' ', 'g')"


def scan_sql(known=KNOWN) -> str:
    values = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in known)
    return f"""
WITH known AS (
  SELECT sha256({whole_sql("form")}) AS digest, min(license_id) AS license_id
  FROM (SELECT license_id, {canonical_sql("text")} AS form FROM (VALUES {values}) AS v(license_id, text)) GROUP BY 1
), forms AS (SELECT row_number() OVER () AS r, doc_id, {canonical_sql("text")} AS form FROM documents),
whole AS (SELECT r, doc_id, form, {whole_sql("form")} AS one FROM forms),
lines AS (
  SELECT DISTINCT r, sha256(regexp_replace(trim(line), '  +', ' ', 'g')) AS digest
  FROM (SELECT r, unnest(string_split(form, chr(10))) AS line FROM whole)
), notices AS (
  SELECT r, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids, count(DISTINCT license_id)::INT AS n
  FROM lines JOIN known USING (digest) GROUP BY r
)
SELECT doc_id, CASE WHEN one <> '' THEN sha256(one) END AS text_digest, license_id,
  coalesce(n, 0)::INT AS n_notices, coalesce(ids, '') AS notice_ids
FROM whole LEFT JOIN known ON digest = CASE WHEN one <> '' THEN sha256(one) END LEFT JOIN notices USING (r)
"""
