"""Fill-in-middle by one regular expression with counted quantifiers.

``regexp_count`` gives a text's number of units.  Two hashed cut points, a and
b, make a pattern of its own for the row: a possessive group of exactly a
units, one of exactly b - a units, and the rest.  A single match captures
prefix, middle and suffix and writes them out in their new order; possessive
repeats of a group run as a loop, so the length of a text does not matter.
Spark expressions only, without a shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is counted and never cut apart.
UNIT = "[A-Za-z]+|[^A-Za-z]"
#: The same for a possessive repeat: a run of letters gives nothing back.
WHOLE_UNIT = "(?:[A-Za-z]++|[^A-Za-z])"
MARKS = ("<P>", "<S>", "<M>")


def _draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the hash of seed and doc_id; a null
    doc_id counts as an empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _quoted(mark: str) -> str:
    return re.sub(r"([\\$])", r"\\\1", mark)


def _any(marks: tuple[str, str, str]) -> str:
    return "|".join(rf"\Q{m}\E" for m in marks)


def rearrange(docs: DataFrame, keep: Column, seed: int = 1, marks: tuple[str, str, str] = MARKS, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """(kept_as, n, form, prefix, middle, suffix, output) for each row: ``keep``,
    the number of units, the form and the text in that form.

    psm is prefix, suffix, middle and spm is suffix, prefix, middle, each part
    behind its mark.  plain leaves the text as it is, with null parts: empty
    and null texts, texts that hold a mark, and ``plain_percent`` of the others.
    Any part may be empty.  Repeated rows and doc_ids are rearranged one by one,
    and rows of one doc_id get the same draws; a null doc_id draws like an
    empty string.  Other columns are not read, an empty table gives no row."""
    first, second, third, fourth = _draws(F.col("doc_id"), seed)
    text = F.coalesce("text", F.lit(""))
    rows = (docs.select(keep.alias("kept_as"), text.alias("text"), first.alias("h1"), second.alias("h2"), third.alias("h3"), fourth.alias("h4"))
            .withColumn("n", F.regexp_count("text", F.lit(UNIT)).cast("long"))
            .withColumn("a", F.least(F.expr("h1 % (n + 1)"), F.expr("h2 % (n + 1)")))
            .withColumn("b", F.greatest(F.expr("h1 % (n + 1)"), F.expr("h2 % (n + 1)")))
            .withColumn("form", F.when((F.col("text") == "") | F.col("text").rlike(_any(marks)) | (F.col("h3") % 100 >= 100 - plain_percent), "plain")
                        .when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")))
    pattern = F.concat(F.lit(rf"(?s)\A(?<p>{WHOLE_UNIT}{{"), F.col("a").cast("string"), F.lit(rf"}}+)(?<m>{WHOLE_UNIT}{{"), (F.col("b") - F.col("a")).cast("string"),
                       F.lit(r"}+)(?<s>.*+)\z"))
    p, s, m = map(_quoted, marks)
    order = F.when(F.col("form") == "psm", rf"{p}${{p}}{s}${{s}}{m}${{m}}").otherwise(rf"{s}${{s}}{p}${{p}}{m}${{m}}")
    rows = rows.withColumn("output", F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, order)))
    parts = parts_of(F.col("output"), F.col("form"), marks)
    return (rows.withColumn("parts", parts)
            .select("kept_as", "n", "form", F.col("parts.prefix").alias("prefix"), F.col("parts.middle").alias("middle"), F.col("parts.suffix").alias("suffix"), "output"))


def parts_of(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The struct (prefix, middle, suffix) read back from a rearranged text;
    null for plain ones."""
    psm = form == "psm"
    read = F.transform(F.array(F.split(output, _any(marks), -1)), lambda x: F.struct(
        F.when(psm, x[1]).otherwise(x[2]).alias("prefix"), x[3].alias("middle"), F.when(psm, x[2]).otherwise(x[1]).alias("suffix")))[0]
    return F.when(form != "plain", read)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text from which ``rearrange`` made ``output``."""
    return F.coalesce(F.transform(F.array(parts_of(output, form, marks)), lambda x: F.concat(x["prefix"], x["middle"], x["suffix"]))[0], output)


def infill_query(docs: DataFrame) -> DataFrame:
    rows = rearrange(docs, F.col("doc_id"))
    return rows.select(F.col("kept_as").alias("doc_id"), "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
                       F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))


def _sql() -> str:
    digits = "'0123456789abcdef'"
    draw = lambda i: " + ".join(f"(instr({digits}, h[{8 * i + k + 1}]) - 1) * {16 ** (7 - k)}::BIGINT" for k in range(8))
    return rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), units AS (
  SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u, {draw(0)} AS h1, {draw(1)} AS h2, {draw(2)} AS h3, {draw(3)} AS h4 FROM t
), cuts AS (
  SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM units
), parts AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cuts
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


INFILL_SQL = _sql()
