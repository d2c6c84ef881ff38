"""Quality rules by distribution divergence, with Spark expressions only.

Each document's histogram of character classes, and of its language's common
words, is compared with the histogram of all documents of that language by
Jensen-Shannon distance (base 2, 0 to 1).  Short documents are not compared:
their histograms are too coarse.  Nor are documents without a language, or of
one without a word list that has too little text to tell what is usual in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlake.llm._common import written

#: Common words of each language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se"],
}
N_COMMON = 10
#: Characters that a language without a word list must have in all to be compared with.
LEAST_CHARS = 100_000
#: Parts that the rows of a language are dealt to.
SALTS = 256
#: Character classes, taken off one after the other; what is left are symbols.
CLASSES = ["[a-z]+", "[\\x20\\x09-\\x0D]+", "[^\\x00-\\x7F]+", "[A-Z]+", "[0-9]+", "[.,;:!?'\"()-]+"]
BLANK = " \t\n\x0b\f\r"


def _bound(value: Column, use) -> Column:
    """use(value), with the value evaluated once."""
    return F.transform(F.array(value), use)[0]


def _common(lang: Column) -> Column:
    lists = [F.when(lang == k, F.array(*map(F.lit, v))) for k, v in COMMON_WORDS.items()]
    return F.coalesce(*lists, F.array().cast("array<string>"))


def _with_words(docs: DataFrame, *keep: Column) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return (docs.select(*keep, text.alias("text"), "lang")
            .withColumn("words", F.split(F.btrim("text", F.lit(BLANK)), "[\\x20\\x09-\\x0D]+"))
            .withColumn("n_words", F.when(F.btrim("text", F.lit(BLANK)) == "", 0).otherwise(F.size("words")).cast("long")))


def _with_histograms(rows: DataFrame) -> DataFrame:
    """Adds ``classes`` and ``common``: counts, as arrays of doubles."""
    left = [F.col("text")]
    for i, one in enumerate(CLASSES):
        rows = rows.withColumn(f"left{i}", F.regexp_replace(left[-1], one, ""))
        left.append(F.col(f"left{i}"))
    classes = F.array(*[(F.length(a) - F.length(b)).cast("double") for a, b in zip(left, left[1:])], F.length(left[-1]).cast("double"))
    # words stand between two blanks each, so that every one can be cut out by itself
    rows = rows.withColumn("spaced", F.lower(F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" "))))
    count = lambda x: (F.octet_length("spaced") - F.octet_length(F.replace(F.col("spaced"), F.concat(F.lit(" "), x, F.lit(" ")), F.lit("")))) / (F.octet_length(x) + 2)
    rows = rows.withColumn("classes", classes).withColumn("found", F.transform(_common(F.col("lang")), count))
    # the last bin holds all other words
    return (rows.withColumn("common", F.when(F.size("found") > 0, F.concat("found", F.array(F.col("n_words") - F.aggregate("found", F.lit(0.0), lambda s, x: s + x))))
                            .otherwise(F.array(F.col("n_words").cast("double"))))
            .drop("found", "spaced", *[f"left{i}" for i in range(len(CLASSES))]))


def references(rows: DataFrame) -> DataFrame:
    """(lang, ref_classes, ref_common): the summed histograms of all documents
    of each language, as ``lang`` names it.  Without a row: null, and languages
    without a word list that have less than ``LEAST_CHARS`` characters."""
    sums = lambda c, n: F.array(*[F.coalesce(F.sum(F.get(c, F.lit(i))), F.lit(0.0)) for i in range(n)])
    return (rows.filter("lang is not null").groupBy("lang")
            .agg(sums("classes", len(CLASSES) + 1).alias("ref_classes"), sums("common", N_COMMON + 1).alias("ref_common"), F.sum("n_chars").alias("chars"))
            .filter(F.col("lang").isin(list(COMMON_WORDS)) | (F.col("chars") >= LEAST_CHARS)).drop("chars"))


def js_distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two histograms; 0 where one of them is empty."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    return _bound(total(counts), lambda n: _bound(total(reference), lambda m: F.when((n > 0) & (m > 0), F.sqrt(F.greatest(F.lit(0.0), F.aggregate(
        F.zip_with(counts, reference, lambda x, y: part(F.coalesce(x, F.lit(0.0)) / n, F.coalesce(y, F.lit(0.0)) / m) + part(F.coalesce(y, F.lit(0.0)) / m, F.coalesce(x, F.lit(0.0)) / n)),
        F.lit(0.0), lambda s, x: s + x) / 2))).otherwise(0.0)))


def _repeat_words(rows: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words inside a three-word window that occurs again."""
    at = F.when(F.col("n_words") >= 3, F.slice("words", F.lit(1), F.size("words") - 2)).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("windows", F.transform(at, lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))))
    again = lambda s, x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False))
    starts = _bound(F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
                    lambda s: F.sort_array(F.transform(F.filter(s, lambda x, i: again(s, x, i)), lambda x: x["i"])))
    covered = _bound(starts, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda s, x: s + x))
    return rows.withColumn("n_repeat_words", F.when(F.size(F.array_distinct("windows")) == F.size("windows"), 0).otherwise(covered).cast("long")).drop("windows")


def score(docs: DataFrame, keep: Column, min_chars: int = 400, min_words: int = 100, max_class_distance: float = 0.3, max_word_distance: float = 0.35) -> DataFrame:
    """``keep`` (as column ``kept_as``) and, for each document, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, class_distance, word_distance, base_failed and
    kept.

    A null text is empty; an empty text has no word and fails the base rule.  A
    language without a word list is compared by character classes alone, with
    the documents of that very language, and not at all if these have too
    little text or it is null.  Distances are 0 where nothing is compared, and
    below ``min_chars`` characters or ``min_words`` words.  Repeated rows and doc_ids
    are scored one by one; an empty table gives no row."""
    rows = _with_histograms(_repeat_words(_with_words(docs, keep.alias("kept_as"))))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANK)) != ""))
    # features are made once: the references are summed from what is written
    rows = written(rows.select(
        "kept_as", "lang", "classes", "common", F.length("text").alias("n_chars"), "n_words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.octet_length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words"), "quality")
    # any number of languages: written, so that Spark knows whether it can broadcast them
    known = written(references(rows), "references").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("n_chars", "n_words", "word_chars", "classes"), F.lit(SALTS)).cast("int")).join(known, ["lang", "salt"], "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (rows.select(
        "kept_as", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.when(F.col("n_chars") >= min_chars, js_distance(F.col("classes"), F.col("ref_classes"))).otherwise(0.0).alias("class_distance"),
        F.when((F.col("n_words") >= min_words) & F.col("lang").isin(list(COMMON_WORDS)), js_distance(F.col("common"), F.col("ref_common"))).otherwise(0.0).alias("word_distance"),
        failed.alias("base_failed"))
        .withColumn("kept", ~F.col("base_failed") & (F.col("class_distance") <= max_class_distance) & (F.col("word_distance") <= max_word_distance)))


def quality_query(docs: DataFrame) -> DataFrame:
    return (score(docs, F.col("doc_id"))
            .select(F.col("kept_as").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns."""
    return score(docs, F.struct("*")).filter("kept").select("kept_as.*")


def _sql() -> str:
    common = ", ".join(f"('{lang}', {words})" for lang, words in COMMON_WORDS.items())
    known = ", ".join(f"'{lang}'" for lang in COMMON_WORDS)
    shares = ", ".join(f"length(regexp_replace(text, '[^{c}]', '', 'g'))" for c in ("a-z", "\\x20\\x09-\\x0D", "\\x{80}-\\x{10FFFF}", "A-Z", "0-9", ".,;:!?''\"()-"))
    return rf"""
WITH t AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, lang FROM documents
), w AS MATERIALIZED (
  SELECT rid, lang, unnest(words) AS word, generate_subscripts(words, 1) AS i
  FROM (SELECT rid, lang, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t)
), triples AS (
  SELECT rid, i, word, lead(word, 1) OVER o AS word2, lead(word, 2) OVER o AS word3 FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)
), twice AS (
  SELECT rid, i, word, word3 IS NOT NULL AND count(*) OVER (PARTITION BY rid, word, word2, word3) > 1 AS again FROM triples
), inside AS (
  SELECT rid, word, again OR coalesce(lag(again, 1) OVER o, false) OR coalesce(lag(again, 2) OVER o, false) AS repeated FROM twice WINDOW o AS (PARTITION BY rid ORDER BY i)
), by_words AS (
  SELECT rid, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars, count(*) FILTER (repeated) AS n_repeat_words FROM inside GROUP BY rid
), common AS (
  SELECT lang, unnest(words) AS word FROM (VALUES {common}) AS c(lang, words)
), bins AS (
  SELECT lang, word AS bin FROM common UNION ALL SELECT DISTINCT lang, '' FROM common
), counted AS (
  SELECT w.rid, coalesce(common.word, '') AS bin, count(*) AS x FROM w LEFT JOIN common ON common.lang = w.lang AND common.word = lower(w.word) GROUP BY ALL
), classes AS (
  SELECT rid, lang, length(text) AS n, [{shares}] AS shares FROM t
), h AS MATERIALIZED (
  SELECT rid, lang, 'class' AS kind, unnest(['1', '2', '3', '4', '5', '6', '7']) AS bin, unnest(list_append(shares, n - list_sum(shares)::BIGINT))::DOUBLE AS x FROM classes
  UNION ALL
  SELECT t.rid, t.lang, 'word', bins.bin, coalesce(counted.x, 0)::DOUBLE FROM t JOIN bins USING (lang) LEFT JOIN counted ON counted.rid = t.rid AND counted.bin = bins.bin
), sums AS (
  SELECT lang, kind, bin, sum(x) AS y FROM h GROUP BY ALL
), refs AS (
  SELECT lang, kind, bin, y / nullif(sum(y) OVER (PARTITION BY lang, kind), 0) AS b FROM sums
  QUALIFY lang IN ({known}) OR sum(y) OVER (PARTITION BY lang, kind) >= {LEAST_CHARS}
), parts AS (
  SELECT rid, lang, kind, bin, x / nullif(sum(x) OVER (PARTITION BY rid, kind), 0) AS a FROM h
), distances AS (
  SELECT rid, kind, coalesce(sqrt(greatest(0, sum(CASE WHEN a > 0 THEN a * log2(2 * a / (a + b)) ELSE 0 END + CASE WHEN b > 0 THEN b * log2(2 * b / (a + b)) ELSE 0 END) / 2)), 0) AS d
  FROM parts JOIN refs USING (lang, kind, bin) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY rid, kind
), lines AS (
  SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t
), base AS (
  SELECT t.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         CASE WHEN length(text) >= 400 THEN coalesce(c.d, 0) ELSE 0 END AS class_distance, CASE WHEN coalesce(n_words, 0) >= 100 THEN coalesce(v.d, 0) ELSE 0 END AS word_distance
  FROM t JOIN lines USING (rid) LEFT JOIN by_words USING (rid)
  LEFT JOIN distances c ON c.rid = t.rid AND c.kind = 'class' LEFT JOIN distances v ON v.rid = t.rid AND v.kind = 'word'
), failed AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       base_failed, NOT base_failed AND class_distance <= 0.3 AND word_distance <= 0.35 AS kept
FROM failed
"""


QUALITY_SQL = _sql()
