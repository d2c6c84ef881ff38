"""How far the sources of a language differ in their words.

For each language there is a matrix of counts, one row for each source and one
column for each kept term, and nearly all of it is zero.  It is held as K-squared
quadtrees: columns are numbered such that terms of few sources lie together, the
matrix is cut into squares of ``SIDE`` groups by ``SIDE`` terms, and a square
without a count does not exist.

Two groups are compared by one joint walk down the trees of their squares.  A
quadrant that is zero for both is left at once; all such columns together are
priced by one formula, as each has the same two shares.  What remains are single
columns where either group has a count.

All numbers are whole: shares are in ``SCALE`` parts, and a group's share of a
term is 1 + floor(SCALE * (count + 1) / (N + V)), N being its counts of kept
terms and V the kept terms of its language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlake.llm._common import numbered, written
from fleetlake.session import ship_code

SCALE = 1_000_000_000
#: Groups and terms on a side of a square, a power of two; a unit of work looks at SIDE cubed cells at most.
SIDE = 64
DEPTH = SIDE.bit_length() - 1
#: Bytes of text that are counted at once, unless one text is longer.
AT_ONCE = 16_000_000
#: Parts that the terms of as many sources are numbered in.
CHUNKS = 256

#: Bytes of terms, in lower case; every other byte becomes a blank.
_LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], dtype=np.uint8)


def _counted(group: np.ndarray, text: pa.StringArray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(group, term, n, docs) of some texts, ``group`` being a number for each."""
    _, offsets, data = text.buffers()
    low = _LETTERS[np.frombuffer(data, dtype=np.uint8)] if data else np.zeros(0, dtype=np.uint8)
    words = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(text), offsets, pa.py_buffer(low), offset=text.offset))
    doc = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    coded = words.flatten().dictionary_encode()
    size = len(coded.dictionary)
    code = coded.indices.to_numpy().astype(np.int64)
    some = code != pc.index(coded.dictionary, "").as_py()  # what stands before a first blank and behind a last one
    of_doc, times = np.unique(doc[some] * size + code[some], return_counts=True)
    of_group, at = np.unique(group[of_doc // max(size, 1)] * size + of_doc % max(size, 1), return_inverse=True)
    return (of_group // max(size, 1), coded.dictionary.take(pa.array(of_group % max(size, 1))),
            np.bincount(at, weights=times, minlength=len(of_group)).astype(np.int64), np.bincount(at, minlength=len(of_group)))


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with the term,
    as partial sums of some documents each.  Null columns count as ''."""
    ship_code()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False), dtype=np.int64) // AT_ONCE
            bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for first, last in zip(bounds, bounds[1:]):
                some = batch.slice(first, last - first)
                lang, source = (some[c].dictionary_encode() for c in ("lang", "source"))
                width = max(len(source.dictionary), 1)
                group, term, n, n_docs = _counted(lang.indices.to_numpy().astype(np.int64) * width + source.indices.to_numpy(), some["text"])
                yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(group // width)), source.dictionary.take(pa.array(group % width)), term, pa.array(n), pa.array(n_docs)],
                                                 ["lang", "source", "term", "n", "docs"])

    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*text).mapInArrow(count, "lang string, source string, term string, n long, docs long")


def _share(count: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact; null without terms."""
    return F.expr(f"1 + (cast({count} + 1 as decimal(20, 0)) * cast({SCALE} as decimal(10, 0))) div nullif(cast({total} + {terms} as decimal(20, 0)), 0)")


def _square(at: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """A square of shares, 0 where there is no count."""
    square = np.zeros(SIDE * SIDE, dtype=np.int64)
    square[at] = shares
    return square.reshape(SIDE, SIDE)


def _levels(square: np.ndarray) -> list[np.ndarray]:
    """Which quadrants hold a count, from the whole square to single cells."""
    levels = [square > 0]
    for _ in range(DEPTH):
        x = levels[-1]
        levels.append(x[0::2, 0::2] | x[0::2, 1::2] | x[1::2, 0::2] | x[1::2, 1::2])
    return levels[::-1]


def walk(a: np.ndarray, b: np.ndarray, zeros_a: np.ndarray, zeros_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The joint walk down two squares of shares (0: no count), for groups with
    the share ``zeros_a`` and ``zeros_b`` where they have no count.  For each
    pair of groups: what the columns where either has a count are worth, seen
    from a and seen from b, and how many these are."""
    n, m = len(zeros_a), len(zeros_b)
    trees, others = _levels(a), _levels(b)
    i = j = term = np.zeros(1, dtype=np.int64)
    for depth in range(DEPTH + 1):
        some = trees[depth][i, term] | others[depth][j, term]
        i, j, term = i[some], j[some], term[some]
        if depth < DEPTH:
            half = np.arange(2)
            i, j, term = (x.ravel() for x in np.broadcast_arrays(2 * i[:, None, None, None] + half[:, None, None], 2 * j[:, None, None, None] + half[:, None], 2 * term[:, None, None, None] + half))
            left = DEPTH - 1 - depth
            there = (i << left < n) & (j << left < m)
            i, j, term = i[there], j[there], term[there]
    p, q = a[i, term], b[j, term]
    p, q = np.where(p > 0, p, zeros_a[i]), np.where(q > 0, q, zeros_b[j])
    from_a, from_b = np.zeros(n * m, dtype=np.int64), np.zeros(n * m, dtype=np.int64)
    pair, square = i * m + j, (p - q) * (p - q)
    np.add.at(from_a, pair, square // q)
    np.add.at(from_b, pair, square // p)
    return from_a.reshape(n, m), from_b.reshape(n, m), np.bincount(pair, minlength=n * m).reshape(n, m)


def _walked(units: DataFrame) -> DataFrame:
    """(lang, i, j, value, columns) from units (lang, r, s, zeros_r, zeros_s,
    at_r, p_r, at_s, p_s): squares of rows r and s in the same columns."""
    ship_code()

    def price(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            sums: dict[tuple, list[np.ndarray]] = {}
            for u in part.itertuples(index=False):
                found = walk(_square(u.at_r, u.p_r), _square(u.at_s, u.p_s), u.zeros_r, u.zeros_s)
                held = sums.setdefault((u.lang, u.r, u.s), [np.zeros_like(x) for x in found])
                for total, x in zip(held, found):
                    total += x
            for (lang, r, s), (from_r, from_s, columns) in sums.items():
                i, j = (x.ravel() for x in np.indices(columns.shape))
                for first, second, at, beside, value in ((r, s, i, j, from_r), (s, r, j, i, from_s))[: 1 if r == s else 2]:
                    yield pd.DataFrame({"lang": lang, "i": first * SIDE + at, "j": second * SIDE + beside, "value": value.ravel(), "columns": columns.ravel()})

    return units.mapInPandas(price, "lang string, i long, j long, value long, columns long")


def audit(docs: DataFrame, min_docs: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) for each group of documents with
    one lang and source.

    part pair: every other source of the language, with the sum over its kept
    terms of floor((p - q)^2 / q), p being the group's share and q the other's;
    0 without kept terms.  part term: the ``top`` kept terms that the group has,
    and has more of than its language as a whole, q being the language's share.
    Ranks begin at 1 for each group and part, by value and then by item.

    Kept are terms that at least ``min_docs`` documents of the language hold.
    Null lang, source and text are ''.  Every row is a document of its own,
    repeated rows and doc_ids too.  A language with one source has no pairs.
    Other columns are not read, and an empty table gives no row.  The work grows
    with the counts above zero times the sources of a language."""
    # dealt by term: what belongs to a term of a language is then summed in one place
    counts = written(count_terms(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")
    terms = (counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs"), F.count("*").alias("spread"))
             .filter(F.col("docs") >= min_docs).select("lang", "term", "all_n", "spread"))
    # terms of as many sources lie together, in an order that a hash deals out
    cut = (F.lit(63) - F.floor(F.log2("spread")).cast("int")) * CHUNKS + F.pmod(F.xxhash64("term"), F.lit(CHUNKS)).cast("int")
    terms = written(numbered(terms, ["lang"], [F.col("term")], "t", cut=cut), "columns")
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("all_total"))
    cells = written(counts.join(terms, ["lang", "term"]).select("lang", "source", "term", "n", "all_n", "t"), "cells")
    groups = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = (groups.join(cells.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left")
              .select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "v", "all_total")])
              .withColumn("zero", _share("0", "total", "v"))
              .withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1))
    groups = written(groups, "groups")
    shares = written(cells.join(groups, ["lang", "source"]).select("lang", "source", "term", "g", "t", _share("n", "total", "v").alias("p"), _share("all_n", "all_total", "v").alias("q")), "shares")

    by_value = lambda *g: Window.partitionBy(*g).orderBy(F.desc("value"), "item")
    term = (shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
            .withColumn("rank", F.row_number().over(by_value("lang", "source"))).filter(F.col("rank") <= top))

    square = lambda c: F.floor(F.col(c) / SIDE).cast("long")
    rows = groups.groupBy("lang", square("g").alias("r")).agg(F.sort_array(F.collect_list(F.struct("g", "zero"))).alias("zeros")).withColumn("zeros", F.col("zeros.zero"))
    squares = (shares.groupBy("lang", square("g").alias("r"), square("t").alias("c"))
               .agg(F.collect_list(F.struct((F.col("g") % SIDE * SIDE + F.col("t") % SIDE).cast("int").alias("at"), "p")).alias("cells")))
    # each square meets those of its column in every row of squares, also where there is none
    last = groups.groupBy("lang").agg(F.max(square("g")).alias("last"))
    met = squares.join(last, "lang").withColumn("other", F.explode(F.expr("sequence(0L, last)")))
    side = lambda own, zeros: rows.select("lang", F.col("r").alias(own), F.col("zeros").alias(zeros))
    units = (met.groupBy("lang", "c", F.least("r", "other").alias("r"), F.greatest("r", "other").alias("s"))
             .agg(*[F.coalesce(F.first(F.when(here, F.col("cells")), True), F.array().cast(squares.schema["cells"].dataType)).alias(name)
                    for here, name in ((F.col("r") <= F.col("other"), "cells_r"), (F.col("r") >= F.col("other"), "cells_s"))])
             .join(side("r", "zeros_r"), ["lang", "r"]).join(side("s", "zeros_s"), ["lang", "s"]))
    walked = (_walked(units.select("lang", "r", "s", "zeros_r", "zeros_s", *[F.col(f"cells_{e}.{c}").alias(f"{c}_{e}") for e in "rs" for c in ("at", "p")]))
              .groupBy("lang", "i", "j").agg(F.sum("value").alias("value"), F.sum("columns").alias("columns")))
    other = groups.select("lang", F.col("source").alias("item"), F.col("g").alias("j"), F.col("zero").alias("other_zero"))
    pair = (groups.select("lang", "source", "v", F.col("g").alias("i"), "zero").join(other, "lang").filter("i != j").join(walked, ["lang", "i", "j"], "left")
            .select("lang", "source", F.lit("pair").alias("part"), "item",
                    # the columns that are zero for both
                    F.expr("coalesce(value, 0) + coalesce((v - coalesce(columns, 0)) * ((zero - other_zero) * (zero - other_zero) div other_zero), 0)").alias("value"))
            .withColumn("rank", F.row_number().over(by_value("lang", "source"))))
    return pair.unionByName(term)


AUDIT_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), w AS (
  SELECT rid, lang, source, unnest(terms) AS term FROM t
), counts AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n FROM w GROUP BY ALL
), kept AS (
  SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY ALL HAVING count(DISTINCT rid) >= 3
), langs AS (
  SELECT lang, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS v FROM kept GROUP BY lang
), groups AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM t) g LEFT JOIN (SELECT counts.* FROM counts JOIN kept USING (lang, term)) c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL
), shares AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.total + l.v) AS p, 1 + 1000000000::HUGEINT * (k.n + 1) // (l.total + l.v) AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL
), every AS (
  SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM every
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""
