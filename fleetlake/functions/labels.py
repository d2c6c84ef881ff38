"""Text-derived labels as column expressions.

Everything here is a narrow projection: no shuffle, no UDF.  Each label is
computed from a lower-cased text column that the caller projects once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keywords import (
    CATEGORY_DEFAULT,
    CATEGORY_RULES,
    COMPONENT_KEYWORDS,
    FAULT_CATEGORY_DEFAULT,
    FAULT_CATEGORY_KEYWORDS,
    SEVERITY_DEFAULT,
    SEVERITY_KEYWORDS,
    SEVERITY_WEIGHTS,
)
from .text import contains_any, count_present


def components_joined(lc: Column) -> Column:
    """Sorted distinct component names joined with ', ' ('' when none).

    One OR-chain of ``contains`` per component; ``concat_ws`` skips the NULLs
    of non-matching components, so the names come out sorted and distinct.
    """
    parts = [F.when(contains_any(lc, COMPONENT_KEYWORDS[name], ws_runs=True), F.lit(name))
             for name in sorted(COMPONENT_KEYWORDS)]
    return F.concat_ws(", ", *parts)


def components(lc: Column) -> Column:
    """``components_joined`` with NULL for none (the expression is used
    twice: project it as a column first when it feeds a large plan)."""
    joined = components_joined(lc)
    return F.when(joined != "", joined)


def component_array(lc: Column) -> Column:
    """Same labels as an ARRAY<STRING> (empty array when none)."""
    parts = [F.when(contains_any(lc, COMPONENT_KEYWORDS[name], ws_runs=True), F.lit(name))
             for name in sorted(COMPONENT_KEYWORDS)]
    return F.array_compact(F.array(*parts))


def severity_scores(lc: Column) -> dict[str, Column]:
    """Weighted score per level: distinct keyword hits x weight."""
    return {level: (count_present(lc, kws, ws_runs=True) * F.lit(SEVERITY_WEIGHTS[level])).cast("int")
            for level, kws in SEVERITY_KEYWORDS.items()}


def severity_from_scores(h: Column, m: Column, lo: Column) -> Column:
    """Highest score wins; ties go high > medium > low; all zero -> medium."""
    return (F.when((h == 0) & (m == 0) & (lo == 0), F.lit(SEVERITY_DEFAULT))
            .when((h >= m) & (h >= lo), F.lit("high"))
            .when(m >= lo, F.lit("medium"))
            .otherwise(F.lit("low")))


def rule_category(lc: Column, cat: Column) -> Column:
    """First-match cascade over description keywords and the Cat code."""
    text = F.coalesce(lc, F.lit(""))
    code = F.coalesce(cat, F.lit(""))
    expr = None
    for name, words, codes in CATEGORY_RULES:
        cond = contains_any(text, words, ws_runs=True)
        for c in codes:
            cond = cond | (code == F.lit(c))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(CATEGORY_DEFAULT))


def keyword_category(complaint: Column, description: Column) -> Column:
    """Keyword categories over complaint + ' ' + description, last match wins
    (P18).  Written as a CASE in reverse order so the first true branch is the
    last category that would have overwritten the others."""
    text = F.concat(F.coalesce(F.lower(complaint), F.lit("")), F.lit(" "),
                    F.coalesce(F.lower(description), F.lit("")))
    return keyword_category_of(text)


def keyword_category_of(text: Column) -> Column:
    """P18 over an already lower-cased complaint + ' ' + description text."""
    expr = None
    for name, words in reversed(list(FAULT_CATEGORY_KEYWORDS.items())):
        cond = contains_any(text, words)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(FAULT_CATEGORY_DEFAULT))
