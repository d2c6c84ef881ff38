"""Prompt and report columns, and memoised external classification.

A template is split at its ``{placeholder}`` marks once on the driver and
becomes a ``concat`` of literals and columns, so rendering runs inside the
codegen'd projection.  An unknown template renders as ''.
"""

from __future__ import annotations

import re
from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keywords import FAULT_CATEGORY_DEFAULT, MODEL_CATEGORIES
from ..session import ship_code
from .ranking import rank_within

# ---------------------------------------------------------------------------
# Prompt, query and report templates (text must equal the
# reference's template file).
# ---------------------------------------------------------------------------
ANALYSIS_PROMPTS = {
    "fault_categorization": (
        "Analyze the following fault description and categorize it:\n"
        "Description: {description}\n"
        "Consider these categories:\n"
        "- Engine\n"
        "- Transmission\n"
        "- Electrical\n"
        "- Brakes\n"
        "- Suspension\n"
        "- Body\n"
        "- Maintenance\n"
        "Provide the category and a brief explanation for your choice.\n"
    ),
    "maintenance_recommendation": (
        "Based on the following vehicle fault history:\n"
        "{fault_history}\n"
        "Provide maintenance recommendations and potential preventive measures.\n"
        "Consider:\n"
        "1. Immediate actions needed\n"
        "2. Preventive maintenance steps\n"
        "3. Long-term recommendations\n"
    ),
    "cost_analysis": (
        "For the following repair details:\n"
        "Work Order: {wo_details}\n"
        "Analyze:\n"
        "1. Cost effectiveness of the repair\n"
        "2. Alternative approaches if any\n"
        "3. Preventive measures to reduce future costs\n"
    ),
    "fault_classification": (
        "Classify this vehicle fault into one of these categories:\n"
        "{categories}\n"
        "\n"
        "Nature of Complaint: {complaint}\n"
        "Job Description: {description}\n"
        "\n"
        "Consider:\n"
        "1. The primary system affected\n"
        "2. The type of maintenance (preventive vs corrective)\n"
        "3. The severity and scope of the issue\n"
        "\n"
        "Respond ONLY with the category name, nothing else.\n"
    ),
}
QUERY_TEMPLATES = {
    "vehicle_history": (
        "Analyze the maintenance history for vehicle {vehicle_id}:\n"
        "{history_data}\n"
        "Provide:\n"
        "1. Common issues identified\n"
        "2. Maintenance patterns\n"
        "3. Areas of concern\n"
    ),
    "fault_pattern": (
        "Review the following fault patterns:\n"
        "{fault_data}\n"
        "Identify:\n"
        "1. Recurring issues\n"
        "2. Root causes\n"
        "3. Recommended solutions\n"
    ),
    "repair_validation": (
        "Review this repair approach:\n"
        "{repair_details}\n"
        "Validate:\n"
        "1. Appropriateness of repair method\n"
        "2. Completeness of solution\n"
        "3. Additional recommendations\n"
    ),
}
RESPONSE_FORMATS = {
    "standard_analysis": (
        "Analysis Summary:\n"
        "{summary}\n"
        "\n"
        "Key Findings:\n"
        "{findings}\n"
        "\n"
        "Recommendations:\n"
        "{recommendations}\n"
    ),
    "quick_response": (
        "Category: {category}\n"
        "Issue: {issue}\n"
        "Solution: {solution}\n"
    ),
    "detailed_report": (
        "Technical Analysis Report\n"
        "------------------------\n"
        "Problem Description: {problem}\n"
        "Root Cause Analysis: {analysis}\n"
        "Recommended Actions: {actions}\n"
        "Preventive Measures: {prevention}\n"
        "Additional Notes: {notes}\n"
    ),
}
# --------------------------------------------------------------------------- end of fixed values

CATALOGUES = {"analysis": ANALYSIS_PROMPTS, "query": QUERY_TEMPLATES, "response": RESPONSE_FORMATS}
_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def render(template: str | None, **values) -> Column:
    """Template text -> Column.  ``values`` are Columns or plain strings;
    NULL values render as ''.  A missing placeholder value raises KeyError
    (as ``str.format`` would)."""
    if not template:
        return F.lit("")
    parts: list[Column] = []
    pos = 0
    for m in _PLACEHOLDER.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        v = values[m.group(1)]
        v = v if isinstance(v, Column) else F.lit(v)
        parts.append(F.coalesce(v.cast("string"), F.lit("")))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts) if parts else F.lit("")


def render_named(catalogue: str, name: str, **values) -> Column:
    """Render a named template of a catalogue; unknown name -> ''."""
    return render(CATALOGUES[catalogue].get(name), **values)


def history_prompts(df: DataFrame, block: int = 1000, vehicle_col: str = "vehicle_id",
                    date_col: str = "date", text_col: str = "description") -> DataFrame:
    """A history prompt per vehicle, in pages.

    Entries ``"<date>: <text>"`` ordered by (date, row_ix).  Each vehicle's
    entries are ranked in that order (``ranking.rank_within``: no group is
    sorted by one task) and cut into pages of ``block`` consecutive entries,
    so one page holds at most ``block`` entries however long the history;
    every entry is kept.  Output: ``vehicle_id, page, n_entries, prompt``.
    """
    line = F.concat_ws(": ", F.coalesce(F.col(date_col), F.lit("")), F.coalesce(F.col(text_col), F.lit("")))
    base = df.select(F.col(vehicle_col).alias("vehicle_id"), F.col(date_col).alias("d"),
                     F.col("row_ix").alias("r"), line.alias("t"))
    ranked = rank_within(base, ["vehicle_id"], ["d", "r"], out="_rank")
    entries = ranked.select("vehicle_id", F.floor((F.col("_rank") - 1) / block).cast("long").alias("page"),
                            F.struct("_rank", "t").alias("e"))
    pages = entries.groupBy("vehicle_id", "page").agg(
        F.count(F.lit(1)).alias("n_entries"),
        F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda x: x["t"]), "\n").alias("history"))
    return pages.select("vehicle_id", "page", "n_entries",
                        render(QUERY_TEMPLATES["vehicle_history"], vehicle_id=F.col("vehicle_id"),
                               history_data=F.col("history")).alias("prompt"))


# ---------------------------------------------------------------------------
# T4 memoised classification by an external scorer
# ---------------------------------------------------------------------------
Scorer = Callable[[pd.Series, pd.Series], pd.Series]


def classify_memoised(df: DataFrame, scorer: Scorer, allowed=MODEL_CATEGORIES,
                      complaint: str = "nature_of_complaint", description: str = "description",
                      out: str = "model_category") -> DataFrame:
    """One scorer call per distinct (complaint, description) pair.

    Distinct pairs are formed by a hash aggregate (partial per task, so a hot
    pair is reduced before the shuffle), scored in Arrow batches with
    ``mapInPandas``, checked against ``allowed`` (anything else -> 'Other'), and
    joined back on a hash of the pair and the NULL-safe texts.  When a batch
    fails, its pairs are scored one by one, so only a pair that fails itself
    becomes 'Other', with the reason in ``<out>_error`` (else NULL).
    """
    keys = df.select(F.col(complaint).alias("_c"), F.col(description).alias("_d")).distinct()
    allowed_list = list(allowed)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            errors: list[str | None] = [None] * len(b)
            try:
                answers = list(scorer(b["_c"], b["_d"]))
                if len(answers) != len(b):
                    raise ValueError("the scorer must give one answer a pair")
            except Exception:
                answers = []
                for i in range(len(b)):
                    one = b.iloc[i:i + 1].reset_index(drop=True)
                    try:
                        answers.append(list(scorer(one["_c"], one["_d"]))[0])
                    except Exception as e:
                        answers.append(None)
                        errors[i] = f"{type(e).__name__}: {e}"
            labels = [a if isinstance(a, str) and a in allowed_list else FAULT_CATEGORY_DEFAULT for a in answers]
            yield pd.DataFrame({"_c": b["_c"].to_numpy(), "_d": b["_d"].to_numpy(), out: labels,
                                f"{out}_error": pd.Series(errors, dtype=object)})

    ship_code()
    scored = (keys.mapInPandas(score, schema=f"_c string, _d string, {out} string, {out}_error string")
              .withColumn("_k", F.xxhash64("_c", "_d")))
    cond = ((F.xxhash64(F.col(complaint).cast("string"), F.col(description).cast("string")) == F.col("_k"))
            & F.col(complaint).eqNullSafe(F.col("_c")) & F.col(description).eqNullSafe(F.col("_d")))
    return df.join(scored, cond, "left").drop("_c", "_d", "_k")


def first_word_scorer(complaint: pd.Series, description: pd.Series) -> pd.Series:
    """A deterministic local scorer for tests and the example query: the
    complaint's first word, title-cased (no network, no model)."""
    return complaint.fillna("").str.split(" ").str[0].str.title()
