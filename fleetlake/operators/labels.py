"""Label operators over a canonical work-order DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L


LABEL_TEXT = "_lc"
LABEL_TEXT_WITH_COMPLAINT = "_lcc"


def with_label_text(df: DataFrame, include_complaint: bool = False) -> tuple[DataFrame, str]:
    """Add the lower-cased search text as its own column (once).

    The text is the *raw* description (``_desc_raw`` when the description
    has been cleaned): keyword tests treat the space of a multi-word keyword
    as any run of white space, which is exactly a test on the collapsed
    text, so the collapse regex is not needed here.  That keeps the text
    cheap even where the optimizer inlines it into a pushed-down filter once
    per keyword.  By default the description alone (the complaint never
    reaches the matcher in the original flow, SURVEY C1);
    ``include_complaint=True`` appends it.  Projected as a column, many
    keyword tests share one lower-casing per row.
    """
    name = LABEL_TEXT_WITH_COMPLAINT if include_complaint else LABEL_TEXT
    if name in df.columns:
        return df, name
    desc = F.col("_desc_raw") if "_desc_raw" in df.columns else F.col("description")
    text = F.lower(F.coalesce(desc, F.lit("")))
    if include_complaint:
        text = F.concat(text, F.lit(" "), F.lower(F.coalesce(F.col("nature_of_complaint"), F.lit(""))))
    return df.withColumn(name, text), name


def _raw_desc(df: DataFrame):
    return F.col("_desc_raw") if "_desc_raw" in df.columns else F.col("description")


def extract_severity(df: DataFrame, include_complaint: bool = False, with_scores: bool = False) -> DataFrame:
    """Weighted keyword severity; a raw '' description gets no severity."""
    df, lc = with_label_text(df, include_complaint)
    scores = L.severity_scores(F.col(lc))
    sev = L.severity_from_scores(F.col("severity_high"), F.col("severity_medium"), F.col("severity_low"))
    out = (df.withColumns({"severity_high": scores["high"], "severity_medium": scores["medium"],
                           "severity_low": scores["low"]})
             .withColumn("severity", F.when(F.coalesce(_raw_desc(df), F.lit("x")) != "", sev)))
    return out if with_scores else out.drop("severity_high", "severity_medium", "severity_low")


def extract_components(df: DataFrame, include_complaint: bool = False) -> DataFrame:
    """Multi-label component string; NULL when none or raw '' description."""
    df, lc = with_label_text(df, include_complaint)
    # the joined names are projected once, then tested and used
    out = df.withColumn("_comp", L.components_joined(F.col(lc)))
    keep = (F.coalesce(_raw_desc(df), F.lit("x")) != "") & (F.col("_comp") != "")
    return out.withColumn("component", F.when(keep, F.col("_comp"))).drop("_comp")


def classify_fault_category(df: DataFrame) -> DataFrame:
    """First-match rule cascade."""
    df, lc = with_label_text(df)
    return df.withColumn("fault_category", L.rule_category(F.col(lc), F.col("category")))


def keyword_fault_category(df: DataFrame, complaint: str = "nature_of_complaint",
                           description: str = "description", out: str = "fault_category_kw") -> DataFrame:
    """Last-match keyword categories over complaint + description."""
    text = F.concat(F.coalesce(F.lower(F.col(complaint)), F.lit("")), F.lit(" "),
                    F.coalesce(F.lower(F.col(description)), F.lit("")))
    return df.withColumn("_kt", text).withColumn(out, L.keyword_category_of(F.col("_kt"))).drop("_kt")
