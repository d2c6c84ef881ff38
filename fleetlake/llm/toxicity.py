"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models over the
presence of words that several labelled rows have; each model also sees the probabilities of the categories before it.
In training those are out-of-fold: the probability of a row comes from models
that have not seen it, nor any row with the same text, so later models learn
from probabilities as good as those they will meet.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlake.llm._common import written

#: Rows of the labelled table that models are fitted on at most.
MAX_LABELLED = 20_000


def words(text: Column) -> Column:
    """The distinct lower-cased runs of letters and digits; none for null."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != ""))


def _telling(data: DataFrame, category: str, most: int) -> list[int]:
    """The words whose presence tells most about the category (likelihood ratio)."""
    sums = {r[category]: (r["s"].toArray(), r["n"]) for r in data.groupBy(category).agg(Summarizer.sum(F.col("present")).alias("s"), F.count("*").alias("n")).collect()}
    if len(sums) < 2:
        return [0]
    (no, n_no), (yes, n_yes) = sums[0.0], sums[1.0]
    part = lambda seen, n: np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / n), 0)
    ratio = part(yes, n_yes) + part(no, n_no) + part(n_yes - yes, n_yes) + part(n_no - no, n_no) - part(yes + no, n_yes + n_no) - part(n_yes + n_no - yes - no, n_yes + n_no)
    return sorted(np.argsort(-ratio, kind="stable")[:most].tolist())


@dataclass
class Link:
    """One model of the chain."""

    category: str
    before: list[str]
    words: list[int]
    model: LogisticRegressionModel

    def features(self, rows: DataFrame) -> DataFrame:
        telling = VectorSlicer(indices=self.words, inputCol="present", outputCol="telling").transform(rows)
        return VectorAssembler(inputCols=["telling", *[f"p_{c}" for c in self.before]], outputCol="features").transform(telling)

    def add(self, rows: DataFrame) -> DataFrame:
        return (self.model.transform(self.features(rows)).withColumn(f"p_{self.category}", vector_to_array("probability")[1])
                .drop("rawPrediction", "probability", "prediction", "features", "telling"))


@dataclass
class Constant:
    """What stands for a model where there is nothing to fit it on."""

    category: str
    share: float

    def add(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(f"p_{self.category}", F.lit(self.share))


@dataclass
class Chain:
    links: list[Link | Constant]
    vocabulary: CountVectorizerModel


def fit_chain(labelled: DataFrame, categories: list[str], vocabulary_size: int = 20_000, least_rows: int = 5, telling_words: int = 500, folds: int = 3, regularization: float = 0.0002, iterations: int = 30, max_rows: int = MAX_LABELLED) -> Chain:
    """Fit on rows (text, one 0/1 column for each category); rows with a null
    label are left out.  Of more than ``max_rows`` rows those with the least
    hash of the text are taken, and of the words that ``least_rows`` of them
    have, the ``vocabulary_size`` most frequent; each model
    sees the ``telling_words`` of these that tell most about its category.

    Without such a word, or without a row to fit on, a model is the share of its
    category among the rows, 0 without any."""
    rows = labelled.dropna(subset=categories).select("text", *[F.col(c).cast("double").alias(c) for c in categories])
    some = rows.withColumn("order", F.xxhash64(F.coalesce("text", F.lit("")))).orderBy("order", "text", *categories).limit(max_rows)
    some = written(some.select(*categories, F.pmod(F.xxhash64("order"), F.lit(folds)).alias("fold"), words(F.col("text")).alias("words")).repartition(6), "labelled")
    vocabulary = CountVectorizer(binary=True, vocabSize=vocabulary_size, minDF=least_rows, inputCol="words", outputCol="present").fit(some)
    train, links = vocabulary.transform(some).drop("words"), []

    def fit(data: DataFrame, i: int) -> Link | Constant:
        if not vocabulary.vocabulary or data.isEmpty():
            return Constant(categories[i], train.agg(F.coalesce(F.avg(categories[i]), F.lit(0.0))).first()[0])
        data = data.cache()
        c, link = categories[i], Link(categories[i], categories[:i], _telling(data, categories[i], telling_words), None)
        link.model = LogisticRegression(featuresCol="features", labelCol=c, maxIter=iterations, regParam=regularization, standardization=False, family="binomial").fit(link.features(data))
        data.unpersist()
        return link

    for i, c in enumerate(categories):
        links.append(fit(train, i))
        if i + 1 < len(categories):
            parts = [fit(train.filter(f"fold != {f}"), i).add(train.filter(f"fold = {f}")) for f in range(folds)]
            train = parts[0]
            for p in parts[1:]:
                train = train.unionByName(p)
            train = written(train, "labelled")
    return Chain(links, vocabulary)


def score(docs: DataFrame, chain: Chain, keep: Column) -> DataFrame:
    """``keep`` (as ``kept_as``) and p_<category> for every row.  Null and empty
    texts have no word and get the models' intercepts; other columns are not
    read, repeated rows are scored alike, and an empty table gives no row."""
    rows = chain.vocabulary.transform(docs.select(keep.alias("kept_as"), words(F.col("text")).alias("words"))).drop("words")
    for link in chain.links:
        rows = link.add(rows)
    return rows.drop("present")


def toxicity_query(docs: DataFrame, labels: DataFrame, threshold: float = 0.25) -> DataFrame:
    """(doc_id, p_low_quality, p_toxic, toxic) for all documents, by a chain of
    low quality and toxicity fitted on the labelled ones.  A doc_id with
    several labels has the worst of them, and one with a null label none.  Any
    number of labelled rows will do, none too (see ``fit_chain``); an empty
    table of documents gives no row."""
    known = labels.groupBy("doc_id").agg(F.max(1 - F.col("quality")).alias("low_quality"), F.max("toxic").alias("toxic")).dropna()
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    # MAX_LABELLED rows of three numbers at most
    labelled = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    chain = fit_chain(labelled, ["low_quality", "toxic"])
    return score(docs, chain, F.col("doc_id")).select(F.col("kept_as").alias("doc_id"), "p_low_quality", "p_toxic", (F.col("p_toxic") >= threshold).alias("toxic"))
