"""From documents to packed sequences: quality rules, near-duplicates, repeated
passages, mixing of sources, packing.

A stage drops the tables that the stage before it made on the way: what that
stage kept is written by then.

Every stage works on all that the stage before it kept, and is written as
Parquet and read again before the next.  Mixing fixes the order in which
documents lie in its files, and packing concatenates them in that order.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from fleetlake.llm import minhash, mixing, packing, quality, repeats
from fleetlake.llm._common import drop, made, table, written
from fleetlake.llm.queries import tokenizer_path


#: Tables made on the way by the stage before.
_on_the_way: list[str] = []


def _stage(first: bool = False):
    def around(f):
        @wraps(f)
        def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            if not first:  # the first one may follow a run whose result is still to be read
                drop(spark, _on_the_way)
            _on_the_way.clear()
            before = set(made)
            out = f(spark, docs, sf_dir)
            _on_the_way.extend(p for p in made if p not in before)
            return out

        return stage

    return around


@_stage(first=True)
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


@_stage()
def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.one_of_each(docs)


@_stage()
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur elsewhere too."""
    return repeats.without_repeats(docs)


@_stage()
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix."""
    return mixing.mixed(docs)


@_stage()
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    return packing.piece_digest(packing.pack(docs, tokenizer_path()))


STAGES = [
    ("quality rules", keep_good),
    ("near-duplicates", keep_one_of_each),
    ("repeated passages", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: MinHash, suffix order and tokenization are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
