"""Registered queries of this package, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame

from fleetlake.llm import byte_bpe, chat, divergence, hamming, html, infill, minhash, mixing, packing, quality, repeats, sharding, toxicity
from fleetlake.llm._common import table


def tokenizer_path() -> str:
    """The vocabulary file: FLEETLAKE_TOKENIZER, or the public one."""
    if "FLEETLAKE_TOKENIZER" in os.environ:
        return os.environ["FLEETLAKE_TOKENIZER"]
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_bpe(docs: DataFrame) -> DataFrame:
    """Ranks from FLEETLAKE_RANKS, or the public file; the pattern is the public one."""
    import public_tokenizers

    return byte_bpe.codec_query(docs, os.environ.get("FLEETLAKE_RANKS") or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {
    "op1_pfair_mix": lambda spark, d: mixing.mix_query(table(spark, d, "documents")),
    "op2_lpt_shards": lambda spark, d: sharding.shard_query(table(spark, d, "documents")),
    "op3_divergence_quality": lambda spark, d: quality.quality_query(table(spark, d, "documents")),
    "op4_toxicity_chain": lambda spark, d: toxicity.toxicity_query(table(spark, d, "documents"), table(spark, d, "labels")),
    "op5_incremental_mih": lambda spark, d: hamming.search_query(table(spark, d, "embeddings")),
    "op6_maximal_repeats": lambda spark, d: repeats.repeats_query(table(spark, d, "documents")),
    "op7_chat_format": lambda spark, d: chat.chat_query(table(spark, d, "conversations")),
    "op8_tensored_minhash": lambda spark, d: minhash.near_query(table(spark, d, "documents")),
    "op9_host_path_text": lambda spark, d: html.main_text(table(spark, d, "pages")),
    "op10_concat_and_cut": lambda spark, d: packing.piece_digest(packing.pack(table(spark, d, "documents"), tokenizer_path())),
    "op11_byte_bpe": lambda spark, d: _byte_bpe(table(spark, d, "documents")),
    "op12_source_divergence": lambda spark, d: divergence.audit(table(spark, d, "documents")),
    "op13_fill_in_middle": lambda spark, d: infill.infill_query(table(spark, d, "documents")),
}

ORACLE = {"op1_pfair_mix": mixing.MIX_SQL, "op3_divergence_quality": quality.QUALITY_SQL, "op5_incremental_mih": hamming.SEARCH_SQL, "op7_chat_format": chat.CHAT_SQL,
          "op12_source_divergence": divergence.AUDIT_SQL, "op13_fill_in_middle": infill.INFILL_SQL}
