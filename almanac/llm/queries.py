"""The queries and SQL of this subpackage, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from almanac.llm import ann, bpe, compression, crossentropy, decontamination, html, middle, neardup, packing, secrets, substrings, toxicity, trie


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_compression_quality": compression.op1_compression_quality,
        "op2_balanced_posting_lists": ann.op2_balanced_posting_lists,
        "op3_flat_block_text": html.op3_flat_block_text,
        "op4_fingerprint_index": substrings.op4_fingerprint_index,
        "op5_cross_entropy_difference": crossentropy.op5_cross_entropy_difference,
        "op6_vector_best_fit": packing.op6_vector_best_fit,
        "op7_setsketch_near_duplicates": neardup.op7_setsketch_near_duplicates,
        "op8_multipart_secrets": secrets.op8_multipart_secrets,
        "op9_boosted_toxicity": toxicity.op9_boosted_toxicity,
        "op10_containment_search": decontamination.op10_containment_search,
        "op11_chunk_reuse_bpe": bpe.op11_chunk_reuse_bpe,
        "op12_conversation_trie": trie.op12_conversation_trie,
        "op13_fill_in_middle": middle.op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op12_conversation_trie": trie.OP12_SQL, "op13_fill_in_middle": middle.OP13_SQL}
