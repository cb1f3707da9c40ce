"""The queries of the text operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from bazaarlens.llm import chat, decontaminate, exact_dedup, jaccard_join, line_dedup, pii, prefix_trie, ranked_search, secrets, sentencepiece, substring_dedup, token_file, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_file": token_file.op1_token_file,
        "op2_pii": pii.op2_pii,
        "op3_sentencepiece": sentencepiece.op3_sentencepiece,
        "op4_near_passages": substring_dedup.op4_near_passages,
        "op5_secret_scan": secrets.op5_secret_scan,
        "op6_jaccard_join": jaccard_join.op6_jaccard_join,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_decontaminate": decontaminate.op10_decontaminate,
        "op11_chat_format": chat.op11_chat_format,
        "op12_prefix_trie": prefix_trie.op12_prefix_trie,
        "op13_ranked_search": ranked_search.op13_ranked_search,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_dedup": exact_dedup.ORACLE, "op11_chat_format": chat.ORACLE, "op12_prefix_trie": prefix_trie.ORACLE, "op13_ranked_search": ranked_search.ORACLE}
