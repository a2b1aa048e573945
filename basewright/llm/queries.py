"""The training-data queries, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from basewright.llm import prefix_trie, repeats, reversed_search, revisit, risk_rules, url_filter
from basewright.llm.brown import op2_brown_score
from basewright.llm.containment import op10_benchmark_items
from basewright.llm.extract import op4_main_text
from basewright.llm.kneser_ney import op5_quality
from basewright.llm.lsh_forest import op9_near_duplicates
from basewright.llm.mixing import op7_mixing
from basewright.llm.tokens import op1_token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_files,
        op2_brown_score,
        revisit.op3_revisits,
        op4_main_text,
        op5_quality,
        risk_rules.op6_quality_rules,
        risk_rules.quality_rules_loose,
        op7_mixing,
        url_filter.op8_url_filter,
        op9_near_duplicates,
        op10_benchmark_items,
        reversed_search.op11_reversed_search,
        repeats.op12_repeated_passages,
        prefix_trie.op13_conversation_trie,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op3_revisits": revisit.ORACLE_SQL,
    "op6_quality_rules": risk_rules.ORACLE_SQL,
    "quality_rules_loose": risk_rules.LOOSE_SQL,
    "op8_url_filter": url_filter.ORACLE_SQL,
    "op11_reversed_search": reversed_search.ORACLE_SQL,
    "op12_repeated_passages": repeats.ORACLE_SQL,
    "op13_conversation_trie": prefix_trie.ORACLE_SQL,
}
