"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltwork.llm.ann import op10_nearest
from siltwork.llm.bpe import op4_bpe
from siltwork.llm.chat_format import OP3_SQL, op3_chat
from siltwork.llm.embed_dedup import op9_embed_dedup
from siltwork.llm.fill_middle import OP12_SQL, op12_fill_middle
from siltwork.llm.html_extract import op5_html
from siltwork.llm.impact_index import OP13_SQL, op13_lexical_search
from siltwork.llm.metric_tree import OP11_SQL, op11_exact_top_k
from siltwork.llm.ngram_join import op1_ngram_join
from siltwork.llm.packing import op7_packing
from siltwork.llm.quality import op6_quality
from siltwork.llm.suffix_dedup import op8_suffix_dedup
from siltwork.llm.substring_dedup import op2_substring_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_chat": op3_chat,
    "op4_bpe": op4_bpe,
    "op5_html": op5_html,
    "op6_quality": op6_quality,
    "op7_packing": op7_packing,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_embed_dedup": op9_embed_dedup,
    "op10_nearest": op10_nearest,
    "op11_exact_top_k": op11_exact_top_k,
    "op12_fill_middle": op12_fill_middle,
    "op13_lexical_search": op13_lexical_search,
}

ORACLES: dict[str, str] = {
    "op3_chat": OP3_SQL,
    "op11_exact_top_k": OP11_SQL,
    "op12_fill_middle": OP12_SQL,
    "op13_lexical_search": OP13_SQL,
}
