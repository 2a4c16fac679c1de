"""The training-data queries: name, function, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import conversation_repair, embedding_dedup, prefix_trie, quality_rules, warc_archive
from gridloom.llm.conversation_repair import op12_conversation_repair
from gridloom.llm.embedding_dedup import op9_embedding_dedup
from gridloom.llm.mixing import op3_mixing
from gridloom.llm.ngram_jaccard import op6_ngram_jaccard
from gridloom.llm.packing import op5_best_fit_packing
from gridloom.llm.pii import op4_personal_data
from gridloom.llm.prefix_trie import op13_conversation_trie
from gridloom.llm.quality_classifier import op2_quality_classifier
from gridloom.llm.quality_rules import op7_quality_rules
from gridloom.llm.secret_scan import op1_secret_scan
from gridloom.llm.sharding import op8_stratified_shards
from gridloom.llm.token_counts import op10_token_counts
from gridloom.llm.warc_archive import op11_warc_archive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_mixing": op3_mixing,
    "op4_personal_data": op4_personal_data,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_quality_rules": op7_quality_rules,
    "op8_stratified_shards": op8_stratified_shards,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_warc_archive": op11_warc_archive,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_conversation_trie": op13_conversation_trie,
}
ORACLES: dict[str, str] = {
    "op7_quality_rules": quality_rules.ORACLE,
    "op9_embedding_dedup": embedding_dedup.ORACLE,
    "op11_warc_archive": warc_archive.ORACLE,
    "op12_conversation_repair": conversation_repair.ORACLE,
    "op13_conversation_trie": prefix_trie.ORACLE,
}
