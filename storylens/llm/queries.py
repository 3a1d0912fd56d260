"""Registered queries of the operators and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    chat, conversation_trie, decontam, embedding_dedup, langid, lm_score, packing, secret_scan, simhash,
    token_alignment, token_counts, toxicity, url_rules,
)
from .common import prepare, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(name: str, operator: Callable[..., DataFrame], *tables: str, sql: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return operator(*(table(spark, sf_dir, t) for t in tables))

    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


_register("op1_language_id", langid.op1, "documents")
_register("op2_lm_score", lm_score.op2, "documents")
_register("op3_secret_scan", secret_scan.op3, "documents")
_register("op4_packing", packing.op4, "documents")
_register("op5_token_counts", token_counts.op5, "documents")
_register("op6_embedding_dedup", embedding_dedup.op6, "embeddings")
_register("op7_simhash", simhash.op7, "documents")
_register("op8_chat_format", chat.op8, "conversations", sql=chat.OP8_SQL)
_register("op9_decontamination", decontam.op9, "documents", "benchmark")
_register("op10_toxicity", toxicity.op10, "documents", "labels")
_register("op11_token_alignment", token_alignment.op11, "documents")
_register("op12_url_rules", url_rules.op12, "pages", sql=url_rules.OP12_SQL)
_register("op13_conversation_trie", conversation_trie.op13, "conversations", sql=conversation_trie.OP13_SQL)
