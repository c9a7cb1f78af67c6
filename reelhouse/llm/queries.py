"""The corpus operators' queries, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, conversations, decontaminate, embedding, exact, licenses, lines, phrases, pii, quality, secrets, simhash, substring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_round_trip": bpe.op1_bpe_round_trip,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_secrets": secrets.op3_secrets,
    "op4_personal_data": pii.op4_personal_data,
    "op5_quality": quality.op5_quality,
    "op6_licenses": licenses.op6_licenses,
    "op7_line_dedup": lines.op7_line_dedup,
    "op8_simhash": simhash.op8_simhash,
    "op9_embedding": embedding.op9_embedding,
    "op10_substring": substring.op10_substring,
    "op11_conversation_repair": conversations.op11_conversation_repair,
    "op12_collocations": phrases.op12_collocations,
    "op13_exact_dedup": exact.op13_exact_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": decontaminate.OP2_SQL,
    "op3_secrets": secrets.OP3_SQL,
    "op6_licenses": licenses.OP6_SQL,
    "op9_embedding": embedding.OP9_SQL,
    "op10_substring": substring.OP10_SQL,
    "op11_conversation_repair": conversations.OP11_SQL,
    "op12_collocations": phrases.OP12_SQL,
    "op13_exact_dedup": exact.OP13_SQL,
}
