"""The thin queries over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from tidemark.llm import bpe, chat, language, lines, neardup, packing, substrings, urls, vectors


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES = {
    "op1_minhash_near_dedup": lambda spark, d: neardup.op1(_read(spark, d, "documents")),
    "op2_exact_top_k": lambda spark, d: vectors.op2(_read(spark, d, "embeddings")),
    "op3_nearest_neighbours": lambda spark, d: vectors.op3(_read(spark, d, "embeddings")),
    "op4_line_dedup": lambda spark, d: lines.op4(_read(spark, d, "documents")),
    "op5_best_fit_packing": lambda spark, d: packing.op5(_read(spark, d, "documents")),
    "op6_language_id": lambda spark, d: language.op6(_read(spark, d, "documents")),
    "op7_url_filters": lambda spark, d: urls.op7(_read(spark, d, "pages"), _read(spark, d, "labels")),
    "op8_bpe": lambda spark, d: bpe.op8(_read(spark, d, "documents")),
    "op9_substring_dedup": lambda spark, d: substrings.op9(_read(spark, d, "documents")),
    "op10_chat_formatting": lambda spark, d: chat.op10(_read(spark, d, "conversations")),
}
ORACLE = {"op2_exact_top_k": vectors.OP2_SQL, "op4_line_dedup": lines.OP4_SQL, "op7_url_filters": urls.OP7_SQL}
