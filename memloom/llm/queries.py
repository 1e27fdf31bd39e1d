"""The corpus operators as queries over whole tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm import chat, decontam, langid, mixing, near_dedup, oracles, pii, piece_bpe, quality, secret_scan, substring_dedup, token_alignment, token_counts, whitening
from memloom.llm._common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance", "foreign")
    return quality.quality(table(spark, sf_dir, "documents")).select(*cols)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    return chat.read_back(chat.format_conversations(turns.unionByName(more)))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(table(spark, sf_dir, "documents")))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.token_prefixes(table(spark, sf_dir, "documents"), budgets=(2048,))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"), "n_words", F.col("words_within")[0].alias("words_within_limit"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", langid.is_held_out().alias("held_out"), "lang_pred", "score")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(table(spark, sf_dir, "documents")))


def op8_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.pareto_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"), components=4)
    at = F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "x")
    return found.select("vec_id", "n", "deviation", "identity_error", at).select("vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", F.col("x.whitened").alias("whitened"), F.col("x.explained").alias("explained"), "identity_error")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_alignment.link_scores(token_alignment.align(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = piece_bpe.encode_pieces(table(spark, sf_dir, "documents"), outputs=("packed", "decoded"))
    n = (F.octet_length("packed") / 4).cast("long")
    return found.select("doc_id", n.alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_substring_dedup, op3_chat_formatting, op4_secret_scan, op5_token_counts, op6_language_id, op7_personal_data, op8_pareto_mix, op9_decontaminate, op10_near_duplicates, op11_embedding_whitening, op12_token_alignment, op13_piece_encoding)}


def oracle_sql() -> dict[str, str]:
    """op1 holds documents against trained references, op4 to op7 add what SQL cannot say, op11 has eigenvectors of either sign, op12 and op13 tokenizers: those are tested by brute force."""
    return {
        "op2_substring_dedup": oracles.OP2,
        "op3_chat_formatting": oracles.OP3,
        "op8_pareto_mix": oracles.OP8,
        "op9_decontaminate": oracles.OP9,
        "op10_near_duplicates": oracles.OP10,
    }
