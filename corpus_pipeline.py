"""From raw documents to a training mix: language, near duplicates, benchmark leaks, personal data, source weights.

Each stage reads what the stage before kept, as a table of its own; nothing else passes between them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm import decontam, langid, mixing, near_dedup, pii
from memloom.llm._common import Stash, table

#: Documents whose language is less certain than this go.
LEAST_SCORE = 0.5
#: Percent of their union that the 5-word runs of near duplicates share at least; op10's contract asks for 85 instead.
ALIKE = 80


def _private(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs under private names, with the own name of each: no column of a document meets one of an operator."""
    names = {f"_doc{k}": c for k, c in enumerate(docs.columns)}
    return docs.toDF(*names), names


def _name(names: dict[str, str], column: str) -> str:
    return next(k for k, c in names.items() if c == column)


def _own(found: DataFrame, names: dict[str, str]) -> DataFrame:
    return found.select(*[F.col(k).alias(c) for k, c in names.items()])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows and is sure of; null and empty texts and texts without letters go, as do all documents where none has a language to learn from. Repeated rows stay repeated."""
    held, names = _private(docs)
    at = {f"{c}_col": _name(names, x) for c, x in (("id", "doc_id"), ("text", "text"), ("lang", "lang"))}
    found = langid.identify(held, **at, carry=tuple(names))
    return _own(found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)), names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near duplicates; rows without an id stay, as do all rows of an id that stays. Texts without words are near nothing, and stay."""
    gone = near_dedup.near_duplicates(docs.select("doc_id", "text"), percent=ALIKE).where(~F.col("kept")).select("doc_id").distinct()
    held, names = _private(docs)
    return _own(held.join(gone, held[_name(names, "doc_id")] == gone["doc_id"], "left_anti"), names)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; null and empty texts have none, and stay."""
    held, names = _private(docs)
    found = decontam.decontaminate(held, table(spark, sf_dir, "benchmark"), id_col=_name(names, "doc_id"), text_col=_name(names, "text"), carry=tuple(names))
    return _own(found.where("n_hit = 0"), names)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each found span replaced by its kind; n_chars follows the new text. A null text stays null."""
    held, names = _private(docs)
    text, n_chars = _name(names, "text"), _name(names, "n_chars")
    found = pii.find(held, id_col=_name(names, "doc_id"), text_col=text, carry=tuple(names))
    found = found.withColumn(text, F.when(F.col(text).isNotNull(), pii.masked(F.col(text), F.col("spans"))))
    return _own(found.withColumn(n_chars, F.when(F.size("spans") > 0, F.length(text).cast("long")).otherwise(F.col(n_chars))), names)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, a row for each copy, numbered from 0 in the column `copy` (in place of any of that name). Texts without words have no size and are not taken; rows of one id are rows of their own."""
    held, names = _private(docs.drop("copy"))
    found = mixing.pareto_mix(held, id_col=_name(names, "doc_id"), source_col=_name(names, "source"), text_col=_name(names, "text"), carry=tuple(names)).where("copies > 0")
    copies = found.select(*names, F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    return copies.select(*[F.col(k).alias(c) for k, c in names.items()], "copy")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("decontamination", decontaminate),
    ("personal_data", personal_data),
    ("mixing", mix),
]

#: The first stage is a trained model, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of a folder, each to all that the one before kept.

    Nulls may stand in any column, texts may be empty or of any length, rows and ids may repeat, tables may be empty
    (the result is then), and further columns, of whatever names, pass through; each stage says what it makes of them.
    """
    stash = Stash(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        kept = stash.keep(stage(spark, docs, sf_dir))
        stash.drop(docs)  # the table that the stage read, once its own is written
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
