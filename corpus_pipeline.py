"""The corpus pipeline: five stages, each of which reads what the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which `run` writes as Parquet to
the shared work folder and reads again as the next stage's documents.  All stages but the last
return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalfold.llm.components import stored
from signalfold.llm.decontaminate import clean_documents
from signalfold.llm.langid import UNKNOWN, identify, learn
from signalfold.llm.line_templates import drop_recurring_lines
from signalfold.llm.packing import pack_documents
from signalfold.llm.queries import table, tokenizer_path
from signalfold.llm.tsearch import near_duplicates
from signalfold.llm.words import free_name
from signalfold.llm.worker import small_batches

# A document goes if no language holds its text: no letters, or spans of several languages.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters or without one leading language; null texts have none."""
    small_batches(spark)
    model = learn(docs)
    if model is None:  # nothing to learn from, so nothing to judge by
        return docs
    # Columns of the documents that are named like a verdict travel under other names.
    named = {c: free_name(docs, f"{c}_of_document") for c in ("lang_pred", "score", "lang_spans") if c in docs.columns}
    found = identify(docs.withColumnsRenamed(named), model)
    kept = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*[F.col(f"`{named.get(c, c)}`").alias(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines of recurring templates out of the texts; no document goes, and n_chars follows a changed text."""
    small_batches(spark)
    cut = drop_recurring_lines(docs, same_form=False)
    if "n_chars" in docs.columns:
        changed = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))
        cut = cut.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return cut.select(docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays.

    A row without an id counts as one with an id above all others, so near copies of any document
    go.  Of rows that repeat the id of a document that stays, all stay.  Null and empty texts have no copies.
    """
    small_batches(spark)
    # Both reads of a table of files number its rows alike, also when a lost task is run again.
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.monotonically_increasing_id())
    key, gone = free_name(docs, "row_id"), free_name(docs, "gone")
    rows = docs.withColumn(key, id_)
    copies = near_duplicates(rows, id_col=key).where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct()
    return rows.join(copies, F.col(key) == F.col(gone), "left_anti").drop(key)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text holds a passage of the benchmark go, with or without an id; null texts stay."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens, one row per piece; a null text is an empty one."""
    small_batches(spark)
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("decontaminate", decontaminate),
    ("best_fit_packing", best_fit_packing),
]

# The first stage is a fitted model and the last one packs tokens; neither can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return stored(STAGES[-1][1](spark, docs, sf_dir), "pipeline")
