"""A corpus pipeline of five stages over ``documents``.

Each stage works on all rows that the stage before kept, written as Parquet and read
again. A stage that drops documents returns the columns of ``documents``. Near duplicates
and contamination are decided per row: every row is a document of its own there,
whether its doc_id is null, shared or neither.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import table
from skyledger.llm.decontam import decontaminate
from skyledger.llm.line_dedup import line_dedup, mark_ids
from skyledger.llm.near_dup import near_duplicates
from skyledger.llm.pieces import encode_texts
from skyledger.llm.quality import fit_quality, quality_rules
from skyledger.session import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed rules and the isolation forest keep."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality_rules(docs.select(*COLUMNS), model).where("kept").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a smaller document holds; a null text stays null."""
    kept = line_dedup(docs.select(*COLUMNS))
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    return kept.select("doc_id", text.alias("text"), "lang", "source", F.char_length(text).cast("bigint").alias("n_chars"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, and the rows without a group.

    Rows are grouped by their texts only. The row with the smallest doc_id stays, null last;
    of several with that doc_id the one with the smallest text digest. Rows with a null or shared
    doc_id are linked like others; different texts under one doc_id are different documents.
    Texts without words are linked with nothing, but equal ones under one doc_id are one document.
    """
    rows = _with_row(docs)
    found = near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"))
    found = found.select(F.col("doc_id").alias("found_row"), "component_id", (F.col("n_shingles") == 0).alias("bare"))
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.xxhash64("text").alias("digest"), "lang", "source", "n_chars", "row")
    grouped = rows.select("row", order.alias("first")).join(found, F.col("row") == F.col("found_row"))
    named_bare = F.col("bare") & ~F.col("first.unnamed")
    group = F.struct(
        F.when(~named_bare, F.col("component_id")).alias("component"),
        *[F.when(named_bare, F.col(f"first.{c}")).alias(c) for c in ("doc_id", "digest")],
    )
    stay = grouped.groupBy(group.alias("group")).agg(F.min("first").alias("first")).select(F.col("first.row").alias("stay"))
    return _without(rows, rows.select(F.col("row").alias("gone")).join(stay, F.col("gone") == F.col("stay"), "left_anti"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text holds no window of a benchmark item, whatever other rows share their doc_id."""
    rows = _with_row(docs)
    found = decontaminate(rows.select(F.col("row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return _without(rows, found.where("contaminated").select(F.col("doc_id").alias("gone")))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of each document, with the check that they decode to its text."""
    return encode_texts(docs)


def _with_row(docs: DataFrame) -> DataFrame:
    """The columns of ``documents`` and ``row``, a number of its own for each row; written, so it stays the same."""
    return materialize(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of :func:`_with_row` whose number is not in ``gone`` (gone); only texts of rows that may be gone are shuffled."""
    gone = materialize(gone, "gone")
    marked = mark_ids(rows, "row", gone, "may_go")
    left = marked.where("may_go").join(gone, F.col("row") == F.col("gone"), "left_anti")
    return marked.where(~F.col("may_go")).select(*COLUMNS).unionAll(left.select(*COLUMNS))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", encoding_stage),
]

# SQL can express neither the forest, the signatures nor the pieces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents below ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
