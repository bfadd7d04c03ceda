"""A training corpus from ``documents``: toxicity, near-duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes it as
Parquet in the shared folder and reads it again as the next stage's documents, and deletes what
the stage before it and the operators had stored.  All but the last return the columns of
``documents``; others are dropped.

Every decision is of a row, never of an id: the stages number the rows of their input, so
rows with a null or repeated doc_id are judged and copied one by one.  Of near-duplicates the row
with the smallest doc_id stays (null last, then the first row); rows without words link with
nothing.  A contaminated row goes, and no other row of its id.  Null texts are scored, kept and
encoded as empty ones.  Empty tables give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontamination, mixing, near_duplicates, token_files, toxicity
from ledgerloom.llm.shared import discard, stored, stored_so_far

#: Numbers of dropped rows are broadcast up to this many; beyond, the join is shuffled.
BROADCAST_ROWS = 1_000_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ROW = "__row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(docs: DataFrame) -> DataFrame:
    """The documents with a number for each row that is the same in every pass.

    Rows of Parquet files have one: their file's and their own in it.  Others are written with numbers.
    """
    try:
        placed = docs.select(*COLUMNS, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    except AnalysisException:
        return stored(docs.select(*COLUMNS).withColumn(ROW, F.monotonically_increasing_id()), "numbered")
    files = sorted(r[0] for r in placed.select("__file").distinct().collect())  # as many as there are files with rows
    numbers = docs.sparkSession.createDataFrame([(f, k << 40) for k, f in enumerate(files)], "__file string, __first long")
    return placed.join(F.broadcast(numbers), "__file").select(*COLUMNS, (F.col("__first") + F.col("__at")).alias(ROW))


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    rows = stored(rows.select(ROW), "dropped-rows")
    return docs.join(F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows, ROW, "left_anti").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.score_documents(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), keep=COLUMNS)
    return scored.where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = numbered(docs)
    linked = near_duplicates.near_duplicates(docs.select(F.col(ROW).alias("doc_id"), "text"), width=5, percent=80)
    found = linked.select(F.col("doc_id").alias(ROW), "component_id").join(docs.select(ROW, "doc_id"), ROW)
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", ROW)
    first = found.groupBy("component_id").agg(F.min(order)[ROW].alias("first"))
    return without(docs, found.join(first, "component_id").where(F.col(ROW) != F.col("first")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = numbered(docs)
    found = decontamination.contamination(docs.select(F.col(ROW).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return without(docs, found.where("contaminated").select(F.col("doc_id").alias(ROW)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = numbered(docs)
    copies = mixing.mix(docs, keep=(ROW,)).where("copies > 0").select(ROW, "copies")
    return docs.join(copies, ROW).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*COLUMNS)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.token_files(spark, docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token files", write_tokens),
]

#: SQL can't express the toxicity stage; tests/llm holds run() against the stages' brute-force forms.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = stored_so_far()
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        discard(spark, before, keep=[docs])
    return STAGES[-1][1](spark, docs, sf_dir)
