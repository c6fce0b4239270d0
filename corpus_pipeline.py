"""Language ID, line dedup, near-duplicate join, source mixing and packing in a row."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import langid, lines, mixing, ngram_join, packing
from palimpsest.llm.common import Workspace, text_of

#: Documents with a lower score than this, or without letters, are in no known language.
LEAST_SCORE = 0.25
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; the rest go."""
    profiles = langid.learn_profiles(docs.where(~langid.held_out()))
    known = langid.predict_languages(docs.select(COLUMNS), profiles)
    return known.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_SCORE)).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of runs of lines; those of which nothing is left go."""
    cut = lines.dedup_lines(docs.select(COLUMNS)).where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id and of these the smallest hash, of each group of near duplicates."""
    groups = ngram_join.ngram_groups(docs)
    kept = groups.where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")).distinct()
    same = docs["doc_id"].eqNullSafe(F.col("kept_id")) & (F.xxhash64(text_of(docs["text"])) == F.col("kept_hash"))
    return docs.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text"]).select(COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (a cut one counts as whole), in training order."""
    mixed = mixing.mix(docs.select(COLUMNS)).where("copies > 0").select("doc_id", "text_hash", "positions").distinct()
    m, d = mixed.alias("m"), docs.alias("d")
    joined = d.join(m, F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.xxhash64("d.text") == F.col("m.text_hash")))
    copies = joined.select("d.*", F.explode("m.positions").alias("_position"))
    return copies.orderBy("_position", "doc_id").select(COLUMNS)


def in_written_order(docs: DataFrame) -> DataFrame:
    """A Parquet table's rows in the order of its numbered files and of the rows in them; other frames as they are.

    Readers deal files to tasks by size, which would lose the training order of the mix.
    """
    number = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("long")
    try:
        placed = docs.select("*", number.alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:  # no file behind it
        return docs
    return placed.repartitionByRange("_file", "_row").sortWithinPartitions("_file", "_row").drop("_file", "_row")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that are left, block by block in training order."""
    import public_tokenizers

    return packing.pack(in_written_order(docs.select(COLUMNS)), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can't express the learned language profiles nor the tokeniser; tests hold line dedup and near duplicates against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again before the next."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
