"""The corpus pipeline: language ID, line dedup, near duplicates, mixing, packing."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantaloom.llm.common import table_path
from vantaloom.llm.jaccard_join import one_of_each
from vantaloom.llm.language_id import fit, identify
from vantaloom.llm.line_dedup import line_dedup
from vantaloom.llm.mixing import mixed_rows
from vantaloom.llm.packing import pack, with_sequence_ids
from vantaloom.llm.tokens import tokenizer_path

#: A document whose language is less sure than this is rejected, like one without letters.
MIN_LANGUAGE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters in a language the model knows (9). Those with null or empty texts go; rows that repeat all stay."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    told = identify(docs.select(F.col("text").cast("string").alias("text"), own.alias("row")), fit(docs))
    return told.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE)).select("row.*")


def line_blocks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines an earlier one has; those that lose all their lines go (10). Rows without lines stay."""
    out = line_dedup(docs).filter((F.col("removed_lines") < F.col("n_lines")) | (F.col("n_lines") == 0))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 over 5-word shingles (8). Rows without words stay."""
    return one_of_each(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, stored in the order of the mix (4): part by part, and in a part row by row."""
    return mixed_rows(docs)


def stored_place(docs: DataFrame) -> tuple[DataFrame, tuple[Column, Column]]:
    """docs, and where each row stands in its stored table: the number of its part file and its row there. Rows that come from no
    file stand in the order of their partitions."""
    try:
        at = docs.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        at = docs.withColumn("_file", F.lit("part-0")).withColumn("_row", F.monotonically_increasing_id())
    part = F.coalesce(F.regexp_extract("_file", r"part-(\d+)", 1).try_cast("long"), F.lit(0))
    return at, (part, F.col("_row"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids (2). Groups are neighbours in the mix, and sequences are numbered in its order. Null and empty
    texts are their end id alone."""
    docs, place = stored_place(docs.select("doc_id", "text"))
    out = with_sequence_ids(pack(docs, tokenizer_path("byte_bpe_50k.json"), place=place))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tokens")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_blocks),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("pack", pack_sequences),
]

#: SQL can't express a tokenizer or a forward algorithm; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = table_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
