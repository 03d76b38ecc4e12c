"""The corpus pipeline: five stages, each over all documents its predecessor kept."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm import mixing, packing, quality, resemblance, secrets_scan
from auditloom.llm.words import table, text_batches
from auditloom.session import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and every cutoff certified on the labels."""
    cutoffs = quality.safe_cutoffs(quality.measured(docs, "lang"), table(spark, sf_dir, "labels"), risk=0.02, error=0.05)
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.coalesce("lang", F.lit("")).alias("stratum"),
                       quality.measures(F.col("text")).alias("m"))
    return quality.judged(rows, cutoffs).where("kept").select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group linked by five-word Jaccard similarity of 0.8 or more, the one with the smallest doc_id.

    Candidates come from SimHash tiles and min-hash forests, links from whole sets.
    """
    return resemblance.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked in their texts; n_chars follows the text. Words like those of the texts stay."""
    text_batches(spark)
    triples = secrets_scan.learnt_triples(docs)
    masked = docs.withColumn("text", secrets_scan.masked_text(F.col("text"), triples=triples))
    length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), length))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out in the order of the mix: files and their splits follow the target weights."""
    return mixing.in_mixed_order(docs)


def written_order(docs: DataFrame) -> DataFrame:
    """The rows of a written table, dealt and sorted by file and place in it; rows that come from no file as they are.

    Spark lays splits of files out by size, so reading alone does not keep the order in which they were written.
    """
    part = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).try_cast("long")
    try:
        placed = docs.select("*", F.struct(part.alias("part"), "_metadata.file_path", "_metadata.row_index").alias("__at"))
    except AnalysisException:
        return docs
    return placed.repartitionByRange("__at").sortWithinPartitions("__at").drop("__at")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens, packed in the order of the mix."""
    import public_tokenizers

    pieces = packing.pack(written_order(docs), public_tokenizers.path("word_bpe_49k.json"),
                          keep=lambda p: p.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality_rules), ("near_duplicates", near_duplicates), ("secrets", secrets),
          ("mixing", mixture), ("packing", packed)]

#: Fingerprints, masks and token ids have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs, _ = written(docs)
    return docs
