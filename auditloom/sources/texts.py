"""Drafts and evidence texts."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom import fixed
from auditloom.functions.routes import file_extension
from auditloom.sources.custody import contents, list_held
from auditloom.sources.paths import below, project_of, rel_path_of


def scan_texts(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(project_id, rel_path, text): whole files; undecodable bytes become replacement marks."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    path = below(root, F.col("_metadata.file_path"))
    return files.select(project_of(path).alias("project_id"), rel_path_of(path).alias("rel_path"),
                        F.make_valid_utf8("value").alias("text"))


def scan_drafts(spark: SparkSession, root: str) -> DataFrame:
    """(project_id, name, text): Markdown files directly in a project whose name has no leading _.

    Spark's reader leaves out names with a leading dot, and projects with a leading dot or _; these
    few are listed and read apart.
    """
    own = ~F.col("rel_path").contains("/") & ~F.col("rel_path").startswith("_")
    hidden = F.col("rel_path").startswith(".") | F.col("project_id").rlike("^[._]")
    rest = contents(list_held(spark, root).filter(own & hidden & F.col("rel_path").endswith(".md")), root)
    texts = scan_texts(spark, root, "*.md").filter(own & ~hidden).unionByName(
        rest.select("project_id", "rel_path", F.make_valid_utf8(F.col("content").cast("string")).alias("text")))
    return texts.select("project_id", F.col("rel_path").alias("name"), "text")


@F.pandas_udf(T.StringType())
def _fields_spaced(texts: pd.Series, delimiters: pd.Series) -> pd.Series:
    """Fields of delimited text set apart by spaces, records by line breaks; else unchanged."""
    def respaced(text, delimiter):
        lines = []
        try:
            for fields in csv.reader(io.StringIO(text), delimiter=delimiter):
                lines.append(" ".join(fields))
        except csv.Error:
            return text
        return "\n".join(lines)

    return pd.Series([respaced(t, d) for t, d in zip(texts, delimiters)])


def normalised(rows: DataFrame, name: Column) -> DataFrame:
    """Split delimited sources by their own format so that field commas never group digits.

    Only the rows of delimited files pass through Python, in Arrow batches; the others stay in the
    JVM.
    """
    extension = file_extension(name)
    delimiter = F.lit(None).cast("string")
    for ending, mark in fixed.DELIMITED_SOURCES.items():
        delimiter = F.when(extension == ending, mark).otherwise(delimiter)
    marked = rows.withColumn("_delimiter", delimiter)
    prose = marked.filter("_delimiter IS NULL").drop("_delimiter")
    fielded = marked.filter("_delimiter IS NOT NULL").withColumn(
        "text", _fields_spaced("text", "_delimiter")).drop("_delimiter")
    return prose.unionByName(fielded)


def parse_source_spec(links: DataFrame) -> DataFrame:
    """Split ``spec`` (path:TIER) into source path and tier; the tier is 3 unless it is a number."""
    head = F.regexp_extract("spec", r"(?s)^(.+):[^:]*$", 1)
    tail = F.regexp_extract("spec", r"(?s)^.+:([^:]*)$", 1)
    tier = F.when(tail.rlike(r"^[0-9]+\z"), tail.try_cast("int"))
    return links.withColumns({
        "source_path": F.when(head != "", head).otherwise(F.col("spec")),
        "tier": F.coalesce(tier, F.lit(fixed.DEFAULT_TIER))})


def evidence(links: DataFrame, texts: DataFrame) -> DataFrame:
    """(draft_id, source_ord, tier, text) from links (draft_id, project_id, source_ord, spec)."""
    named = parse_source_spec(links)
    found = named.join(texts.withColumnRenamed("rel_path", "source_path"),
                       ["project_id", "source_path"])
    return normalised(found, F.col("source_path")).select("draft_id", "source_ord", "tier", "text")
