"""Transcript files: {"Transcripts": {id: {"Transcript": text, "Domain": name}}}, one object a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "Transcripts map<string, struct<Transcript: string, Domain: string>>"


def entries(json: Column) -> Column:
    """The entries of one file's text as an array of (key, value); empty where the text is no such object."""
    return F.coalesce(F.map_entries(F.from_json(json, SCHEMA)["Transcripts"]), F.array().cast("array<struct<key: string, value: struct<Transcript: string, Domain: string>>>"))


def parsed(files: DataFrame, json: str, *keep: str) -> DataFrame:
    """(*keep, id, text, domain) of every entry."""
    return files.select(*keep, F.explode(entries(F.col(json))).alias("_e")).select(*keep, F.col("_e.key").alias("id"), F.col("_e.value.Transcript").alias("text"), F.col("_e.value.Domain").alias("domain"))


def read_transcripts(spark: SparkSession, root: str, nested: bool = True) -> DataFrame:
    """(folder, id, text, domain) of the *_Transcripts.json at root, or below it. Of entries with one folder and id that of the greatest path stays."""
    files = spark.read.text(root, wholetext=True, pathGlobFilter="*_Transcripts.json", recursiveFileLookup=nested).select("value", F.input_file_name().alias("path"))
    rows = parsed(files, "value", "path").withColumn("folder", F.element_at(F.split("path", "/"), -2))
    return rows.groupBy("folder", "id").agg(F.max_by(F.struct("text", "domain"), "path").alias("_last")).select("folder", "id", "_last.text", "_last.domain")
