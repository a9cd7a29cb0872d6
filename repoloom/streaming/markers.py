"""Completion markers in growing transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Marker formats.
DONE_MARK = r"\[APPLICATION_ANALYSIS_COMPLETE\]\s+(\S+)"
ALL_DONE_MARK = "[ALL_APPLICATION_ANALYSIS_COMPLETE]"


def completions(lines: DataFrame) -> DataFrame:
    """Each completed (repo, name) once, from transcript lines (repo, line).

    Works on batches and streams; a stream keeps one small state row per
    component, so the state is as large as the inventory.
    """
    name = F.regexp_extract("line", DONE_MARK, 1)
    found = lines.select("repo", name.alias("name")).filter("name <> ''")
    return found.dropDuplicates(["repo", "name"])


def announcements(lines: DataFrame) -> DataFrame:
    """Each repo whose transcript says that all of its components are done, once; batches and streams."""
    return lines.filter(F.contains("line", F.lit(ALL_DONE_MARK))).select("repo").dropDuplicates(["repo"])


def unkept(announced: DataFrame, complete: DataFrame) -> DataFrame:
    """(repo, expected, done) of repositories that announced the end before all was done; counts are null without expectations."""
    return announced.join(complete, "repo", "left").filter(~F.coalesce("all_complete", F.lit(False))).select("repo", "expected", "done")


def transcript_stream(spark: SparkSession, path: str) -> DataFrame:
    """Lines below ``path/<repo>/`` as they are appended file by file.

    With very many files it is best made, started and awaited under
    :func:`repoloom.runtime.many_files`.
    """
    rows = spark.readStream.option("recursiveFileLookup", "true").text(path)
    rel = F.substring_index(F.col("_metadata.file_path"), path.rstrip("/") + "/", -1)
    return rows.select(F.substring_index(rel, "/", 1).alias("repo"), F.col("value").alias("line"))


def follow_completions(lines: DataFrame, out: str, checkpoint: str, **trigger) -> object:
    """Start the stream of first completions into Parquet at ``out``."""
    options = trigger or {"availableNow": True}
    return (
        completions(lines).writeStream.outputMode("append").format("parquet")
        .option("path", out).option("checkpointLocation", checkpoint).trigger(**options).start()
    )


def completeness(done: DataFrame, expected: DataFrame) -> DataFrame:
    """(repo, expected, done, all_complete) against the expected (repo, name)."""
    hits = expected.select("repo", "name").distinct().join(done.select("repo", "name").withColumn("_d", F.lit(True)), ["repo", "name"], "left")
    per = hits.groupBy("repo").agg(F.count("*").alias("expected"), F.count_if("_d").alias("done"))
    return per.select("repo", "expected", "done", (F.col("expected") == F.col("done")).alias("all_complete"))
