"""Exact deduplication by a tree-merge of sorted digest runs.

Every input partition becomes one run of (digest, length, smallest id, copies)
with one record per distinct text, so a group of copies of any size leaves its
partition as one record. Runs then meet in binomial rounds: a round exchanges
16 neighbouring runs into one place, split by one more hex digit of the
digest, sorts what arrives there and merges equal neighbours. After any number
of rounds there are as many pieces as before, no piece holds a whole table,
and a digest meets itself at most 16 times in a round. A record only merges
with one of equal SHA-256 and equal length; nothing else counts as verified.

Texts are not shuffled to find out which rows go: a broadcast bitmap of hashed
ids lets those through in the scan, and a few more; only these meet the list
of dropped copies, by id and digest.

Defined cases: null text is the empty text. Rows without an id are counted;
they stay only if no copy has an id. A repeated row (same id and text) counts
as a copy; ``exact_groups`` marks both rows as kept, ``exact_dedup`` leaves
one. An empty table gives an empty result. Other columns, whatever their
names, pass through ``exact_dedup`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoloom.functions.marks import marked
from repoloom.runtime import stage

#: One hex digit of the digest, and so 16 runs, per round.
DIGIT_BITS = 4
#: Groups above this share of all rows are joined by broadcast, so fewer than this many.
HOT_GROUPS = 1000


def normalise(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: Column) -> Column:
    return F.sha2(normalise(text), 256)


def digest_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One record per row: ``id, digest, length, run``; the run is the partition the row lies in."""
    text = normalise(F.col(text_col))
    return docs.select(
        F.col(id_col).alias("id"), F.sha2(text, 256).alias("digest"), F.length(text).alias("length"), F.spark_partition_id().alias("run"))


def _merged(records: DataFrame, *place: str) -> DataFrame:
    """Equal neighbours of the sorted runs of ``place`` become one record, that with an id and of these the smallest.

    The least of a struct keeps the aggregation sorted: Spark sorts each place by
    digest and length, once, and merges while it reads.
    """
    least = F.min(F.struct(F.col("keep_id").isNull().alias("none"), "keep_id"))
    return records.groupBy(*place, "digest", "length").agg(least.alias("least"), F.sum("copies").alias("copies")).select(
        *place, "digest", "length", F.col("least.keep_id").alias("keep_id"), "copies")


def merge_runs(runs: DataFrame, partitions: int = 256) -> DataFrame:
    """``digest, length, keep_id, copies``: one record per distinct text, after as many rounds as ``partitions`` runs need.

    The last round takes all runs that are left, so a wrong number costs balance, not results.
    """
    merged = _merged(runs.select("run", "digest", "length", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("copies")), "run")
    rounds = max(1, -(-max(partitions - 1, 1).bit_length() // DIGIT_BITS))
    for done in range(1, rounds + 1):
        met = merged.withColumn("run", F.shiftright("run", DIGIT_BITS)).withColumn("piece", F.substring("digest", 1, done))
        place = ["run", "piece"] if done < rounds else ["piece"]
        merged = _merged(met.repartition(*place), *place)
    return merged.drop("piece")


def _runs_and_groups(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int]:
    runs, seen = stage(digest_runs(docs, id_col, text_col), "digest-runs", n=F.count(F.lit(1)), top=F.max("run"))
    groups, _ = stage(merge_runs(runs, (seen["top"] or 0) + 1), "digest-groups")
    return runs, groups, seen["n"]


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``."""
    runs, groups, n = _runs_and_groups(docs, id_col, text_col)
    keys = ["digest", "length"]
    large = F.col("copies") * HOT_GROUPS > n
    hot = F.broadcast(groups.filter(large))
    joined = runs.join(hot, keys).unionByName(runs.join(hot.select(*keys), keys, "left_anti").join(groups.filter(~large), keys))
    return joined.select(
        F.col("id").alias(id_col), "keep_id", F.col("copies").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    marks, several = stage(
        exact_groups(docs, id_col, text_col).filter("group_size > 1").select(F.col(id_col).alias("id"), F.col("text_sha256").alias("digest"), "kept"),
        "copies", n=F.count(F.lit(1)))
    if not several["n"]:
        return docs
    # copies are told apart by id, so no group meets in one place with its texts
    gone, dropped = stage(marks.filter("not kept").select("id", "digest").distinct(), "dropped-copies", n=F.count(F.lit(1)))
    again, twice = stage(marks.filter("kept").groupBy("id", "digest").count().filter("count > 1").drop("count"), "repeated-rows", n=F.count(F.lit(1)))
    # only rows that may be in one of these lists meet them with their texts
    met = marked(docs[id_col], gone.select("id").unionByName(again.select("id")), dropped["n"] + twice["n"])
    rows = docs.join(*met, "left_semi").select(F.struct("*").alias("row"), F.col(id_col).alias("id"), digest(F.col(text_col)).alias("digest"))

    def same(other: DataFrame) -> Column:
        return (rows["digest"] == other["digest"]) & rows["id"].eqNullSafe(other["id"])

    left = rows.join(gone, same(gone), "left_anti")
    if twice["n"]:
        once = left.join(again, same(again), "left_semi").groupBy("id", "digest").agg(F.any_value("row").alias("row"))
        left = left.join(again, same(again), "left_anti").select("row").unionByName(once.select("row"))
    return docs.join(*met, "left_anti").union(left.select("row.*"))
