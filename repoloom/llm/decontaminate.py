"""Benchmark decontamination as a prefix-filtered set join.

Every item gives windows of ``size`` consecutive words (a shorter item one
window of all its words). A document contains a window only if it contains all
its words, so one word is a sufficient prefix: the rarest by count over all
documents. Documents' words join the windows' prefix words; the position of
the word and the length of the document bound where the window can lie; the
words standing there are then compared one by one. All of it is DataFrame
functions.

The vocabulary and the windows come from the benchmark. Up to
``broadcast_bytes``, measured while they are written, they are broadcast, and
the comparison takes place in the scan of the documents: no text is shuffled,
only hits are. Beyond, the words of the documents are shuffled to the windows
and the texts of documents with a possible place to those places.

Defined cases: null has no words. Items without words are no windows. Repeated
items count once, repeated documents each. Null item ids give windows that hit
but are no items. Documents with null ids are matched like any; rows of one id
and different texts each by their own text. Empty tables give zero hits or no
rows. Columns of the documents may have any names; ``n_words, n_hit, items``
are replaced.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoloom.runtime import stage

#: What separates words once A-Z are lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text: runs of a-z, digits and anything beyond ASCII, A-Z lowered."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, BETWEEN), "")


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = 10) -> DataFrame:
    """``window`` (its words), ``items``: distinct windows with the ids, as strings, of the items that have them."""
    rows = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return (
        rows.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("window"))
        .groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))
    )


def _free(name: str, taken: list[str]) -> str:
    """A column name like ``name`` that is not taken."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def _text_size(words: Column) -> Column:
    """Bytes that an array of words takes in memory, about."""
    return F.coalesce(F.sum(F.octet_length(F.array_join(words, " ")) + 24 * F.size(words) + 64), F.lit(0))


def _prefixes(docs: DataFrame, items: DataFrame, text_col: str, item_col: str, item_text_col: str, size: int, most: int) -> tuple[DataFrame, DataFrame, bool]:
    """Windows by number with their items; their rarest word, where it stands in them; whether those are small."""
    found, _ = stage(windows(items, item_col, item_text_col, size).withColumn("w", F.monotonically_increasing_id()), "windows")
    vocabulary, v = stage(found.select(F.explode("window").alias("word")).distinct(), "window-words", bytes=_text_size(F.array("word")))
    spread = docs.select(F.explode(words(F.col(text_col))).alias("word"))
    counts = spread.join(F.broadcast(vocabulary) if v["bytes"] <= most else vocabulary, "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts, _ = stage(counts, "word-counts")
    prefix = (
        found.select("w", F.posexplode("window").alias("at", "word")).join(counts, "word")
        .groupBy("w").agg(F.min(F.struct("n", "word", "at")).alias("p"), F.count(F.lit(1)).alias("met"))
        .join(found, "w").filter(F.col("met") == F.size("window"))  # a word in no document: no document has the window
        .select(F.col("p.word").alias("word"), F.col("p.at").alias("at"), F.size("window").alias("len"), "window", "w")
    )
    prefix, p = stage(prefix, "window-prefixes", bytes=_text_size(F.col("window")))
    return found.select("w", "items"), prefix, p["bytes"] <= most


def _hits(docs: DataFrame, prefix: DataFrame, small: bool) -> DataFrame:
    """``id, h, start, len, w``: the windows that lie in the documents (id, h, words)."""
    inside = (F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n"))
    start = F.col("pos") - F.col("at")
    if small:
        # the words of a document stay in its row; only rows of hits are written
        spots = docs.select("id", "h", "words", F.size("words").alias("n"), F.posexplode("words").alias("pos", "word"))
        spots = spots.join(F.broadcast(prefix), "word").withColumn("start", start)
        same = F.slice("words", F.col("start") + 1, F.col("len")) == F.col("window")
        return spots.filter(inside & same).select("id", "h", "start", "len", "w")
    places = (
        docs.select("id", "h", F.size("words").alias("n"), F.posexplode("words").alias("pos", "word"))
        .join(prefix, "word").withColumn("start", start).filter(inside)
        .groupBy(F.col("id").alias("p_id"), F.col("h").alias("p_h")).agg(F.collect_set(F.struct("start", "len", "window", "w")).alias("places")))
    met = docs.join(places, F.col("id").eqNullSafe(F.col("p_id")) & (F.col("h") == F.col("p_h")))
    real = F.filter("places", lambda p: F.slice(F.col("words"), p["start"] + 1, p["len"]) == p["window"])
    return met.select("id", "h", F.explode(real).alias("p")).select("id", "h", "p.start", "p.len", "p.w")


def _text_hash(text: Column) -> Column:
    return F.xxhash64(text, F.length(text))


def hit_rows(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", size: int = 10, broadcast_bytes: int = 64 << 20,
) -> DataFrame:
    """``id, h, n_hit, items`` of documents with a hit; ``h`` is a hash of the text. Staged."""
    named, prefix, small = _prefixes(docs, items, text_col, item_col, item_text_col, size, broadcast_bytes)
    text = F.col(text_col)
    found, _ = stage(_hits(docs.select(F.col(id_col).alias("id"), _text_hash(text).alias("h"), words(text).alias("words")), prefix, small).distinct(), "hits")
    places = F.transform(F.collect_set(F.struct("start", "len")), lambda p: F.sequence(p["start"], p["start"] + p["len"] - 1))
    covered = found.groupBy("id", "h").agg(F.size(F.array_distinct(F.flatten(places))).cast("long").alias("n_hit"))
    by_item = (
        found.select("id", "h", "w").distinct().join(named, "w")
        .groupBy(F.col("id").alias("i_id"), F.col("h").alias("i_h")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")))
    both = covered.join(by_item, F.col("id").eqNullSafe(F.col("i_id")) & (F.col("h") == F.col("i_h")))
    return stage(both.select("id", "h", "n_hit", "items"), "hit-documents")[0]


def word_hits(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", size: int = 10, broadcast_bytes: int = 64 << 20,
) -> DataFrame:
    """``docs`` with ``n_words, n_hit, items``: words, words inside a window's occurrence, ids of the items found.

    Columns of ``docs`` with these names are replaced.
    """
    h, n, hit = (_free(x, docs.columns) for x in ("h", "n", "hit"))
    found = hit_rows(docs, items, id_col, text_col, item_col, item_text_col, size, broadcast_bytes).select(F.struct("*").alias(hit))
    rows = docs.withColumns({h: _text_hash(F.col(text_col)), n: F.size(words(F.col(text_col))).cast("long")})
    marked = rows.join(found, F.col(id_col).eqNullSafe(F.col(f"{hit}.id")) & (F.col(h) == F.col(f"{hit}.h")), "left")
    return marked.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in ("n_words", "n_hit", "items")], F.col(n).alias("n_words"),
        F.coalesce(F.col(f"{hit}.n_hit"), F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.col(f"{hit}.items"), F.array().cast("array<string>")).alias("items"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 10) -> DataFrame:
    """The rows of ``docs`` that contain no window of any item, with their columns."""
    hit = _free("hit", docs.columns)
    found = hit_rows(docs, items, id_col, text_col, size=size).select(F.struct("id", "h").alias(hit))
    same = F.col(id_col).eqNullSafe(F.col(f"{hit}.id")) & (_text_hash(F.col(text_col)) == F.col(f"{hit}.h"))
    return docs.join(found, same, "left_anti")
