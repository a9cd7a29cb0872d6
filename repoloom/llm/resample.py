"""Importance resampling towards a target distribution, on hashed n-grams.

Each n-gram of 1 to ``longest`` words falls into one of ``buckets`` by CRC-32.
One job counts the buckets over all texts of the corpus and of the target,
partition by partition; the two histograms, ``buckets`` numbers each whatever
the input, give each bucket a gain: how much likelier the target makes it. A
second job adds up the gains of every document's n-grams. Both read batches of
texts joined with a sentinel that is in no word: one pass of one pattern finds
all words and sentinels of the batch, a search in the texts' offsets says whose
each word is, and n-grams that would run from one text into the next are masked
before the bins are counted. Keyed Gumbel noise on the weights turns the
greatest scores into a sample without replacement. The rank comes from range
slices and their sizes, so no task sorts the whole table.

Gains and weights are whole thousandths, so sums do not depend on their order.

Defined cases: null texts have no words, weight 0 and no rank (with ``least_words``
of 0 they can be drawn). A null id counts as no digits in the noise. Of equal
scores the smaller id ranks first, null ids before others; equal ids go by
weight and n-grams. Repeated rows count, and can be drawn, each. A target
without words leaves the corpus' own smoothed frequencies; an empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoloom.functions.running import running_totals
from repoloom.runtime import stage

BUCKETS, SEED = 10_000, 2024
#: Words of UTF-8 bytes once A-Z are lower case, and the sentinel between texts.
WORD_OR_END = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+|\x00")
_END = b"\x00"
_KNOWN_AT_MOST, _BATCH_CHARS = 500_000, 1 << 22


class _Hashes(dict):
    """CRC-32 of words, computed once per word; -1 for the sentinel."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _KNOWN_AT_MOST:
            self.clear()
        code = self[word] = -1 if word == _END else zlib.crc32(word)
        return code


_HASHES = _Hashes()


def batch_features(texts: list[str | None], longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text number of every n-gram of the batch, and words by text."""
    raw = ((t or "").encode().replace(_END, b" ") for t in texts)
    found = WORD_OR_END.findall(_END.join(raw).lower())  # bytes: lower() is for A-Z alone
    codes = np.fromiter(map(_HASHES.__getitem__, found), dtype=np.int64, count=len(found))
    at = np.flatnonzero(codes >= 0)
    owner = np.searchsorted(np.flatnonzero(codes < 0), at)
    grams, owners = [codes[at]], [owner]
    for n in range(2, longest + 1):
        # the n-gram's last word lies in the text of its first
        inside = np.flatnonzero(owner[n - 1 :] == owner[: max(len(owner) - n + 1, 0)])
        first = at[inside].tolist()
        grams.append(np.fromiter((zlib.crc32(b" ".join(found[i : i + n])) for i in first), dtype=np.int64, count=len(first)))
        owners.append(owner[inside])
    return np.concatenate(grams) % buckets, np.concatenate(owners), np.bincount(owner, minlength=len(texts))


def _batches(texts: list[str | None], most: int = _BATCH_CHARS) -> Iterator[list[str | None]]:
    """Runs of texts of about ``most`` characters; a longer text stands alone."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t or "") > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t or "")
    if run:
        yield run


def _counter(longest: int, buckets: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros(buckets, dtype=np.int64)
        for frame in frames:
            for texts in _batches(frame["text"].tolist()):
                totals += np.bincount(batch_features(texts, longest, buckets)[0], minlength=buckets)
        at = np.flatnonzero(totals)
        yield pd.DataFrame({"bucket": at, "n": totals[at]})

    return count


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """N-grams of all texts by bucket."""
    found = (
        texts.select(F.col(text_col).alias("text")).mapInPandas(_counter(longest, buckets), "bucket long, n long")
        .groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    counts = np.zeros(buckets, dtype=np.int64)
    for r in found:
        counts[r["bucket"]] = r["n"]
    return counts


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of the ratio of the smoothed frequencies, rounded down."""
    s, t, m = corpus.astype(np.float64), target.astype(np.float64), len(corpus)
    ratio = (t + 1) * float(int(corpus.sum()) + m) / ((s + 1) * float(int(target.sum()) + m))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], dtype=np.int64)


def _weigher(shared, longest: int, buckets: int) -> Callable:
    @F.pandas_udf("n_features long, weight long, n_words long")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        gains = shared.value
        for batch in batches:
            parts = [np.zeros((0, 3), dtype=np.int64)]
            for texts in _batches(batch.tolist()):
                bucket, owner, n_words = batch_features(texts, longest, buckets)
                order = np.argsort(owner, kind="stable")
                total = np.concatenate([[0], np.cumsum(gains[bucket[order]])])
                n = np.bincount(owner, minlength=len(texts))
                ends = np.cumsum(n)
                parts.append(np.stack([n, total[ends] - total[ends - n], n_words], axis=1))
            yield pd.DataFrame(np.concatenate(parts), columns=["n_features", "weight", "n_words"])

    return weigh


def document_weights(
    docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = 1,
) -> DataFrame:
    """``id, n_features, weight, n_words`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)
    weighed = _weigher(shared, longest, len(gains))(F.col(text_col))
    return docs.select(F.col(id_col).cast("long").alias("id"), weighed.alias("w")).select("id", "w.*")


def gumbel_thousandths(own: Column, seed: int = SEED) -> Column:
    """Gumbel noise keyed by an id, in thousandths, rounded down."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(own.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
    longest: int = 1, buckets: int = BUCKETS, percent: int = 10, least_words: int = 20, seed: int = SEED,
) -> DataFrame:
    """``id, n_features, weight, score, rank`` of every row; ``rank`` is null where it is not drawn.

    Of the rows with at least ``least_words`` words, ``percent`` in a hundred are drawn.
    """
    gains = bucket_gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_text_col, longest, buckets))
    rows = document_weights(docs, gains, id_col, text_col, longest).select(
        "id", "n_features", "weight", (F.col("weight") + gumbel_thousandths(F.col("id"), seed)).alias("score"),
        (F.col("n_words") < least_words).alias("barred"))
    rows, seen = stage(rows, "weights", eligible=F.count_if(~F.col("barred")))
    # those that can be drawn first, by falling score
    order = ["barred", "falling", "id", "weight", "n_features"]
    placed = running_totals(rows.withColumn("falling", -F.col("score")), [], order, {"above": F.lit(1)})
    drawn = ~F.col("barred") & (F.col("above") < percent * seen["eligible"] // 100)
    return placed.select("id", "n_features", "weight", "score", F.when(drawn, F.col("above") + 1).cast("long").alias("rank"))
