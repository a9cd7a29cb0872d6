"""Stupid-backoff scores from n-gram counts of the whole corpus.

Counts and scores are relational, on blocks instead of single rows. A batch of
documents is stored once as word numbers. Each batch sends its distinct
n-grams (hashes, sorted, as differences) with their counts to the count table
that owns the hash range; each table adds up what it gets and answers with
the corpus counts in the order asked; the answers join the batch again, where
every token's score is looked up and summed per document.

A token's score is count(n-gram) / count(context) where the n-gram occurs
elsewhere, else ``BACKOFF`` times the score with one word less context; the
document's own counts are taken off (leave one out), so that a text does not
vouch for itself. Unigrams are count / tokens with one added to each.

Words are split at ASCII white space, A-Z lowered. N-grams are compared by
48-bit hashes. Defined cases: null, empty and blank texts have no words and a
score of 0. Repeated rows vouch for each other. Null ids pass through. An
empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoloom.runtime import stage

ORDER, BACKOFF = 3, 0.4
HASH_BITS = 48
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
BATCH_SCHEMA = "batch string, ids array<long>, lengths array<int>, words binary, vocabulary binary, tokens long"
BLOCK_SCHEMA = "bucket int, n int, batch string, keys binary, counts binary"
REPLY_SCHEMA = "batch string, n int, bucket int, counts binary"


def _zip(values: np.ndarray, width: int = 8) -> bytes:
    """Unsigned numbers, their lowest ``width`` bytes one plane after the other, compressed."""
    planes = np.ascontiguousarray(values.astype("<u8")).view("u1").reshape(-1, 8).T[:width]
    return zstandard.compress(planes.tobytes(), 3)


def _unzip(data: bytes, width: int = 8) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), dtype="u1").reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), dtype="u1")
    out[:, :width] = planes.T
    return out.view("<u8")[:, 0]


def _batches(most: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Documents → rows of ``BATCH_SCHEMA`` of about ``most`` tokens."""

    def row(ids: list, hashes: list[np.ndarray]) -> pd.DataFrame:
        vocabulary, words, counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")  # frequent words get small numbers
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        lengths = [len(h) for h in hashes]
        words, vocabulary = _zip(rank[words], 4), _zip(vocabulary[order], HASH_BITS // 8)
        return pd.DataFrame({"batch": [uuid.uuid4().hex], "ids": [ids], "lengths": [lengths], "words": [words], "vocabulary": [vocabulary], "tokens": [sum(lengths)]})

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, hashes, size = [], [], 0
        for batch in batches:
            for own, text in zip(batch["id"], batch["text"], strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").lower().split()
                ids.append(None if pd.isna(own) else int(own))
                hashes.append(np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words)) >> np.uint64(64 - HASH_BITS))
                size += len(words)
                if size >= most:
                    yield row(ids, hashes)
                    ids, hashes, size = [], [], 0
        if ids:
            yield row(ids, hashes)

    return split


def _grams(words: np.ndarray, lengths: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per order: (positions of the last words, hashes) of the n-grams inside documents."""
    shift = np.uint64(64 - HASH_BITS)
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    inside = np.arange(len(words)) - starts
    out, grams = [], words
    for n in range(1, ORDER + 1):
        if n > 1:  # the n-gram that ends at a word: the shorter one that ends before it, and the word
            longer = words.copy()
            longer[1:] = (grams[:-1] * _ODD[0]) ^ words[1:]
            grams = (longer ^ (longer >> np.uint64(31))) * _ODD[1]
        at = np.flatnonzero(inside >= n - 1)
        mixed = grams[at] * _ODD[0]
        out.append((at, (mixed ^ (mixed >> np.uint64(32))) >> shift))
    return out


def _decoded(row) -> tuple[np.ndarray, np.ndarray]:
    vocabulary = _unzip(row.vocabulary, HASH_BITS // 8)
    return vocabulary[_unzip(row.words, 4).astype(np.int64)], np.array(row.lengths, dtype=np.int64)


def _asking(bits: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Batches → blocks of their distinct n-grams, by hash range and order."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(HASH_BITS - bits)
        for batch in batches:
            for row in batch.itertuples(index=False):
                words, lengths = _decoded(row)
                for n, (_, hashes) in enumerate(_grams(words, lengths), 1):
                    keys, counts = np.unique(hashes, return_counts=True)
                    cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                    rows = [
                        (b, n, row.batch, _zip(np.diff(keys[a:z], prepend=np.uint64(0))), _zip(counts[a:z]))
                        for b, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)) if z > a
                    ]
                    yield pd.DataFrame(rows, columns=["bucket", "n", "batch", "keys", "counts"])

    return ask


def _count(blocks: pd.DataFrame) -> pd.DataFrame:
    """One count table (a hash range of one order): add up the blocks, answer each with what the others have of its n-grams."""
    keys = [np.cumsum(_unzip(k), dtype=np.uint64) for k in blocks["keys"]]
    own = np.concatenate([_unzip(c) for c in blocks["counts"]])
    table, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(where, weights=own, minlength=len(table)).astype("<u8")
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    return pd.DataFrame({
        "batch": blocks["batch"], "n": blocks["n"], "bucket": blocks["bucket"], "counts": [_zip(rest) for rest in np.split(total[where] - own, cuts)]})


def token_scores(words: np.ndarray, lengths: np.ndarray, others: list[np.ndarray], tokens: int) -> np.ndarray:
    """Natural logarithm of every token's score; ``others``: per order the counts that other
    batches have of this one's distinct n-grams."""
    document = np.repeat(np.arange(len(lengths)), lengths)
    elsewhere = []  # per order, per token: corpus count without the own document's
    for (at, hashes), rest in zip(_grams(words, lengths), others, strict=True):
        keys, where, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        counts = counts + rest
        pair = document[at].astype(np.int64) * (len(keys) + 1) + where
        _, own_at, own = np.unique(pair, return_inverse=True, return_counts=True)
        left = np.zeros(len(words))
        left[at] = counts[where] - own[own_at]
        elsewhere.append(left)
    rest = tokens - np.repeat(lengths, lengths)
    score = np.log((elsewhere[0] + 1.0) / (rest + 1.0))
    for n in range(2, len(elsewhere) + 1):
        # the context ends one word before; its count is that of the shorter n-gram there
        context = np.concatenate([[0.0], elsewhere[n - 2][:-1]])
        inside = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths) >= n - 1
        found = inside & (elsewhere[n - 1] > 0)
        backed = np.where(inside, score + np.log(BACKOFF), score)
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where(found, np.log(elsewhere[n - 1] / np.maximum(context, 1.0)), backed)
    return score


def _scoring(tokens: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows come sorted by batch: the batch, then its answers by order and hash range."""

    def result(row, answers: list[list[np.ndarray]]) -> pd.DataFrame:
        words, lengths = _decoded(row)
        others = [np.concatenate(a) if a else np.empty(0) for a in answers]
        scores = token_scores(words, lengths, others, tokens) if len(words) else np.empty(0)
        sums = np.bincount(np.repeat(np.arange(len(lengths)), lengths), weights=scores, minlength=len(lengths))
        return pd.DataFrame({"id": pd.array(list(row.ids), dtype="Int64"), "n_words": lengths, "score": sums})

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, answers = None, []
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.n == 0:
                    if current is not None:
                        yield result(current, answers)
                    current, answers = row, [[] for _ in range(ORDER)]
                else:
                    answers[int(row.n) - 1].append(_unzip(row.counts).astype(float))
        if current is not None:
            yield result(current, answers)

    return score


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_tokens: int = 1_500_000, table_tokens: int = 4_000_000) -> DataFrame:
    """Per row: its id, ``n_words`` and ``score``, the sum of the tokens' log scores."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    held, found = stage(texts.mapInPandas(_batches(batch_tokens), BATCH_SCHEMA), "lm-batches", tokens=F.sum("tokens"))
    tokens = found["tokens"] or 0
    bits = max(3, int(np.ceil(np.log2(max(1, ORDER * tokens / table_tokens)))))
    blocks = held.filter("tokens > 0").mapInPandas(_asking(bits), BLOCK_SCHEMA)
    answers = blocks.repartition(ORDER << bits, "bucket", "n").groupBy("bucket", "n").applyInPandas(_count, REPLY_SCHEMA)
    none = lambda kind: F.lit(None).cast(kind)
    rows = held.select(
        "batch", F.lit(0).alias("n"), F.lit(0).alias("bucket"), none("binary").alias("counts"), "ids", "lengths", "words", "vocabulary",
    ).unionByName(answers.select(
        "batch", "n", "bucket", "counts", none("array<long>").alias("ids"), none("array<int>").alias("lengths"), none("binary").alias("words"), none("binary").alias("vocabulary")))
    rows = rows.repartition("batch").sortWithinPartitions("batch", "n", "bucket")
    return rows.mapInPandas(_scoring(tokens), "id long, n_words long, score double").withColumnRenamed("id", id_col)
