"""Quality by nearest-neighbour voting in a latent space.

Fitting takes a bounded sample of labelled rows (``max_labelled``, chosen by a
hash of the id), counts hashed words and token shapes, and finds the leading
singular vectors of the weighted counts: a latent space of ``rank``
dimensions. The sample's unit vectors with their labels are the model, at most
``max_labelled * rank`` numbers, and are broadcast. Scoring maps every whole
text into the space, takes the exact cosine to every labelled vector in
blocks, and lets the nearest ``neighbours`` vote, weighted by similarity.

Only the text enters a score. Defined cases: null and empty texts carry one
feature of their own and get a score like any text. Several labels of one id
count with their mean; null labels don't count. Without labelled rows every
score is 0.5. Repeated rows get equal scores. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS, SHAPES = 4096, 512
#: Features: hashed words, hashed shapes, repeated neighbour, few distinct words, empty.
WIDTH = WORDS + SHAPES + 3
_KNOWN_AT_MOST = 300_000


def _shape(token: str) -> str:
    """Letter case of the token and the signs it begins and ends with."""
    core = token.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    at = token.find(core) if core else 0
    case = "-" if not core else "9" if core.isdigit() else "A" if core.isupper() and len(core) > 1 else "a" if core.islower() else "T" if core.istitle() else "m"
    return token[: min(at, 4)] + case + (token[at + len(core) :][:4] if core else token[:4])


class _Codes(dict):
    """Token → word bucket * SHAPES + shape bucket, computed once per token."""

    def __missing__(self, token: str) -> int:
        if len(self) > _KNOWN_AT_MOST:
            self.clear()
        code = zlib.crc32(token.lower().encode("utf-8", "replace")) % WORDS * SHAPES + zlib.crc32(_shape(token).encode("utf-8", "replace")) % SHAPES
        self[token] = code
        return code


_CODES = _Codes()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the whole text's features; words and shapes have unit length each."""
    tokens = (text or "").split()
    if not tokens:
        return np.array([WIDTH - 1]), np.array([1.0], dtype=np.float32)
    codes = np.fromiter(map(_CODES.__getitem__, tokens), dtype=np.int64, count=len(tokens))
    parts = []
    for first, own, size in ((0, codes // SHAPES, WORDS), (WORDS, codes % SHAPES, SHAPES)):
        counts = np.bincount(own, minlength=size)
        at = np.flatnonzero(counts)
        values = np.log1p(counts[at]).astype(np.float32) if not first else np.sqrt(counts[at] / len(tokens)).astype(np.float32)
        parts.append((at + first, values / np.linalg.norm(values)))
    same = float(np.mean(codes[1:] == codes[:-1])) if len(codes) > 1 else 0.0
    few = 1.0 - len(np.unique(codes)) / len(codes)
    parts.append((np.array([WIDTH - 3, WIDTH - 2]), np.array([same, few], dtype=np.float32)))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


@dataclass
class Model:
    basis: np.ndarray  # WIDTH x rank, weights of the features included
    vectors: np.ndarray  # labelled rows x rank, unit length
    labels: np.ndarray
    neighbours: int


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]], rank: int, neighbours: int) -> Model:
    """Latent space of the labelled rows by a randomised singular value decomposition."""
    counts = np.zeros((len(rows), WIDTH), dtype=np.float32)
    for i, (at, values, _) in enumerate(rows):
        counts[i, at] = values
    rarity = np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
    rarity[WORDS:] = 2.0  # shapes matter by share, not by rarity
    rarity[WORDS + SHAPES :] = 4.0
    counts *= rarity
    draw = np.random.default_rng(7).standard_normal((WIDTH, rank + 8)).astype(np.float32)
    range_of = counts @ draw
    for _ in range(3):
        range_of = counts @ (counts.T @ np.linalg.qr(range_of)[0])
    basis = np.linalg.svd(np.linalg.qr(range_of)[0].T @ counts, full_matrices=False)[2][:rank].T
    vectors = _unit(counts @ basis)
    return Model((basis * rarity[:, None]).astype(np.float32), vectors, np.array([r[2] for r in rows], dtype=np.float32), neighbours)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def score_block(model: Model, texts: list[str | None]) -> np.ndarray:
    latent = np.stack([values @ model.basis[at] for at, values in map(features, texts)])
    near = _unit(latent) @ model.vectors.T
    k = min(model.neighbours, near.shape[1])
    top = np.argpartition(near, -k, axis=1)[:, -k:]
    weight = np.maximum(np.take_along_axis(near, top, axis=1), 0.0) ** 4 + 1e-6
    return np.clip((weight * model.labels[top]).sum(axis=1) / weight.sum(axis=1), 0.0, 1.0)


def _feature_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [features(t) for t in batch["text"]]
        yield pd.DataFrame({"id": batch["id"], "label": batch["label"], "at": [f[0].tolist() for f in found], "value": [f[1].tolist() for f in found]})


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    max_labelled: int = 4000, rank: int = 48, neighbours: int = 15,
) -> Model | None:
    """Fit on at most ``max_labelled`` rows of ``labels``; None if no labelled row has a document."""
    sample = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("id")).agg(F.avg(label_col).alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    )
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    found = rows.mapInPandas(_feature_rows, "id long, label double, at array<long>, value array<float>").dropDuplicates(["id"]).sort("id").collect()
    if not found:
        return None
    return fit([(np.array(r["at"]), np.array(r["value"], dtype=np.float32), r["label"]) for r in found], rank, neighbours)


def score(docs: DataFrame, model: Model | None, text_col: str = "text", block: int = 256) -> Column:
    """Column of scores between 0 and 1 for the texts of ``docs``."""
    if model is None:
        return F.lit(0.5).cast("double")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return _scorer(shared, block)(F.col(text_col))


def _scorer(shared, block: int) -> Callable:
    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = [score_block(shared.value, list(texts[i : i + block])) for i in range(0, len(texts), block)]
            yield pd.Series(np.concatenate(parts) if parts else [], dtype="float64")

    return scores


def held_out(id_col: Column) -> Column:
    """Rows kept from the fit: a third, by checksum of the id; rows without an id too."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(True))
