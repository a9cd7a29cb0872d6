"""The pipeline and the queries on the smallest tables."""

from __future__ import annotations

import collections
import math
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from repoloom.llm import quality, queries
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def near_components(docs):
    """Smallest id reachable over links of at least 0.75, by comparing every pair that shares a shingle."""
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", lowered(t)) for i, t in docs.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} for i, w in words.items() if w}
    holders = collections.defaultdict(list)
    for i, own in sets.items():
        for s in own:
            holders[s].append(i)
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, own in sets.items():
        shared = collections.Counter(j for s in own for j in holders[s] if j < i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(own) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in docs}


def hit_documents(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    windows = collections.defaultdict(set)
    for w in map(words, items):
        for k in range(max(len(w) - 9, 1) if w else 0):
            windows[min(len(w), 10)].add(tuple(w[k : k + 10]))
    hit = set()
    for i, t in docs.items():
        w = words(t)
        if any(tuple(w[k : k + n]) in found for n, found in windows.items() for k in range(len(w) - n + 1)):
            hit.add(i)
    return hit


def test_filter_stages_equal_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    every = texts(docs)
    first = {}
    for i in sorted(every):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", every[i] or ""), i)
    assert set(texts(STAGE["exact dedup"](spark, docs, SF))) == set(first.values())
    roots = near_components(every)
    assert set(texts(STAGE["near dedup"](spark, docs, SF))) == set(roots.values())
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(texts(STAGE["benchmark decontamination"](spark, docs, SF))) == set(every) - hit_documents(every, items)
    got = {r.doc_id: r.component_id for r in queries.RUNS["op6_minhash_near_dedup"](spark, SF).collect()}
    assert got == roots


def test_stages_on_awkward_rows(spark):
    """Nulls in any column, empty and blank texts, a very long text, repeated rows, clashing names, no rows."""
    data = [
        (1, "a b c d e f", "en", "s", 1, "x", 0.1, 7, 1, "q"), (2, None, None, None, None, None, None, None, None, None), (3, "", "en", "s", 0, "x", 0.2, 7, 1, "q"), (4, " \n\t", "en", "s", 3, "x", 0.3, 7, 1, "q"),
        (5, " ".join(f"word{k % 5003}" for k in range(60_000)), "en", "s", 9, "x", 0.4, 7, 1, "q"), (6, "a b c d e f", "de", "t", 1, "y", 0.5, 8, 2, "r"), (6, "a b c d e f", "de", "t", 1, "y", 0.5, 8, 2, "r"),
        (None, "without an id", "en", "s", 1, "x", 0.6, 7, 1, "q"),
    ]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, digest string, _score double, _gone long, id long, items string")
    for name, step in corpus_pipeline.STAGES[:-1]:
        left = step(spark, docs, SF)
        assert left.columns == docs.columns, name
        kept = collections.Counter(tuple(r) for r in left.collect())
        assert not kept - collections.Counter(data), name
        assert step(spark, docs.limit(0), SF).count() == 0, name
    name, pack = corpus_pipeline.STAGES[-1]
    packed = pack(spark, docs, SF).collect()
    assert collections.Counter(r.doc_id for r in packed if r.piece == 0) == collections.Counter(d[0] for d in data), name
    assert pack(spark, docs.limit(0), SF).count() == 0
    assert sorted((r.doc_id or 0 for r in STAGE["exact dedup"](spark, docs, SF).collect())) == [0, 1, 2, 4, 5]
    assert sorted((r.doc_id or 0 for r in STAGE["near dedup"](spark, docs, SF).collect())) == [0, 1, 2, 3, 4, 5]


def test_pipeline_stages_only_drop_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, step in corpus_pipeline.STAGES[:-1]:
        left = step(spark, docs, SF)
        assert left.columns == docs.columns, name
        now = {r.doc_id for r in left.select("doc_id").collect()}
        assert now <= ids and len(now) > len(ids) / 2, name
        docs, ids = left, now
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.RUNS) == list(range(1, 14))


def sequences(rows, capacity=4096):
    """Each sequence's length; its pieces lie gapless from 0."""
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    out = []
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        out.append(at)
    return out


@pytest.mark.parametrize(("name", "closing"), [("op3_best_fit_packing", 1), ("op11_histogram_packing", 2)])
def test_packed_ids_are_the_tokenizers(spark, name, closing):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = queries.RUNS[name](spark, SF).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.start, r.length, r.ids_crc32))
    docs = texts(spark.read.parquet(f"{SF}/documents.parquet"))
    assert set(by) == set(docs)
    for i, text in docs.items():
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, closing]
        at = 0
        for start, length, crc in sorted(by[i]):
            assert start == at and crc == zlib.crc32(b"".join(t.to_bytes(4, "little") for t in ids[at : at + length]))
            at += length
        assert at == len(ids)
    lengths = sequences(got)
    if name.startswith("op11"):
        assert {r.doc_id: r.doc_tokens for r in got} == {i: sum(p[1] for p in pieces) for i, pieces in by.items()}
        assert all(n & (n - 1) == 0 for n in lengths), "no sequence is padded"
    else:
        assert len(lengths) <= 1.02 * -(-sum(lengths) // 4096)


def test_whitening_equals_exact_sums(spark):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    x = {i: [math.floor(64 * c) + 1_000_000 for c in v] for i, v in rows.items()}
    n, d = len(x), len(next(iter(x.values())))
    sums = [sum(v[j] for v in x.values()) for j in range(d)]
    z = np.array([[n * v[j] - sums[j] for j in range(d)] for v in x.values()], dtype=object)
    cov = (z.T.dot(z) / n**3).astype(float)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:32], vectors[:, ::-1][:, :32]
    want = (z / n).astype(float) @ vectors / np.sqrt(values)
    got = queries.RUNS["op12_embedding_whitening"](spark, SF).collect()
    table = np.full((n, 32), np.nan)
    at = {i: k for k, i in enumerate(x)}
    for r in got:
        table[at[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and r.deviation == sum(t * t for t in z[at[r.vec_id]]) and r.identity_error < 1e-9
        assert abs(r.explained - values[r.component - 1] / np.trace(cov)) < 1e-9
    sign = np.sign((table * want).sum(axis=0))
    assert len(got) == 32 * n and np.abs(table - want * sign).max() < 1e-6


def backed_off(own, total, size, words):
    """Sum of a document's log scores, from plain counts with its own taken off."""
    rest = lambda g: total[g] - own[g]
    score = 0.0
    for k in range(len(words)):
        for n in (3, 2, 1):
            if k < n - 1:
                continue
            gram = tuple(words[k - n + 1 : k + 1])
            if n == 1:
                score += math.log((rest(gram) + 1) / (size - len(words) + 1))
            elif rest(gram) > 0:
                score += math.log(rest(gram) / rest(gram[:-1]))
                break
            else:
                score += math.log(0.4)
    return score


def test_lm_query_equals_plain_counts(spark):
    """Every document of the table, its score from n-gram counts of the whole table."""
    words = {i: [w for w in re.split(r"[ \t-\r]+", lowered(t)) if w] for i, t in texts(spark.read.parquet(f"{SF}/documents.parquet")).items()}
    grams = {i: collections.Counter(tuple(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1)) for i, w in words.items()}
    total = collections.Counter()
    for own in grams.values():
        total.update(own)
    size = sum(map(len, words.values()))
    got = {r.doc_id: r for r in queries.RUNS["op10_lm_scoring"](spark, SF).collect()}
    assert got.keys() == words.keys()
    for i, w in words.items():
        assert got[i].n_words == len(w) and got[i].score == pytest.approx(backed_off(grams[i], total, size, w), rel=1e-9, abs=1e-9)
        assert got[i].mean_score == (pytest.approx(got[i].score / len(w)) if w else None)


def test_quality_query_equals_plain_votes(spark):
    """Scores are the votes of the nearest labelled vectors, compared one by one; held-out labels have no say."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels.filter(~quality.held_out(F.col("doc_id"))))
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.train(docs, flipped.filter(~quality.held_out(F.col("doc_id"))))
    assert np.array_equal(model.labels, again.labels) and np.allclose(model.vectors, again.vectors)
    learnt = sum(1 for r in labels.collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1)
    assert len(model.labels) == learnt

    def vote(text):
        at, values = quality.features(text)
        vector = [math.fsum(float(v) * float(b) for v, b in zip(values, model.basis[at, j], strict=True)) for j in range(model.basis.shape[1])]
        norm = max(math.sqrt(math.fsum(v * v for v in vector)), 1e-9)
        near = sorted(((math.fsum(a * float(b) for a, b in zip(vector, other, strict=True)) / norm, float(label)) for other, label in zip(model.vectors, model.labels, strict=True)), reverse=True)
        weights = [(max(c, 0.0) ** 4 + 1e-6, label) for c, label in near[: model.neighbours]]
        return sum(w * label for w, label in weights) / sum(w for w, _ in weights)

    by_id = texts(docs)
    got = {r.doc_id: r for r in queries.RUNS["op2_quality_classifier"](spark, SF).collect()}
    assert got.keys() == by_id.keys()
    for i, text in by_id.items():
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and got[i].predicted == int(got[i].score >= 0.5)
    for i in sorted(by_id)[::3]:
        assert got[i].score == pytest.approx(vote(by_id[i]), abs=1e-3), i


def test_pipeline_rows_are_the_kept_documents(spark):
    """run(): every token of every kept document once, in sequences without gaps."""
    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_id = texts(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = corpus_pipeline.run(spark, SF).collect()
    per_doc = collections.defaultdict(list)
    for r in rows:
        per_doc[r.doc_id].append(r)
    for i, pieces in per_doc.items():
        ids = np.array([*encoder.encode(by_id[i] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    sequences(rows)
