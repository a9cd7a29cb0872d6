"""Every operator on awkward rows: nulls, empty and very long texts, ties, repeats, empty tables, clashing columns."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import time
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from repoloom.llm import chat, decontaminate, exactdup, histpack, lmscore, neardup, packing, pii, quality, resample, secrets, tokens, warc, whitening
from tokenizers import Tokenizer

LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000))
BASE = " ".join(f"word{i}" for i in range(60))
NEAR = BASE.replace("word30 ", "other ")
SCHEMA = "doc_id long, text string, lang string, digest string, word string, n long, id long, items string, key string"


def rows(*pairs):
    return [(i, t, "en", "d", "w", 1, 2, "i", "k") for i, t in pairs]


@pytest.fixture
def docs(spark):
    data = rows((1, BASE), (2, BASE.replace(" ", "\n ")), (3, NEAR), (4, None), (5, ""), (6, "  \t"), (7, LONG), (8, "one two"), (9, "one two"), (9, "one two"), (None, "no id"))
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_groups(docs, none):
    got = {(r.doc_id, r.keep_id): (r.group_size, r.kept) for r in exactdup.exact_groups(docs).collect()}
    assert got[1, 1] == (2, True) and got[2, 1] == (2, False)
    assert got[4, 4] == (2, True) and got[5, 4] == (2, False)
    assert got[8, 8] == (3, True) and got[9, 8] == (3, False)
    assert got[None, None] == (1, True)
    left = exactdup.exact_dedup(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0 for r in left.collect())) == [0, 1, 3, 4, 6, 7, 8]
    assert exactdup.exact_groups(none).count() == exactdup.exact_dedup(none).count() == 0


def test_repeated_row_stays_once(spark):
    twice = spark.createDataFrame(rows((1, "a b"), (1, "a b"), (2, "a  b"), (3, "c")), SCHEMA)
    assert sorted(r.doc_id for r in exactdup.exact_dedup(twice).collect()) == [1, 3]


def test_exact_dedup_shuffles_only_the_texts_it_needs(spark):
    """Texts of rows that surely stay meet no list of copies; rows of null, repeated and shared ids as before."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        alone = [(100 + k, f"own text {k}") for k in range(300)]
        data = [(1, "a b"), (2, "a  b"), (2, "c"), (3, "d"), (3, "d"), (4, "d"), (None, "a b"), (None, "e"), (None, "e"), (None, None), (5, ""), *alone]
        docs = spark.createDataFrame(rows(*data), SCHEMA)
        left = exactdup.exact_dedup(docs)
        got = collections.Counter((r.doc_id, r.text) for r in left.collect())
        assert got == collections.Counter([(1, "a b"), (2, "c"), (3, "d"), (None, "e"), (5, ""), *alone])
        named = docs.withColumn("doc_id", F.concat(F.lit("n"), F.coalesce(F.col("doc_id"), F.lit(999)).cast("string")))
        assert sum(r.doc_id.startswith("n1") for r in exactdup.exact_dedup(named).collect()) == 101
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    _, sure, *unsure = re.split(r"\n[:+]- ", left._jdf.queryExecution().optimizedPlan().toString())
    assert "strategy=broadcast" in sure and "sha2" not in sure and len(unsure) == 2 and all("LeftSemi" in part for part in unsure)


def test_exact_rounds(spark):
    """Sorted runs: one exchange by place and a sort aggregate per round, whatever the number of runs."""
    data = [(i, f"text {i % 7}  x" if i % 3 else "copied") for i in range(900)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(40)
    want = {}
    for i, t in data:
        want.setdefault(" ".join(t.split()), []).append(i)
    runs = exactdup.digest_runs(docs)
    for partitions, rounds in ((1, 1), (16, 1), (17, 2), (40, 2), (4096, 3)):
        merged = exactdup.merge_runs(runs, partitions)
        assert sorted((r.keep_id, r.copies) for r in merged.collect()) == sorted((min(v), len(v)) for v in want.values())
        plan = merged._jdf.queryExecution().sparkPlan().toString()
        assert "HashAggregate" not in plan and plan.count("SortAggregate") == 2 * (rounds + 1)
        full = merged._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        assert full.count("Exchange hashpartitioning(") == rounds + 1
    odd = docs.withColumn("digest", F.lit(1)).withColumn("id", F.lit(2)).withColumn("row", F.lit(3)).withColumn("kept", F.lit(4))
    left = exactdup.exact_dedup(odd)
    assert left.columns == odd.columns and sorted(r.doc_id for r in left.collect()) == sorted(min(v) for v in want.values())


def test_near_groups(docs, none):
    got = {r.doc_id: r for r in neardup.near_groups(docs).collect()}
    assert [got[i].component_id for i in (1, 2, 3, 8, 9)] == [1, 1, 1, 8, 8]
    assert got[4].n_shingles == got[6].n_shingles == 0 and got[4].kept and got[5].kept
    assert got[1].n_shingles == 56 and got[8].n_shingles == 1
    left = neardup.near_dedup(docs)
    assert left.columns == docs.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 4, 5, 6, 7, 8]
    assert neardup.near_groups(none).count() == 0


def test_near_groups_link_through_others(spark):
    words = [f"word{i}" for i in range(200)]
    chain = [" ".join(words[: 100 + 12 * k][12 * k :]) for k in range(8)]
    got = neardup.near_groups(spark.createDataFrame(rows(*enumerate(chain)), SCHEMA)).collect()
    sets = [neardup.shingles(t) for t in chain]
    linked = [len(set(a) & set(b)) * 100 >= 75 * len(set(a) | set(b)) for a, b in zip(sets, sets[1:], strict=False)]
    assert all(linked) and {r.component_id for r in got} == {0}


def test_near_groups_inside_a_template_family(spark):
    """A pair of 0.78 that shares only what 1000 members of at most 0.72 share, so it meets in crowded buckets alone."""
    texts = [" ".join([f"licence{i}" for i in range(160)] + [f"own{k}x{i}" for i in range(22 if k in (234, 545) else 40)]) for k in range(1000)]
    got = {r.doc_id: r.component_id for r in neardup.near_groups(spark.createDataFrame(rows(*enumerate(texts)), SCHEMA)).collect()}
    of = lambda k: set(neardup.shingles(texts[k]))
    assert 100 * len(of(0) & of(234)) < 73 * len(of(0) | of(234)) and 100 * len(of(234) & of(545)) >= 75 * len(of(234) | of(545))
    assert {k: c for k, c in got.items() if k != c} == {545: 234}


def test_marked_ids(spark):
    """The bits let every id through, few others, and no null by mistake; capped bits still lose none."""
    ids = spark.range(-2000, 2000).selectExpr("id * 1000003 as gone").unionByName(spark.createDataFrame([(2**63 - 1,), (-(2**63),)], "gone long"))
    df = spark.range(-40_000, 40_000).selectExpr("id * 1000003 as block", "id as bits", "id as at").unionByName(
        spark.createDataFrame([(2**63 - 1, None, None), (-(2**63), None, None), (None, None, None)], "block long, bits long, at long"))
    want = {r.gone for r in ids.collect()}
    for n in (ids.count(), 0):
        bits = neardup._marked(df["block"], ids, n)
        met, rest = ([r.block for r in df.join(*bits, how).collect()] for how in ("left_semi", "left_anti"))
        assert want <= set(met) and len(met) + len(rest) == df.count()
        assert len(met) < 4002 + 0.05 * 76_001 or not n
    assert df.join(*neardup._marked(df["block"], ids.limit(0), 0), "left_semi").count() == 0


def test_near_dedup_shuffles_only_the_texts_it_needs(spark, monkeypatch):
    """No join by id over all texts, neither to find candidates nor to drop rows; rows of null, repeated and unknown ids as before."""
    plans, write = {}, neardup.stage

    def noted(df, label, *args, **metrics):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, label, *args, **metrics)

    monkeypatch.setattr(neardup, "stage", noted)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        alone = [(100 + k, " ".join(f"own{k}x{i}" for i in range(30))) for k in range(300)]
        data = [(1, BASE), (2, NEAR), (2, NEAR), (None, BASE), (None, None), (3, BASE), (4, ""), *alone]
        docs = spark.createDataFrame(rows(*data), SCHEMA)
        left = neardup.near_dedup(docs)
        assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 0, 1, 4, *(i for i, _ in alone)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    texts = plans["candidate-texts"]
    assert "SortMergeJoin" not in texts and re.findall(r"Exchange hashpartitioning\((\w+)#", texts) == ["block"]
    sure, unsure = left._jdf.queryExecution().optimizedPlan().toString().split("\n+- Join LeftAnti", 1)
    assert sure.startswith("Union") and "strategy=broadcast" in sure and "LeftSemi" in unsure


def test_estimate_follows_similarity():
    import numpy as np

    draw = np.random.default_rng(1)
    for share in (0.3, 0.75, 0.9):
        a = draw.integers(0, 1 << 62, 2000, dtype=np.uint64)
        b = a.copy()
        keep = int(2000 * 2 * share / (1 + share))
        b[keep:] = draw.integers(0, 1 << 62, 2000 - keep, dtype=np.uint64)
        got = neardup.likelihood_estimate(neardup.registers(a)[None], neardup.registers(b)[None], np.array([2000.0]), np.array([2000.0]))
        assert abs(got[0] - share) < 0.15


def test_decontamination(spark, docs, none):
    item = " ".join(f"word{i}" for i in range(20, 33))
    items = spark.createDataFrame([(10, item), (2, "ONE, two!"), (3, None), (4, " .. "), (2, "ONE, two!"), (None, "no id")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.word_hits(docs, items).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1]["items"]) == (60, 13, ["10"])
    assert (got[3].n_hit, got[8].n_hit, got[8]["items"]) == (10, 2, ["2"])  # one word changed: one window left
    assert got[4].n_words == got[6].n_hit == 0 and got[None].n_hit == 2 and got[None]["items"] == []
    left = decontaminate.decontaminate(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [4, 5, 6, 7]
    assert decontaminate.word_hits(docs, items.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.decontaminate(none, items).count() == 0


def test_decontamination_with_clashing_columns_and_shared_ids(spark):
    """Rows of one id each by their own text, columns of any name, and the same hits without broadcasts."""
    data = [(1, "a b c d", 1, 2, "x", "y", 0), (1, "a x c d", 3, 4, "x", "y", 0), (None, "q a b c", 5, 6, "x", "y", 0), (None, "q", 5, 6, "x", "y", 0), (2, None, 7, 8, None, None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, h long, n long, hit string, `_id` string, n_hit long")
    items = spark.createDataFrame([(7, "b c"), (8, "A b")], "item_id long, text string")
    want = [(None, 1, 0, []), (None, 4, 3, ["7", "8"]), (1, 4, 0, []), (1, 4, 3, ["7", "8"]), (2, 0, 0, [])]
    for most in (64 << 20, 0):
        got = decontaminate.word_hits(docs, items, broadcast_bytes=most)
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got.collect()), key=lambda r: (r[0] or 0, r[1:])) == want
    left = decontaminate.decontaminate(docs, items)
    assert left.columns == docs.columns and sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, "q"), (1, "a x c d"), (2, "")]


def test_quality(spark, docs, none):
    good = [(i, " ".join(f"the{(i * k) % 50} of" for k in range(30)), 1) for i in range(100, 140)]
    bad = [(i, " ".join(f"BUY{(i * k) % 50}!!" for k in range(30)), 0) for i in range(140, 180)]
    texts = spark.createDataFrame([g[:2] for g in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(g[0], g[2], 0) for g in good + bad] + [(100, 1, 0), (101, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(texts, labels.filter(~quality.held_out(labels.doc_id)), rank=8, neighbours=5)
    scored = {r.doc_id: r.s for r in texts.select("doc_id", quality.score(texts, model).alias("s")).collect()}
    held = [g for g in good + bad if zlib.crc32(str(g[0]).encode()) % 3 == 1]
    assert held and all((scored[i] >= 0.5) == bool(q) for i, _, q in held)
    odd = docs.select(quality.score(docs, model).alias("s")).collect()
    assert len(odd) == 11 and all(0 <= r.s <= 1 for r in odd)
    assert quality.train(texts, labels.limit(0)) is None
    assert {r.s for r in docs.select(quality.score(docs, None).alias("s")).collect()} == {0.5}
    assert none.select(quality.score(none, model).alias("s")).count() == 0


def test_packing(docs, none):
    from pyspark.sql import functions as F

    from repoloom.runtime import stage

    path = public_tokenizers.path("word_bpe_49k.json")
    pieces, _ = stage(packing.token_pieces(docs, path), "test-pieces")
    got = packing.pack(pieces.withColumn("crc", F.crc32("ids"))).collect()
    whole = Tokenizer.from_file(path)
    for own, text in [(1, BASE), (4, ""), (7, LONG)]:
        ids = b"".join(i.to_bytes(4, "little") for i in [*whole.encode(text, add_special_tokens=False).ids, 1])
        mine = sorted((r.piece, bytes(r.ids), r.crc, r.start, r.length) for r in got if r.id == own)
        assert b"".join(m[1] for m in mine) == ids
        assert all(m[2] == zlib.crc32(m[1]) and m[4] == len(m[1]) // 4 <= 4096 and m[3] == 4096 * m[0] for m in mine)
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) == -(-sum(r.length for r in got) // 4096)
    empty, _ = stage(packing.token_pieces(none, path), "test-pieces")
    assert packing.pack(empty).count() == 0


def test_encoder_agrees_with_tokenizer():
    """Whole texts as the tokenizer takes them: composing marks, lowering that lengthens, special tokens, odd white space."""
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, own = Tokenizer.from_file(path), tokens.Encoder(path, most=2000)
    texts = [
        "It's the END. Of it!! ÉCOLE, naïve... x²; <|endoftext|> <|ENDOFTEXT|>a<|startoftext|>", "ΟΔΟΣ, İstanbul. ẞtraße!! don't we'LL. 3.14, abc%%%", "á école\x0b\x1c tab\tend\r\n\x85x\xa0y", "",
        "İ.", "ANKARA DEKİ, ", "क़.", "ড়,", "H\u0331. \u1e96. ſt ŉa ﬁ K Å", "日本語 テキスト。漢字1 مرحبا, 🙂👍🏽 ok", "'s 'sa x'S ''re 'LL", " \u0301x \ufeffa\u200bb\u3000e"]
    marks = [c for c in map(chr, range(0x80, 0x2FFFF)) if c.isalpha() and (len(low := unicodedata.normalize("NFC", c).lower()) != 1 or not low.isalpha())]
    texts += [f"x{c}{s} {c}{s}{c}" for c in marks for s in ".,'|-"]
    draw = random.Random(5)
    alphabet = "aAbBzZsStTdDmMlLrReEvV0129 .,'\"|<>_-!\n\u0327\u0331\u0301ÀéÜñşŞİıŸßĲŉſΣςक़ড়字🙂"
    texts += ["".join(draw.choices(alphabet, k=draw.randint(1, 25))) for _ in range(1500)]
    want = [b"".join(i.to_bytes(4, "little") for i in whole.encode(t, add_special_tokens=False).ids) for t in texts]
    got = own.encode(texts)
    assert [t for t, a, b in zip(texts, got, want, strict=True) if a != b] == []
    assert own.encode(texts[::-1]) == want[::-1]
    long = "Word's end. " * 200_000
    assert own.encode([long])[0] == own.encode(["Word's end."])[0] * 200_000


def histogram_of(plan, counts, capacity):
    """Every sequence's length, by placing every piece; pieces must not overlap or leave a gap."""
    filled = collections.defaultdict(list)
    for length, n in counts.items():
        for rank in range(n):
            row = int(np.searchsorted(plan.keys, (length << 40) + rank, side="right")) - 1
            nth = rank - int(plan.ranks[row])
            if plan.offsets[row] >= 0:
                filled[int(plan.places[row]) + nth].append((int(plan.offsets[row]), length))
            else:
                parts = list(histpack._fragments(plan, int(plan.places[row]) + nth * length, length))
                assert sum(p[1] for p in parts) == length
                for _, size, sequence, offset in parts:
                    filled[sequence].append((offset, size))
    ends = []
    for places in filled.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at <= capacity
        ends.append(at)
    return ends


def test_encoder_keeps_only_words_met_again():
    """Words met once do not stay in the worker's memory; their ids are right, as are those of words met again."""
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, own = Tokenizer.from_file(path), tokens.Encoder(path)
    for k in range(12):
        texts = [" ".join(f"common Often{i % 7} w{k}x{i} \u0435\u0434{k}y{i}" for i in range(100)), f"w{k}x1 common"]
        want = [np.array(whole.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
        assert own.encode(texts) == want
    assert "common" in own.known and "often3" in own.known | {w.lower(): 0 for w in own.known} and len(own.known) < 40


def test_shortest_pack_first():
    draw = random.Random(3)
    cases = [{3000: 40}, {k: 300 for k in range(1, 21)}, {1: 1}, {4096: 3}, {1: 5000, 5: 3}, {draw.randint(1, 4096): draw.randint(1, 9) for _ in range(300)}]
    for counts in cases:
        ends = histogram_of(histpack.plan_packing(counts), counts, 4096)
        assert sum(ends) == sum(k * n for k, n in counts.items())
        assert all(e & (e - 1) == 0 for e in ends) and sum(e < 4096 for e in ends) <= 12
    packs = histpack.shortest_pack_first({6: 2, 3: 3, 2: 1}, 10)
    assert sorted((p.count, p.room, sorted(s[0] for s in p.slots())) for p in packs) == [(1, 5, [2, 3]), (2, 1, [3, 6])]
    assert len(histpack.plan_packing({}).keys) == 0
    # no piece is cut where the lengths fit as they are
    assert histpack.plan_packing({4096: 2, 2048: 2}).cut_lengths == []


def test_histogram_packing(docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = histpack.pack_documents(docs, path).collect()
    whole = Tokenizer.from_file(path)
    for own, text, copies in [(1, BASE, 1), (4, "", 1), (6, "  \t", 1), (7, LONG, 1), (9, "one two", 2), (None, "no id", 1)]:
        ids = [*whole.encode(text, add_special_tokens=False).ids, 2]
        mine = [r for r in got if r.id == own]
        assert sum(r.length for r in mine) == copies * len(ids) and {r.doc_tokens for r in mine} == {len(ids)}
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[r.start : r.start + r.length]))
    assert histpack.pack_documents(none, path).count() == 0


@pytest.mark.parametrize("wide", [1e3, 1e9])
def test_whitening_on_awkward_rows(spark, wide):
    inf, nan = float("inf"), float("nan")
    draw = random.Random(2)
    good = [[draw.gauss(0, 1), draw.gauss(0, 3), 7.5, wide * draw.random()] for _ in range(40)]
    bad = [None, [], [1.0, None, 2.0, 3.0], [nan, 1.0, 1.0, 1.0], [1.0, inf, 1.0, 1.0], [1.0, 2.0], [1e300, 1.0, 1.0, 1.0]]
    data = [(k if k else None, v, "x", 0.0, 1) for k, v in enumerate([*good, good[3], *bad])]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<double>, x string, whitened double, n int")
    got = whitening.whiten(vectors).collect()
    kept = [*good, good[3]]
    n = len(kept)
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in kept]
    sums = [sum(col) for col in zip(*x, strict=True)]
    z = [[n * a - s for a, s in zip(v, sums, strict=True)] for v in x]
    cov = [[sum(r[i] * r[j] for r in z) for j in range(4)] for i in range(4)]
    counted, s, exact = whitening.covariance(whitening.fit_list(vectors))
    assert (counted, s) == (n, sums) and [[c * n for c in row] for row in exact] == cov
    assert {r.component for r in got} == {1, 2, 3, 4} and len(got) == 4 * n
    size = lambda t: t if t < 1 << 63 else None
    assert {(r.id, r.deviation) for r in got} == {(k if k else None, size(sum(c * c for c in z[k]))) for k in range(n)}
    # beside a spread of 1e9 the others lie within rounding of zero
    assert all((r.whitened is None) == (r.component > (1 if wide > 1e6 else 3)) and r.identity_error < 1e-4 for r in got)
    assert whitening.whiten(vectors.limit(0)).count() == 0
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")).collect()
    assert len(same) == 4 and {(r.whitened, r.explained, r.identity_error) for r in same} == {(None, 0.0, 0.0)}


def resampled(docs, target, longest, buckets, percent, least):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    def grams(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = collections.Counter(g for d in docs for g in grams(d[1])), collections.Counter(g for i in target for g in grams(i))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for own, text in docs:
        h = int(hashlib.sha256(f"2024:{'' if own is None else own}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, grams(text)))
        out.append([own, len(grams(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r, d in zip(out, docs, strict=True) if len(words(d[1])) >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0], r[2], r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return collections.Counter(map(tuple, out))


def test_resampling(spark, docs, none):
    draw = random.Random(4)
    texts = [" ".join(draw.choices(["alpha", "Beta", "g\u00e9ant", "x\0y", "d3lta", "..", "\u00c9e"], k=draw.randint(0, 40))) for _ in range(200)]
    data = [*enumerate(texts), (3, texts[3]), (3, texts[3]), (None, texts[5]), (7, None), (8, ""), (9, LONG)]
    target = ["alpha BETA alpha", None, "", "g\u00e9ant d3lta"]
    rows_of = spark.createDataFrame([(i, t, "x", 1, 0) for i, t in data], "doc_id long, text string, id string, weight int, rank int").repartition(5)
    items = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    for longest, buckets, percent, least in [(1, 10_000, 10, 20), (3, 97, 50, 3), (2, 500, 100, 0)]:
        got = resample.resample(rows_of, items, longest=longest, buckets=buckets, percent=percent, least_words=least).collect()
        assert collections.Counter(map(tuple, got)) == resampled(data, target, longest, buckets, percent, least)
    assert resample.resample(rows_of, items.limit(0)).count() == len(data)
    assert resample.resample(none, items).count() == 0


def test_plan_is_close_to_the_bound():
    counts = {n: 1 + (n * 7919) % 13 for n in range(3, 4097, 5)}
    plan = packing.plan_packing(counts)
    ends = []
    for length, part in plan.groupby("length"):
        ranks = [*part["rank"], counts[length]]
        ends += [s + b - a for s, a, b in zip(part["sequence"], ranks, ranks[1:], strict=False)]
    assert max(ends) <= 1.02 * -(-sum(k * v for k, v in counts.items()) // 4096)
    assert packing.plan_packing({}).empty


def test_chat_trees(spark):
    said = "</s>[INST] \\<|x|> ok [/INST]"
    data = [
        ("t", 1, None, "user", "hi", 0.0), ("t", 2, 1, "assistant", said, 1.0), ("t", 3, 1, "assistant", "bad", 0.5), ("t", 4, 2, "user", None, 0.0), ("t", 4, 2, "user", None, 0.0),
        ("c", 1, 2, "user", "x", 0.0), ("c", 2, 1, "user", "y", 0.0), ("c", 3, 1, "user", "under a cycle", 0.0),
        (None, 1, 99, None, "orphan", None), ("t", None, 1, "user", "no id", 0.0),
    ]
    rows_ = spark.createDataFrame(data, "tree_id string, node_id long, parent_id long, role string, text string, score double")
    got = chat.read_back(chat.format_conversations(rows_, score_col="score", top=9)).collect()
    paths = {(r.tree_id, r.leaf): [(t.role, t.text) for t in r.turns] for r in got}
    assert paths == {("t", 4): [("user", "hi"), ("assistant", said), ("user", "")], ("t", 3): [("user", "hi"), ("assistant", "bad")], (None, 1): [("", "orphan")]}
    assert {(r.leaf, r["rank"], r.loss_text) for r in got if r.tree_id} == {(4, 1, said), (3, 2, "bad")}
    assert chat.format_conversations(rows_.limit(0)).count() == 0


def test_chat_long_chain(spark):
    n = 300
    rows_ = spark.createDataFrame([("a", i, i - 1 if i else None, "assistant" if i % 2 else "user", f"m{i}") for i in range(n)], "tree_id string, node_id long, parent_id long, role string, text string")
    (r,) = chat.read_back(chat.format_conversations(rows_)).collect()
    assert [t.text for t in r.turns] == [f"m{i}" for i in range(n)] and r.loss_text == "".join(f"m{i}" for i in range(1, n, 2))


def test_pii():
    key = b"k"
    text = "Mrs Anna Lee, +1 (988) 555-2485 or (988) 555-2485; a.b@x.org A.B@x.org 10.1.2.3 4984250489669609 on 2020-01-05"
    new, spans = pii.rewrite(text, key)
    assert [k for *_, k in spans] == ["name", "phone", "phone", "email", "email", "ip", "card"]
    for a, b, kind in spans:
        assert kind == "ip" or len(new) and text[a:b] not in new
    words = new.split("; ")[1].split(" ")
    assert words[0].lower() == words[1].lower() and words[1][0].isupper() and new.endswith("on 2020-01-05")
    assert new.split(" ")[1] in pii.FEMALE_NAMES and pii.rewrite(None, key) == (None, []) and pii.rewrite("clean", key)[0] == "clean"
    images = {pii.image(key, "phone", f"988555{i:04d}") for i in range(2000)}
    assert len(images) == 2000 and not any(c[0] in "01" for c in images)


def test_pii_corpus(spark, docs, none):
    mails = spark.createDataFrame([(i, f"to {c}{d}@a.io now", "x") for i, (c, d) in enumerate((c, d) for c in "bcdfg" for d in range(10))] + [(99, None, "x"), (98, "", "x")], "doc_id long, text string, entities string")
    out = pii.replace_entities(mails, b"k").collect()
    new = {r.doc_id: r.text for r in out}
    assert len({new[i] for i in range(50)}) == 50 and new[99] is None and new[98] == ""
    assert {r.doc_id: r.text for r in pii.replace_entities(docs, b"k").collect()}[7] == LONG
    assert pii.replace_entities(none, b"k").count() == 0


def test_pii_gender_and_coreference(spark):
    """Against plain Python: one surrogate per entity, distinct ones for distinct ones, given names of the gender told anywhere."""
    rng = random.Random(5)
    firsts = ["".join(rng.choice("BDKLMR")) + "".join(rng.choice("aeiou") + rng.choice("dlnrst") for _ in range(2)) + rng.choice(["", "a"]) for _ in range(60)]
    people = {}
    for first in firsts:
        for last in ("Stone", "Hill", "Иванов"):
            people[f"{first} {last}"] = rng.choice(["m", "f", "", "mf"])
    people |= {"Ольга Петрова": "f", "Νίκος Παππάς": "m"}
    titles = {"m": ["Mr", "Dr"], "f": ["Mrs", "Prof"], "": ["Dr"], "mf": ["Mr", "Ms"]}
    said = [(t, n) for n, g in people.items() for t in titles[g]]
    data = [(i, f"{t}. {n} and again {t} {n}, a{i % 7}@x.org") for i, (t, n) in enumerate(said)]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("_id", F.lit(1)).withColumn("_times", F.lit(2)).withColumn("row", F.lit(3)).withColumn("known", F.lit(4))
    out = pii.replace_entities(docs, b"k")
    assert out.columns == [*docs.columns, "entities", "n_entities"]
    became, mails = collections.defaultdict(set), collections.defaultdict(set)
    for r in out.collect():
        t, n = said[r.doc_id]
        m = re.fullmatch(rf"{t}\. (\S+ \S+) and again {t} (\S+ \S+), (\S+)", r.text)
        became[n] |= {m[1], m[2]}
        mails[f"a{r.doc_id % 7}@x.org"].add(m[3])
    assert all(len(v) == 1 for v in [*became.values(), *mails.values()]) and len(set.union(*became.values())) == len(people)
    assert not set.union(*became.values()) & set(people) and len(set.union(*mails.values())) == 7
    for n, g in people.items():
        first = next(iter(became[n])).split(" ")[0]
        script = unicodedata.name(n[0]).split(" ")[0]
        assert unicodedata.name(first[0]).startswith(script)
        if g in ("m", "f"):
            assert first.endswith(tuple(pii._GIVEN[script][2][g]))
        else:
            assert len(first) == len(n.split(" ")[0])
    assert pii.image(b"k", "name", "Olivia Stone", "f") != pii.image(b"k", "name", "Olivia Stone", "m")


def test_pii_found_in_linear_time():
    """Mail addresses as one pattern finds them; time grows with the text."""
    whole = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("ab@@..- é_") for _ in range(30))
        assert [s[:2] for s in pii.find(text) if s[2] == "email"] == [m.span() for m in whole.finditer(text)]
    for text in ("a" * 200_000, "@a." * 60_000, " ".join(f"m{i}@x.org" for i in range(16_000)), "1-" * 100_000, "Mr A" * 50_000):
        start = time.monotonic()
        pii.find(text)
        assert time.monotonic() - start < 3


def test_pii_dense_shapes(spark):
    """All strings of a shape but a few, whole lists of given names, scripts beyond Latin."""
    short = [c + v for c in "BCDFGHJKLMNPQRSTVWXYZ" for v in "aeiou"]
    names = short[:-6] + pii.MALE_NAMES + ["김민수", "さくら", "محمد", "Łukasz"]
    docs = spark.createDataFrame([(i, f"Dr {n}, hello") for i, n in enumerate(names)], "doc_id long, text string")
    _, table = pii.surrogates(docs, b"k")
    got = {r.value: r for r in table.collect()}
    assert set(got) == set(names) and len({r.surrogate for r in got.values()}) == len(names)
    assert all(r.real == (r.surrogate in got and r.surrogate != r.value) for r in got.values()) and got["James"].real
    assert all(got[n].surrogate != n and pii.shape_of("name", got[n].surrogate) == pii.shape_of("name", n) for n in names[-4:])
    out = pii.replace_entities(docs, b"k").collect()
    assert {r.doc_id: r.text for r in out} == {i: f"Dr {got[n].surrogate}, hello" for i, n in enumerate(names)}


def test_warc(spark):
    big = "x" * 1000
    data = [(1, "http://a/ é", big, "u"), (2, None, big, "u"), (3, "http://b/\r\nWARC: x", "a\r\n\r\nWARC/1.1\r\n", "u"), (4, "u", None, "u"), (5, "u", "", "u"), (None, "u", big, "u"), (2, None, big, "u"), (6, "u", "é" * 500, "u"), (7, "v", "é" * 500, "u")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, payload string")
    index = warc.write_archives(pages)
    got = sorted(((r.id or 0, r.record_type, r.refers_to, r.payload_bytes, bytes(r.payload) if r.payload is not None else None) for r in warc.read_records(spark, index, most=900).collect()), key=repr)
    assert len(got) == 9 and (1, "revisit", 2, 1000, None) in got and got.count((2, "response", None, 1000, big.encode())) == 2
    assert (3, "response", None, 15, b"a\r\n\r\nWARC/1.1\r\n") in got and (6, "revisit", 7, 1000, None) in got and (0, "response", None, 1000, big.encode()) in got
    assert warc.read_records(spark, index.filter("url = 'v'")).count() == 1
    assert warc.read_records(spark, warc.write_archives(pages.limit(0))).count() == 0


def test_secret_ledger(spark, docs, none):
    data = [(1, 'API_KEY = "abcdefghijkl" password=short token:abcdefghijklm'), (2, None), (3, "é AKIA" + "A" * 14 + " " + "0f" * 8), (4, "é AKIA" + "A" * 14 + " " + "0f" * 8), (5, "ſecret=abcdefghijklmnop")]
    versions = spark.createDataFrame(data, "doc_id long, text string")
    found, ledger = secrets.scan_versions(versions)
    got = {r.doc_id: r for r in found.collect()}
    assert got[1].n_assign == 2 and got[3].spans == "access:2:20,hex:21:37" == got[4].spans and got[2].spans == got[5].spans == ""
    more = versions.union(spark.createDataFrame([(6, "token=abcdefghijklmnop")], versions.schema))
    again, new = secrets.scan_versions(more, ledger)
    assert [[f.rule for f in r.found] for r in new.collect()] == [["assign@1", "access@1", "hex@1"]] and again.count() == 6
    assert {r.doc_id: r.spans for r in again.collect()} == {**{i: r.spans for i, r in got.items()}, 6: "assign:0:22"}
    # one rule changes: it alone runs again, over all blobs
    rules = [secrets.RULES[0], secrets.RULES[1]._replace(version=2, least=30), secrets.RULES[2]]
    after, new = secrets.scan_versions(more, ledger.unionByName(new).unionByName(new), rules=rules)
    assert [[f.rule for f in r.found] for r in new.collect()] == [["access@2"]] * 5
    assert {r.doc_id: r.spans for r in after.collect()}[3] == "hex:21:37"
    same = spark.createDataFrame([(None, "token=abcdefghijklmnop"), (7, "token=abcdefghijklmnop")] * 400 + [(None, "")], versions.schema)
    assert [r.n for r in secrets.scan_versions(same)[0].groupBy("spans").agg(F.count("*").alias("n")).orderBy("n").collect()] == [1, 800]
    assert secrets.scan_versions(docs)[0].count() == 11 and secrets.scan_versions(none)[0].count() == 0


def test_lm_scores(spark, docs, none):
    data = [(1, "a b c a b d"), (2, "A b c"), (3, None), (4, ""), (5, "b c a b"), (5, "b c a b"), (None, "z")]
    got = sorted((r.doc_id or 0, r.n_words, r.score) for r in lmscore.lm_scores(spark.createDataFrame(data, "doc_id long, text string")).collect())
    tokens = [(i or 0, (t or "").lower().split()) for i, t in data]
    grams = lambda w, n: collections.Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    total = [sum((grams(w, n) for _, w in tokens), collections.Counter()) for n in (1, 2, 3)]
    want = []
    for own, w in tokens:
        mine, size, score = [grams(w, n) for n in (1, 2, 3)], sum(total[0].values()) - len(w), 0.0
        rest = lambda g: total[len(g) - 1][g] - mine[len(g) - 1][g]  # noqa: B023, E731
        for k in range(len(w)):
            for n in (3, 2, 1):
                g = tuple(w[k - n + 1 : k + 1]) if k >= n - 1 else None
                if n == 1:
                    score += math.log((rest(g) + 1) / (size + 1))
                elif g and rest(g) > 0:
                    score += math.log(rest(g) / rest(g[:-1]))
                    break
                elif g:
                    score += math.log(0.4)
        want.append((own, len(w), score))
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2])
    assert lmscore.lm_scores(docs, batch_tokens=10_000).count() == 11 and lmscore.lm_scores(none).count() == 0


def test_encoder_tokenizes_words_once_for_their_signs():
    """A word that a sign follows, or that is met again soon, is not tokenized again (before: once for each sign and twice at least)."""
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, own = Tokenizer.from_file(path), tokens.Encoder(path)
    tokenized, of_runs = collections.Counter(), own._of_runs

    def counted(runs):
        tokenized.update(runs)
        return of_runs(runs)

    own._of_runs = counted
    for sign in ["", ",", ".", "?", ";"]:
        texts = [" ".join(f"{a}öd{b}n{sign}" for a in "kqvxz" for b in "aeiou") + " end", "", "ends. 'S, 9. x.. A! İ. <|ENDOFTEXT|>. q|. é. \n"]
        want = [np.array(whole.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
        assert own.encode(texts) == want
    assert max(tokenized[f"{a}öd{b}n"] for a in "kqvxz" for b in "aeiou") == 1 and "ködan" in own.known
    for letter in tokens.LETTERS:
        text = f"{letter}x{letter} x{letter}. {letter}{letter}9, "
        assert own.encode([text])[0] == np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    assert list(tokens.parts(["a", "", "b" * (1 << 21), "c"])) == [["a", ""], ["b" * (1 << 21)], ["c"]] and list(tokens.parts([])) == []


def test_histogram_pieces_of_texts_in_parts(spark):
    """Owners keep their ids where texts are encoded in parts: long, null and empty texts between short ones."""
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    rows = [(1, "Some words. " * 30_000), (None, "of nobody, 9."), (2, None), (3, ""), (2**60 + 1, "x.. it's É."), (4, "ends. " * 25_000), (4, "ends. " * 25_000), (5, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = collections.Counter((own, len(whole.encode(text or "", add_special_tokens=False).ids) + 1) for own, text in rows)
    firsts = [r for r in histpack.document_pieces(docs, path).select("id", "start", "length", "doc_tokens", "ids_crc32").collect()]
    assert collections.Counter((r.id, r.doc_tokens) for r in firsts if r.start == 0) == want
    total = collections.Counter()
    for r in firsts:
        total[r.id] += r.length
    assert total == sum((collections.Counter({own: n * times}) for (own, n), times in want.items()), collections.Counter())
