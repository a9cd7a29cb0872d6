"""Near-duplicate groups by SetSketch registers.

A document's set is its distinct five-word shingles. Each of 128 registers
holds the exponentially spaced, truncated minimum of an exponential variable
over the set; registers of a union are the maxima of registers, and two sets
share a register value with probability close to their similarity. Bands of
four registers are hashed; documents that share a band are candidates. The
joint likelihood of the register comparison (with the known set sizes) gives
an estimate; pairs far below the threshold go, all others are verified on
their full sets, so every link is exact.

Equal sets are one class from the start. Within a band's bucket nothing is
paired all against all: every member is compared with the bucket's heads, the
class with most copies and the smallest id. Links are joined to components by
alternating star contraction. Documents in buckets that then still hold several
components are bucketed again by 64 groups of eight registers, drawn anew each
turn, where again every member meets heads of other components, the smallest
id and one by hash. When a turn finds no link and buckets still hold several
components, their documents are finished exactly: every two of different
components that share a shingle of their prefixes (rarest shingles first, with
bounds by set size and position) are compared on their full sets. Hot heads
and hot shingles are salted. At a similarity of 0.75 a pair shares no band
with probability 5e-6.

Texts are not shuffled to find out which are needed: a broadcast bitmap of
hashed ids, of at most 32 MB, lets those through in the scan, and a few more.
The joins that follow are on ids, so these change no result.

Defined cases: null, empty and blank texts have empty sets, link with nothing
and stay. Rows without an id take no part and stay. Rows that share an id are
one node. Texts of fewer than five words are one shingle. Shingles are
compared by 64-bit hashes. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoloom.functions.marks import marked
from repoloom.runtime import stage

REGISTERS, BAND, FINE = 128, 4, 64
#: Parameters of the sketch: spacing of register values, rate, largest value.
BASE, RATE, TOP = 1.001, 20.0, 65535
#: An estimate so far below the threshold is four deviations off.
SLACK = 0.16
PER_SALT = 256
#: Shingles are ordered by how often their highest bits occur among the open documents.
RARITY_BITS = 18
ROWS_PER_FILE = 200_000

_draw = np.random.default_rng(20240229)
_SCALE = _draw.integers(1, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _draw.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; words split at ASCII white space, A-Z lowered."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    if len(own) < size:
        mixed = np.array([xxhash.xxh64_intdigest(own.tobytes(), seed=len(own))], dtype=np.uint64)
    else:
        n = len(own) - size + 1
        mixed = own[:n] * _PLACE[0]
        for k in range(1, size):
            mixed += own[k : k + n] * _PLACE[k]
    mixed ^= mixed >> np.uint64(29)
    mixed *= _PLACE[-1]
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def registers(members: np.ndarray) -> np.ndarray:
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for first in range(0, len(members), 1024):
        least = np.minimum(least, (_SCALE[:, None] * members[None, first : first + 1024]).min(axis=1))
    smallest = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1.0 - np.log(np.maximum(smallest, 1e-300)) / np.log(BASE)), 0, TOP).astype("<u2")


def likelihood_estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, steps: int = 64) -> np.ndarray:
    """Similarity of greatest joint likelihood for rows of registers ``a`` and ``b`` and set sizes."""
    more, fewer = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - fewer
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    tries = np.minimum(u / v, v / u)[:, None] * np.linspace(0.0, 1.0, steps)[None, :]
    p = lambda x: -np.log(np.maximum(1.0 - np.maximum(x, 0.0) * (BASE - 1) / BASE, 1e-300)) / np.log(BASE)
    up, down = p(u[:, None] - v[:, None] * tries), p(v[:, None] - u[:, None] * tries)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    total = more[:, None] * log(up) + fewer[:, None] * log(down) + same[:, None] * log(1.0 - up - down)
    return np.take_along_axis(tries, total.argmax(axis=1)[:, None], axis=1)[:, 0]


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        n, digests, sketches = [], [], []
        for text in batch["text"]:
            members = shingles(text)
            n.append(len(members))
            digests.append(hashlib.blake2b(members.tobytes(), digest_size=16).digest())
            sketches.append(registers(members).tobytes() if len(members) else b"")
        yield pd.DataFrame({"id": batch["id"].astype("Int64"), "n": n, "digest": digests, "regs": sketches})


def _estimator(least: float) -> Callable:
    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        rows = lambda s: np.frombuffer(b"".join(s), dtype="<u2").reshape(-1, REGISTERS)
        return pd.Series(likelihood_estimate(rows(a), rows(b), n_a.to_numpy(float), n_b.to_numpy(float)) >= least)

    return near


def _fine_keys(turn: int) -> Callable:
    """Hashes of ``FINE`` groups of registers, drawn anew each turn, twice as long as a band."""
    draw = np.random.default_rng(turn)
    groups = np.stack([draw.permutation(REGISTERS)[: 2 * BAND] for _ in range(FINE)])
    mix = draw.integers(1, 1 << 63, (FINE, 2 * BAND), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    @F.pandas_udf("array<long>")
    def keys(regs: pd.Series) -> pd.Series:
        rows = np.frombuffer(b"".join(regs), dtype="<u2").reshape(-1, REGISTERS)
        out = np.zeros((len(rows), FINE), dtype=np.uint64)
        for k in range(2 * BAND):
            out = (out ^ rows[:, groups[:, k]].astype(np.uint64)) * mix[:, k]
            out ^= out >> np.uint64(31)
        return pd.Series(list(out.view(np.int64)))

    return keys


def _verifier(part: int, whole: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows come sorted by head and salt, the head's own row first."""

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, members = None, None
        for batch in batches:
            linked = []
            for head, salt, member, own, text in zip(batch["head"], batch["salt"], batch["member"], batch["id"], batch["text"], strict=True):
                found = shingles(text)
                if not member:
                    current, members = (head, salt), found
                elif current == (head, salt):
                    both = len(np.intersect1d(members, found, assume_unique=True))
                    if whole * both >= part * (len(members) + len(found) - both):
                        linked.append((own, head))
            yield pd.DataFrame(linked, columns=["id", "head"]).astype("int64")

    return verify


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """``id, root`` (smallest id reachable) for the ids of ``links`` (id, head), by alternating star contraction."""
    def small(df: DataFrame, rows: int) -> DataFrame:
        return df.coalesce(rows // ROWS_PER_FILE + 1)

    check = {"n": F.count(F.lit(1)), "s": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    edges, before = stage(links.select(F.greatest("id", "head").alias("a"), F.least("id", "head").alias("b")).filter("a <> b").distinct(), label, **check)
    while before["n"]:
        # large star: neighbours above a node hang on the least of its neighbourhood
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large, _ = stage(small(large, before["n"]), label)
        # small star: a node and its neighbours below hang on the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        pulled = large.join(least, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e")).select("e.a", F.col("e.m").alias("b"))
        edges, after = stage(small(pulled.filter("a <> b").distinct(), 2 * before["n"]), label, **check)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))


def _verified(docs: DataFrame, pairs: DataFrame, part: int, whole: int) -> DataFrame:
    """The pairs (id, head) whose full sets are similar enough; ``docs`` has ``id, text``."""
    degree = pairs.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / PER_SALT).cast("int").alias("salts"))
    members = pairs.join(degree, "head").select("id", "head", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("member"))
    heads = degree.select(F.col("head").alias("id"), "head", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("member"))
    rows = docs.hint("merge").join(members.unionByName(heads), "id").select("head", "salt", "member", "id", "text")
    rows = rows.repartition("head", "salt").sortWithinPartitions("head", "salt", "member")
    return rows.mapInPandas(_verifier(part, whole), "id long, head long").distinct()


def _marked(id_: Column, ids: DataFrame, n: int) -> tuple[DataFrame, Column]:
    """``marked`` for ids of any whole type, compared as longs."""
    own = ids.columns[0]
    return marked(id_.cast("long"), ids.select(ids[own].cast("long").alias(own)), n)


def _rarity(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros(1 << RARITY_BITS, dtype=np.int64)
    for batch in batches:
        for text in batch["text"]:
            np.add.at(counts, shingles(text) >> np.uint64(64 - RARITY_BITS), 1)
    held = counts.nonzero()[0]
    yield pd.DataFrame({"slot": held, "n": counts[held]})


def _prefixes(often: np.ndarray, part: int, whole: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The shingles of which two similar sets share one at least: ``short`` ones suffice for the smaller set."""

    usual = int(often.mean())

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept, taken = [], []
            for text in batch["text"]:
                members = shingles(text)
                n, times = len(members), often[members >> np.uint64(64 - RARITY_BITS)]
                order = np.lexsort((members, times))[: n + part * n // -whole + 1]
                at = np.arange(len(order))
                # a slot that occurs once holds a shingle of this set only
                some = times[order] > 1
                at, order = at[some], order[some]
                kept.append((np.full(len(at), n), at, at <= n + 2 * part * n // -(part + whole), members[order].view(np.int64), np.maximum(times[order].astype(np.int64) - usual, 0) // (4 * PER_SALT) + 1))
                taken.append(len(at))
            if kept:
                out = pd.DataFrame(dict(zip(["n", "at", "short", "shingle", "salts"], map(np.concatenate, zip(*kept, strict=True)), strict=True)))
                out.insert(0, "root", np.repeat(batch["root"].to_numpy(), taken))
                out.insert(0, "id", np.repeat(batch["id"].to_numpy(), taken))
                yield out

    return prefixes


def _sharing(open_texts: DataFrame, part: int, whole: int) -> DataFrame:
    """Pairs (id, head) of different components, all that can reach the threshold among them; ``open_texts`` has ``id, root, text``."""
    often = np.zeros(1 << RARITY_BITS, dtype=np.int32)
    counted = open_texts.select("text").mapInPandas(_rarity, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    often[counted["slot"]] = counted["n"].clip(upper=2**31 - 1)
    rows, _ = stage(open_texts.select("id", "root", "text").mapInPandas(
        _prefixes(often, part, whole), "id long, root long, n long, at long, short boolean, shingle long, salts long"), "prefixes")
    larger = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts"))).drop("short", "salts")
    smaller = rows.filter("short").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).select(
        "shingle", "salt", F.col("id").alias("head"), F.col("root").alias("root_head"), F.col("n").alias("n_head"), F.col("at").alias("at_head"))
    return larger.hint("merge").join(smaller, ["shingle", "salt"]).filter(F.expr(
        f"root <> root_head and (n_head < n or n_head = n and head < id) and {whole} * n_head >= {part} * n"
        f" and {part + whole} * least(n - at, n_head - at_head) >= {part} * (n + n_head)")).select("id", "head").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = 75, whole: int = 100) -> DataFrame:
    """Per row: its id, ``n_shingles, component_id, kept``; links at ``whole * intersection >= part * union``."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketches, _ = stage(texts.mapInPandas(_sketch, "id long, n long, digest binary, regs binary"), "sketches")
    live = sketches.filter("n > 0 and id is not null")
    classes, _ = stage(live.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    reps, _ = stage(live.join(classes, "digest").filter("id = rep").select("id", "n", "copies", "regs"), "representatives")
    bands = reps.select("id", "copies", F.explode(F.expr(
        f"transform(sequence(0, {REGISTERS // BAND - 1}), b -> xxhash64(b, substring(regs, b * {2 * BAND} + 1, {2 * BAND})))")).alias("key"))
    heads = (
        bands.groupBy("key").agg(F.max(F.struct("copies", (-F.col("id")).alias("minus"))).alias("most"), F.min("id").alias("least"), F.count(F.lit(1)).alias("rows"))
        .filter(F.col("rows") > 1).select("key", (-F.col("most.minus")).alias("most"), "least")
    )
    shared, met = stage(bands.select("key", "id").join(heads, "key"), "shared-bands", n=F.approx_count_distinct("id"))
    pairs = shared.select("id", F.explode(F.array_distinct(F.array("most", "least"))).alias("head")).filter("id <> head")
    side = reps.select("id", "n", "regs")
    # the texts that may need comparing; all turns read this table
    texts, _ = stage(texts.join(*_marked(texts["id"], shared.select("id"), met["n"]), "left_semi"), "candidate-texts")
    tested, labels, turn, at = None, None, 0, None
    while True:
        pairs = pairs.select("id", "head").distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["id", "head"], "left_anti")
        known = pairs.join(side, "id").join(side.select(F.col("id").alias("head"), F.col("n").alias("n_head"), F.col("regs").alias("regs_head")), "head")
        known = known.filter(F.expr(f"{whole} * least(n, n_head) >= {part} * greatest(n, n_head)"))
        close, likely = stage(
            known.filter(_estimator(part / whole - SLACK)("regs", "regs_head", "n", "n_head")).select("id", "head").distinct(), "likely-pairs", n=F.count(F.lit(1)))
        tested = close if tested is None else tested.unionByName(close)
        if likely["n"] or labels is None:
            new, found = stage(_verified(texts, close, part, whole).coalesce(likely["n"] // ROWS_PER_FILE + 8), "links", n=F.count(F.lit(1)))
        if labels is not None and not (likely["n"] and found["n"]):
            # what is still open is finished exactly
            still, _ = stage(texts.hint("merge").join(at, "id"), "open-texts")
            pairs, several = stage(_sharing(still, part, whole).join(tested, ["id", "head"], "left_anti"), "sharing-pairs", n=F.count(F.lit(1)))
            if several["n"]:
                new, _ = stage(_verified(still, pairs, part, whole).coalesce(several["n"] // ROWS_PER_FILE + 8), "links")
                labels = components(new.unionByName(labels.withColumnRenamed("root", "head")))
            break
        labels = components(new if labels is None else new.unionByName(labels.withColumnRenamed("root", "head")))
        # documents in buckets that still hold several components
        at = shared.select("key", "id").join(labels, "id", "left").withColumn("root", F.coalesce("root", "id"))
        several = at.groupBy("key").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).filter("_a <> _b").select("key")
        at, left = stage(at.join(several, "key").select("id", "root").distinct(), "open-documents", n=F.count(F.lit(1)))
        if not left["n"]:
            break
        turn += 1
        fine = at.join(side.select("id", "regs"), "id").select("id", "root", F.explode(_fine_keys(turn)("regs")).alias("key"))
        member = F.struct("id", "root")
        fine_heads = (
            fine.groupBy("key").agg(F.min(member).alias("least"), F.min_by(member, F.xxhash64("id", "key")).alias("any"), F.min("root").alias("_a"), F.max("root").alias("_b"))
            .filter("_a <> _b").select("key", F.explode(F.array_distinct(F.array("least", "any"))).alias("h"))
        )
        pairs = fine.join(fine_heads, "key").filter("root <> h.root").select("id", F.col("h.id").alias("head"))
    of_class = classes.select("digest", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(
        "digest", F.coalesce("root", "rep").alias("component_id"))
    alone = sketches.filter("n = 0 or id is null").select(F.col("id"), "n", F.col("id").alias("component_id"))
    joined = live.join(of_class, "digest").select("id", "n", "component_id")
    return joined.unionByName(alone).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one document per group, with all their columns."""
    out, gone = stage(near_groups(docs, id_col, text_col).filter("not kept").select(F.col(id_col).alias("_gone")).distinct(), "near-copies", n=F.count(F.lit(1)))
    # only rows that may go meet the list of those that do
    marked = _marked(docs[id_col], out, gone["n"])
    unsure = docs.join(*marked, "left_semi")
    return docs.join(*marked, "left_anti").union(unsure.join(out, docs[id_col] == out["_gone"], "left_anti"))
