"""Packing of token pieces into sequences of bounded length.

Texts become token ids, longer ones are cut into pieces, and only the
histogram of piece lengths (at most ``capacity`` numbers, whatever the input)
goes to the driver. There a configuration linear program over the histogram is
solved by multiplicative weights: lengths that the patterns so far cover
little get dear, a knapsack dynamic program finds the best pattern at these
prices, and repeats. The fractional solution is rounded down to whole
sequences; each keeps its pattern but for the smallest slot, and best fit on
exact lengths closes the sequences and packs what is left. Sequences of equal
content stand as one row with a count, so the plan is bounded too. It says,
per length and rank among the pieces of that length, which sequence and offset
a piece takes; ranks come from counts per length and hash slice, so that no
length gathers in one task.

Defined cases: null text is empty: only the closing id. Repeated rows are
packed each. Null ids pass through. An empty table gives no pieces.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from repoloom.llm import tokens

#: Id that closes every document.
CLOSING_ID = 1
SLICES = 1024
PIECE_SCHEMA = "id long, piece int, start long, length long, ids binary"


def _cutter(path: str, capacity: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        closing = np.array([CLOSING_ID], dtype="<u4").tobytes()
        for batch in batches:
            owners = iter(batch["id"])
            for texts in tokens.parts([t or "" for t in batch["text"]]):
                rows = []
                for ids, own in zip(tokens.encoder(path).encode(texts), owners):  # the last part ends both
                    ids += closing
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at : at + 4 * capacity]
                        rows.append((own, k, at // 4, len(piece) // 4, piece))
                out = pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids"])
                yield out.astype({"id": "Int64"})

    return cut


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, piece, start, length, ids``: the pieces of every document; ids as little-endian 32-bit numbers."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(_cutter(tokenizer_path, capacity), PIECE_SCHEMA)


# --- plan over the histogram -------------------------------------------------


def best_pattern(prices: np.ndarray, units: int) -> dict[int, int]:
    """The multiset of sizes (in units) of greatest price that fits: unbounded knapsack by size."""
    best, choice = np.zeros(units + 1), np.zeros(units + 1, dtype=np.int64)
    for c in range(1, units + 1):
        gains = best[c - 1 :: -1] + prices[1 : c + 1]  # size s leaves c - s
        at = int(np.argmax(gains))
        if gains[at] > best[c - 1]:
            best[c], choice[c] = gains[at], at + 1
        else:
            best[c], choice[c] = best[c - 1], 0
    pattern: dict[int, int] = defaultdict(int)
    c = units
    while c > 0:
        if choice[c]:
            pattern[int(choice[c])] += 1
            c -= int(choice[c])
        else:
            c -= 1
    return dict(pattern)


def solve_patterns(demand: np.ndarray, units: int, epsilon: float = 0.2, rounds: int = 1500) -> list[tuple[dict[int, int], float]]:
    """Fractional cover of ``demand`` (counts by size in units): patterns with their amounts.

    A pattern is added as often as its scarcest size allows; each size's weight
    falls with the share of its demand covered.
    """
    sizes = np.flatnonzero(demand)
    if not len(sizes):
        return []
    # long pieces start dear: they are hardest to place
    weight, covered = demand * (np.arange(units + 1) / units) ** 2, np.zeros(units + 1)
    amounts: dict[tuple, float] = defaultdict(float)
    goal = np.log(len(sizes) + 1) / epsilon**2
    for _ in range(rounds):
        prices = np.full(units + 1, -np.inf)
        open_sizes = sizes[covered[sizes] < goal]
        if not len(open_sizes):
            break
        prices[open_sizes] = weight[open_sizes] / demand[open_sizes]
        pattern = best_pattern(prices, units)
        step = min(demand[s] / n for s, n in pattern.items())
        amounts[tuple(sorted(pattern.items()))] += step
        for s, n in pattern.items():
            covered[s] += step * n / demand[s]
            weight[s] *= (1 - epsilon) ** (step * n / demand[s])
    scale = max(float(np.average(covered[sizes], weights=demand[sizes] * sizes)), 1e-9)
    return [(dict(p), a / scale) for p, a in sorted(amounts.items(), key=lambda x: -x[1])]


class Sequences:
    """Sequences by content: groups of (count, free room, slots (length, first rank)), packed by best fit."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.groups = capacity, []
        self.by_room: dict[int, list[tuple[int, list]]] = defaultdict(list)
        self.rooms: list[int] = []
        self.next_rank: dict[int, int] = defaultdict(int)

    def _put(self, count: int, room: int, slots: list) -> None:
        if count:
            if not self.by_room[room]:
                bisect.insort(self.rooms, room)
            self.by_room[room].append((count, slots))

    def _take(self, room: int) -> tuple[int, list]:
        got = self.by_room[room].pop()
        if not self.by_room[room]:
            self.rooms.remove(room)
        return got

    def _fill(self, count: int, room: int, slots: list, length: int, times: int) -> None:
        """``count`` sequences get ``times`` more pieces of ``length``."""
        slots = list(slots)
        for _ in range(times):
            slots.append((length, self.next_rank[length]))
            self.next_rank[length] += count
        self._put(count, room - times * length, slots)

    def open(self, count: int, lengths: list[int]) -> None:
        slots = []
        for s in lengths:
            slots.append((s, self.next_rank[s]))
            self.next_rank[s] += count
        self._put(count, self.capacity - sum(lengths), slots)

    def best_fit(self, length: int, count: int) -> None:
        while count:
            at = bisect.bisect_left(self.rooms, length)
            if at == len(self.rooms):
                times = self.capacity // length
                self._fill(count // times, self.capacity, [], length, times)
                if count % times:
                    self._fill(1, self.capacity, [], length, count % times)
                return
            room = self.rooms[at]
            n, slots = self._take(room)
            times = min(room // length, count)
            used = min(n, count // times)
            self._put(n - used, room, [(s, r + used) for s, r in slots])
            self._fill(used, room, slots, length, times)
            count -= used * times

    def table(self) -> pd.DataFrame:
        """``length, rank, sequence, offset``: pieces of this length from this rank on go to this sequence and the following."""
        rows, base = [], 0
        for room in sorted(self.by_room):
            for count, slots in self.by_room[room]:
                at = 0
                for length, rank in slots:
                    rows.append((length, rank, base, at))
                    at += length
                base += count
        return pd.DataFrame(rows, columns=["length", "rank", "sequence", "offset"]).sort_values(["length", "rank"], ignore_index=True)


def plan_packing(counts: dict[int, int], capacity: int = 4096, grain: int = 16) -> pd.DataFrame:
    """Where the pieces of each length go; ``grain`` is the unit of the linear program's sizes."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    units = capacity // grain
    sequences = Sequences(capacity)
    unit_of = -(-np.arange(capacity + 1) // grain)
    unit_of[unit_of > units] = 0  # too long for a whole number of units: best fit takes it
    demand = np.bincount(unit_of, weights=left, minlength=units + 1).astype(np.int64)
    # short pieces close gaps best: up to a tenth of all tokens is left to best fit
    share = np.cumsum(left * np.arange(capacity + 1))
    small = min(capacity // 8, int(np.searchsorted(share, share[-1] / 10)))
    demand[: small // grain] = 0
    demand[0] = 0
    pools = {u: [int(s) for s in np.flatnonzero((unit_of == u) & (left > 0))] for u in range(1, units + 1)}
    for pattern, amount in solve_patterns(demand.astype(float), units):
        whole = min([int(amount), *(int(demand[u]) // n for u, n in pattern.items())])
        slots = sorted((u for u, n in pattern.items() for _ in range(n)), reverse=True)
        slots = slots[:-1] if len(slots) > 1 else slots
        while whole > 0:
            lengths, used = [], defaultdict(int)
            for u in slots:
                # the longest piece of this size that is left, counting those this sequence took
                s = next((x for x in reversed(pools[u]) if left[x] > used[x]), None)
                if s is None:
                    break
                lengths.append(s)
                used[s] += 1
            if len(lengths) < len(slots):
                break
            alike = min([whole, *(int(left[s]) // n for s, n in used.items())])
            sequences.open(alike, lengths)
            for s, n in used.items():
                left[s] -= alike * n
                demand[unit_of[s]] -= alike * n
                while pools[unit_of[s]] and left[pools[unit_of[s]][-1]] == 0:
                    pools[unit_of[s]].pop()
            whole -= alike
    for length in range(capacity, 0, -1):
        if left[length]:
            sequences.best_fit(length, int(left[length]))
    return sequences.table()


def pack(pieces: DataFrame, capacity: int = 4096, slices: int = SLICES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to staged ``pieces`` (id, piece, length and any more columns)."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_packing(counts, capacity)
    shared = pieces.sparkSession.sparkContext.broadcast(
        (plan["length"].to_numpy("int64") * (1 << 40) + plan["rank"].to_numpy("int64"), plan["rank"].to_numpy("int64"), plan["sequence"].to_numpy("int64"), plan["offset"].to_numpy("int64")))
    rows = pieces.withColumn("_slice", F.pmod(F.xxhash64("id", "piece"), F.lit(slices)))
    before = W.partitionBy("length").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy("length", "_slice").agg(F.count(F.lit(1)).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(W.partitionBy("length", "_slice").orderBy("id", "piece")) - 1
    ranked = rows.withColumn("_in", inside).join(starts, ["length", "_slice"]).withColumn("_rank", F.col("_base") + F.col("_in"))
    return ranked.withColumn("_place", _placer(shared)("length", "_rank")).select(
        *pieces.columns, F.col("_place.sequence_id").alias("sequence_id"), F.col("_place.offset").alias("offset"))


def _placer(shared) -> Callable:
    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, first, sequence, offset = shared.value
        at = np.searchsorted(keys, length.to_numpy("int64") * (1 << 40) + rank.to_numpy("int64"), side="right") - 1
        return pd.DataFrame({"sequence_id": sequence[at] + rank.to_numpy("int64") - first[at], "offset": offset[at]})

    return place
