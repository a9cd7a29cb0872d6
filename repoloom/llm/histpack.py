"""Shortest-pack-first packing over the histogram of lengths.

Texts become token ids with a closing id. Of a document longer than
``capacity``, whole stretches of ``capacity`` are cut off; what remains is one
piece. Only the histogram of piece lengths (at most ``capacity`` numbers,
whatever the input) goes to the driver. There lengths are placed longest
first, each into the shortest packs that have room; packs of equal content
stand as one row with a count, so the plan is bounded too. Then the gaps are
closed: the shortest packs are dissolved, and the run of their documents is
cut along the gaps of all others. What is left over, less than
``capacity``, goes to one sequence for each power of two in its length; those
need no padding either, so that there is none at all, and only the dissolved
documents, a small share, are cut more than their length asks for.

The plan joins the pieces by length and rank among the pieces of a length.
Ranks come from counts per length and hash slice, so that no length gathers in
one task. Token ids stay in the staged table; only those of lengths that the
plan cuts travel with their rows.

Defined cases: null text is empty: only the closing id. Repeated rows are
packed each. Null ids pass through; ids are numbers. Of pieces of equal length
those of smaller slice, id and start rank first. An empty table gives no
pieces. Only the two named columns of the input are read.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from repoloom.llm import tokens
from repoloom.runtime import stage

CAPACITY = 4096
#: Pieces of one length and slice, about; sets how many slices a length has.
SLICE_ROWS = 20_000
#: Ids pass Python as text, since pandas turns numbers with nulls among them into floats.
PIECE_SCHEMA = "id string, start long, length int, doc_tokens long, ids_crc32 long, ids binary"
PLACED_SCHEMA = "id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _cutter(path: str, closing_id: int, capacity: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        closing = np.array([closing_id], dtype="<u4").tobytes()
        for batch in batches:
            owners = iter(batch["id"])
            for texts in tokens.parts([t or "" for t in batch["text"]]):
                rows = []
                for ids, own in zip(tokens.encoder(path).encode(texts), owners):  # the last part ends both
                    ids += closing
                    for at in range(0, len(ids), 4 * capacity):
                        piece = ids[at : at + 4 * capacity]
                        rows.append((own, at // 4, len(piece) // 4, len(ids) // 4, zlib.crc32(piece), piece))
                yield pd.DataFrame(rows, columns=["id", "start", "length", "doc_tokens", "ids_crc32", "ids"])

    return cut


def document_pieces(
    docs: DataFrame, tokenizer_path: str, closing_id: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``id, start, length, doc_tokens, ids_crc32, ids``: stretches of ``capacity`` and the rest of every document."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(_cutter(tokenizer_path, closing_id, capacity), PIECE_SCHEMA).withColumn("id", F.col("id").cast("long"))


# --- plan over the histogram -------------------------------------------------


@dataclass
class Packs:
    """``count`` packs of equal content.

    ``content`` is a chain (content before, length, rank, offset); the pieces of
    pack k have the noted ranks plus ``first + k``. So a split shares the chain.
    """

    count: int
    room: int
    first: int = 0
    content: tuple | None = None

    def split(self, n: int) -> tuple[Packs, Packs]:
        """The first ``n`` packs and the others."""
        return Packs(n, self.room, self.first, self.content), Packs(self.count - n, self.room, self.first + n, self.content)

    def add(self, length: int, rank: int, offset: int) -> Packs:
        """Each pack gets a piece of ``length``, the first one that of ``rank``."""
        return Packs(self.count, self.room - length, self.first, (self.content, length, rank - self.first, offset))

    def slots(self) -> Iterator[tuple[int, int, int]]:
        """Length, rank of the first pack's piece, and offset of every piece."""
        at = self.content
        while at:
            at, length, rank, offset = at
            yield length, rank + self.first, offset


def shortest_pack_first(counts: dict[int, int], capacity: int = CAPACITY) -> list[Packs]:
    """Packs for ``counts`` (number of pieces by length), lengths longest first, each into the shortest packs with room.

    Where none has room, new packs open: one for each piece, but not more than
    the tokens still to place will fill, unless the pieces need them.
    """
    by_room: dict[int, list[Packs]] = defaultdict(list)
    rooms: list[int] = []
    free, tokens_left = 0, sum(length * n for length, n in counts.items())

    def put(packs: Packs) -> None:
        if packs.count:
            if not by_room[packs.room]:
                bisect.insort(rooms, packs.room)
            by_room[packs.room].append(packs)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            if not rooms or rooms[-1] < length:
                needed = max(-(-left // (capacity // length)), -(-(tokens_left - free) // capacity))
                opened = min(left, needed)
                put(Packs(opened, capacity))
                free += opened * capacity
            found = by_room[rooms[-1]].pop()
            if not by_room[found.room]:
                rooms.pop()
            taken, rest = found.split(min(found.count, left))
            put(rest)
            put(taken.add(length, rank, capacity - taken.room))
            rank += taken.count
            left -= taken.count
            free -= taken.count * length
            tokens_left -= taken.count * length
    return [p for room in rooms for p in by_room[room]]


@dataclass
class Plan:
    """Where pieces go, by (length, first rank); and the gaps that the dissolved ones run along.

    ``keys`` (length * 2^40 + rank) ascend. A kept piece has the sequence of
    its first rank and an offset; a dissolved one, marked by offset -1, has its
    place on the run instead. Gaps stand in groups of equal ``size`` from
    ``base`` on the run.
    """

    keys: np.ndarray
    ranks: np.ndarray
    places: np.ndarray
    offsets: np.ndarray
    gap_base: np.ndarray
    gap_size: np.ndarray
    gap_sequence: np.ndarray
    gap_offset: np.ndarray

    @property
    def cut_lengths(self) -> list[int]:
        """Lengths of which some pieces are dissolved."""
        return sorted(set((self.keys[self.offsets < 0] >> 40).tolist()))


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    packs = shortest_pack_first(counts, capacity)
    gaps = sum(p.count * p.room for p in packs)
    kept, dissolved = sorted((p for p in packs if p.count), key=lambda p: p.room), []
    loose = 0
    # dissolve the shortest packs until what they hold fills the gaps of the others
    while kept and loose < gaps:
        last = kept.pop()
        need = -(-(gaps - loose) // capacity)  # each takes its room from the gaps and adds its content
        stay, go = last.split(last.count - min(need, last.count))
        loose += go.count * (capacity - go.room)
        gaps -= go.count * go.room
        dissolved.append(go)
        if stay.count:
            kept.append(stay)
    rows, groups, sequence, at = [], [], 0, 0
    for p in kept:
        rows += [(length, rank, sequence, offset) for length, rank, offset in p.slots()]
        if p.room:
            groups.append((at, p.room, sequence, capacity - p.room))
            at += p.count * p.room
        sequence += p.count
    run = 0
    for p in dissolved:
        for length, rank, _ in p.slots():
            rows.append((length, rank, run, -1))
            run += p.count * length
    over = run - at
    for bit in reversed(range(capacity.bit_length())):  # less than a sequence is over
        if over >> bit & 1:
            groups.append((at, 1 << bit, sequence, 0))
            sequence, at = sequence + 1, at + (1 << bit)
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 4)
    gap = np.array(groups, dtype=np.int64).reshape(-1, 4)
    return Plan((table[:, 0] << 40) + table[:, 1], table[:, 1], table[:, 2], table[:, 3], *gap.T)


def _fragments(plan: Plan, at: int, length: int) -> Iterator[tuple[int, int, int, int]]:
    """``(skipped, length, sequence, offset)`` of a dissolved piece that lies from ``at`` on the run."""
    done = 0
    while done < length:
        g = int(np.searchsorted(plan.gap_base, at + done, side="right")) - 1
        size = int(plan.gap_size[g])
        nth, inside = divmod(at + done - int(plan.gap_base[g]), size)
        n = min(length - done, size - inside)
        yield done, n, int(plan.gap_sequence[g]) + nth, int(plan.gap_offset[g]) + inside
        done += n


def _placer(shared) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    columns = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan: Plan = shared.value
        for batch in batches:
            length, rank = batch["length"].to_numpy("int64"), batch["rank"].to_numpy("int64")
            row = np.searchsorted(plan.keys, (length << 40) + rank, side="right") - 1
            place, nth = plan.places[row], rank - plan.ranks[row]
            whole = plan.offsets[row] >= 0
            kept = batch.assign(sequence_id=place + nth, offset=plan.offsets[row])[whole]
            yield kept[columns]
            cut = []
            for i in np.flatnonzero(~whole):
                own, ids = batch.iloc[i], batch["ids"].iloc[i]
                for skip, n, sequence, offset in _fragments(plan, int(place[i] + nth[i] * length[i]), int(length[i])):
                    cut.append((own["id"], int(own["start"]) + skip, n, zlib.crc32(ids[4 * skip : 4 * (skip + n)]), int(own["doc_tokens"]), sequence, offset))
            if cut:
                yield pd.DataFrame(cut, columns=columns)

    return place


def pack(pieces: DataFrame, capacity: int = CAPACITY, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` for staged ``pieces``, gaps closed by cuts."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_packing(counts, capacity)
    shared = pieces.sparkSession.sparkContext.broadcast(plan)
    slices = max(64, -(-max(counts.values(), default=1) // slice_rows))
    rows = pieces.select(
        "id", "start", "length", "doc_tokens", "ids_crc32", F.when(F.col("length").isin(plan.cut_lengths), F.col("ids")).alias("ids"),
        F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(slices)).alias("slice"))
    before = W.partitionBy("length").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        pieces.groupBy("length", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(slices)).alias("slice")).agg(F.count(F.lit(1)).alias("n"))
        .select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    inside = F.row_number().over(W.partitionBy("length", "slice").orderBy("id", "start", "ids_crc32")) - 1
    ranked = rows.withColumn("inside", inside).join(starts, ["length", "slice"])
    ranked = ranked.select(
        F.col("id").cast("string").alias("id"), "start", "length", "doc_tokens", "ids_crc32", "ids", (F.col("base") + F.col("inside")).alias("rank"))
    return ranked.mapInPandas(_placer(shared), PLACED_SCHEMA).withColumn("id", F.col("id").cast("long"))


def pack_documents(
    docs: DataFrame, tokenizer_path: str, closing_id: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents with their sequence and offset there; see :func:`pack`."""
    pieces, _ = stage(document_pieces(docs, tokenizer_path, closing_id, capacity, id_col, text_col), "histogram-pieces")
    return pack(pieces, capacity)
