"""Incremental secret scan over a ledger of content-addressed blobs.

A table of versions (any columns, one of them the text) is reduced to blobs by
SHA-256. The ledger has a row for each scan of a blob with the versions of the
rules that were run over it and the spans found, also where there are none. Only the
missing pairs of blob and rule version are scanned, each once, however many
paths or versions hold the blob; the findings then join back to every row by
blob. Run again after a commit, the scan costs the new blobs only; after a
change of one rule it runs that rule alone.

Defined cases: null text is the empty blob. Repeated rows each get their
findings, as do rows without an id. An empty table gives empty results. Very
long texts are scanned whole. Other columns are not looked at, whatever their
names. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoloom.runtime import stage


class Rule(NamedTuple):
    """A kind of secret; raise ``version`` with any change, and all blobs are scanned for it again."""

    kind: str
    version: int
    pattern: re.Pattern
    group: int  # whose length, from the start of the match to its end, counts
    least: int

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [(m.start(), m.end()) for m in self.pattern.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


#: Letters of the assignment's names match in either case.
RULES = [
    Rule("assign", 1, re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 12),
    Rule("access", 1, re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    # a run of 16 or more is the same as a run of any length that is then measured
    Rule("hex", 1, re.compile(r"[0-9a-f]{16,}"), 0, 16),
]
LEDGER_SCHEMA = "blob string, found array<struct<rule:string,spans:array<struct<start:int,end:int>>>>"
#: Blobs above this share of all rows are joined by broadcast, so fewer than this many, below so many bytes of spans.
HOT_BLOBS, HOT_BYTES = 1000, 16 << 20


def _scan(rules: list[Rule]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    by_name = {rule.name: rule for rule in rules}

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (blob, [{"rule": name, "spans": [{"start": a, "end": b} for a, b in by_name[name].spans(text)]} for name in lacking])
                for blob, text, lacking in zip(batch["blob"], batch["text"], batch["lacking"], strict=True)
            ]
            yield pd.DataFrame(rows, columns=["blob", "found"])

    return scan


def _findings(found: DataFrame, rules: list[Rule]) -> DataFrame:
    """``found`` of a blob as a count per kind and ``spans`` (kind:start:end, by start, then by the order of the rules)."""
    kinds, names = (F.array(*map(F.lit, part)) for part in zip(*[(rule.kind, rule.name) for rule in rules], strict=True))

    def ranked(one):
        return F.transform(one["spans"], lambda s: F.struct(s["start"].alias("start"), F.array_position(names, one["rule"]).cast("int").alias("rank"), s["end"].alias("end")))

    placed = found.withColumn("placed", F.array_sort(F.flatten(F.transform("found", ranked)))).drop("found")
    for rank, rule in enumerate(rules, 1):
        placed = placed.withColumn(f"n_{rule.kind}", F.expr(f"cast(size(filter(placed, s -> s.rank = {rank})) AS long)"))
    said = F.transform("placed", lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"]), s["start"], s["end"]))
    return placed.withColumn("spans", F.array_join(said, ",")).drop("placed")


def scan_versions(
    versions: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] = RULES,
) -> tuple[DataFrame, DataFrame]:
    """Scan what ``ledger`` lacks.

    Returns the findings per row (id, blob, counts per kind, ``spans``) and the
    new ledger rows (``LEDGER_SCHEMA``), to be appended to the ledger.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    paths, all_ = stage(versions.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("blob")), "blob-paths", n=F.count(F.lit(1)))
    large = F.count(F.lit(1)) * HOT_BLOBS > all_["n"]
    blobs = paths.groupBy("blob").agg(F.min("id").alias("at"), large.alias("hot"))
    names = F.array(*[F.lit(rule.name) for rule in rules])
    none = F.from_json(F.lit("[]"), LEDGER_SCHEMA.split(" ", 3)[3])
    if ledger is None:
        blobs = blobs.withColumn("had", none)
    else:
        scans = F.array_distinct(F.flatten(F.collect_list("found")))
        seen = ledger.groupBy("blob").agg(F.filter(scans, lambda one: F.array_contains(names, one["rule"])).alias("had"))
        blobs = blobs.join(seen, "blob", "left").withColumn("had", F.coalesce("had", none))
    blobs, _ = stage(blobs.withColumn("lacking", F.array_except(names, F.col("had.rule"))), "blobs")
    todo = blobs.filter(F.size("lacking") > 0).select("blob", "at", "lacking")
    # the text travels once, to the row chosen for its blob
    texts = versions.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("blob", F.sha2("text", 256))
    chosen = (texts["blob"] == todo["blob"]) & texts["id"].eqNullSafe(todo["at"])
    scanned = texts.join(todo, chosen).select(texts["blob"], "text", "lacking").mapInPandas(_scan(rules), LEDGER_SCHEMA)
    fresh, _ = stage(scanned.dropDuplicates(["blob"]), "blob-findings")
    found = blobs.join(fresh, "blob", "left").select("blob", "hot", F.concat("had", F.coalesce("found", none)).alias("found"))
    found, hot = stage(_findings(found, rules), "findings", bytes=F.sum(F.when(F.col("hot"), F.length("spans")).otherwise(0)))
    if (hot["bytes"] or 0) > HOT_BYTES:
        joined = paths.join(found.drop("hot"), "blob")
    else:
        few = F.broadcast(found.filter("hot").drop("hot"))
        rest = paths.join(few.select("blob"), "blob", "left_anti").join(found.filter("not hot").drop("hot"), "blob")
        joined = paths.join(few, "blob").unionByName(rest)
    return joined.withColumnRenamed("id", id_col), fresh
