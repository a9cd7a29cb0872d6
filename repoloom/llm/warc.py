"""WARC archives: written by the partition, read back through an index.

``write_archives`` writes one archive per task into a shared folder and
returns the index: file, offset, length, URL and payload digest per record.
Each record is a gzip member of its own, as WARC archives are commonly kept,
so any record can be read alone. An attempt writes under a name of its own
and the index is committed by Spark, so a lost executor leaves at most a file
that no index row names. ``read_records`` starts from index rows: it sorts the
selected ones per file, coalesces neighbours into ranges of bounded size, deals
the ranges over tasks by bytes, and reads each range once.

Of records with equal payloads of at least ``least_bytes`` the one with the
largest id is the response; the others become revisit records that name it.

Defined cases: a null payload is empty. A row without an id is always a
response, as nothing can refer to it. Repeated rows that hold the largest id
are responses each. Null URLs are left out of the header and read back as
null. Control characters in URLs are percent-encoded. An empty table gives an
empty index.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
import math
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from repoloom.runtime import stage, stage_root

#: Fixed values of the WARC 1.1 format.
CRLF = b"\r\n"
END = b"\r\n\r\n"
VERSION = b"WARC/1.1"
GZIP_LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX_SCHEMA = "file string, offset long, length long, url string, payload_digest string"
RECORD_SCHEMA = "file string, offset long, id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def mark_revisits(pages: DataFrame, id_col: str, payload_col: str, least_bytes: int = 1000) -> DataFrame:
    """``id, url?, payload, refers_to``: refers_to is null for responses.

    Rows group by SHA-256 and length of the payload. The group's largest id is
    pre-aggregated. Groups above a thousandth of all grouped rows, fewer than
    a thousand by that, are broadcast; their rows and the ungrouped ones are
    spread over all tasks in the join that the remaining groups need.
    """
    rows = pages.withColumn("_payload", F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8"))
    rows = rows.withColumn("_key", F.when(F.octet_length("_payload") >= least_bytes, F.sha2("_payload", 256)))
    counted = rows.filter("_key is not null").groupBy("_key").agg(F.max(id_col).alias("_last"), F.count(F.lit(1)).alias("_n"))
    groups, found = stage(counted.filter("_n > 1"), "copies", n=F.sum("_n"))
    hot = F.col("_n") * 1000 > F.lit(found["n"] or 0)
    most = F.broadcast(groups.filter(hot).select("_key", F.col("_last").alias("_hot_last")))
    rows = rows.join(most, "_key", "left").withColumn(
        "_key", F.when(F.col("_key").isNull() | F.col("_hot_last").isNotNull(), F.concat(F.lit("#"), F.xxhash64(id_col, "_payload").cast("string")))
        .otherwise(F.col("_key")))
    last = F.coalesce("_hot_last", "_last")
    return rows.join(groups.filter(~hot).select("_key", "_last"), "_key", "left").withColumn(
        "_refers", F.when(F.col(id_col) < last, last)).drop("_key", "_last", "_hot_last")


def _header(fields: list[tuple[str, object]]) -> bytes:
    return VERSION + CRLF + b"".join(f"{k}: {v}".encode() + CRLF for k, v in fields if v is not None) + CRLF


def _name(row_id: object) -> str:
    return f"<urn:uuid:{uuid.uuid4()}>" if pd.isna(row_id) else f"<urn:page:{int(row_id)}>"


def encode_record(row_id: object, url: str | None, payload: bytes, refers_to: object, date: str) -> tuple[bytes, str]:
    """The bytes of one record, closing line breaks included, and its payload digest."""
    sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    revisit = not pd.isna(refers_to)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = _header([
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _name(row_id)), ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else quote(url, safe="%/:=&?~#+!$,;'@()*[]")),
        ("WARC-Payload-Digest", f"sha1:{sha}"), ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", _name(refers_to) if revisit else None),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block)),
    ])
    return gzip.compress(head + block + END, GZIP_LEVEL, mtime=0), sha


def decode_record(data: bytes) -> tuple:
    """id, URL, type, referred id, bare hexadecimal digest, payload length and payload of one record."""
    head, _, rest = gzip.decompress(data).partition(END)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(END)
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    number = lambda name: int(name[10:-1]) if name and name.startswith("<urn:page:") else None
    kind = fields["WARC-Type"]
    sha = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    if kind == "response" and (hashlib.sha1(payload).digest() != sha or len(payload) != size):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return (number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind, number(fields.get("WARC-Refers-To")),
            sha.hex(), size, payload if kind == "response" else None)


def _writer(folder: str, date: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        first = next(batches, None)
        if first is None:
            return
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        with store.open_output_stream(f"{base}/{name}", compression=None) as out:
            at = 0
            for batch in itertools.chain([first], batches):
                rows = []
                for row in batch.itertuples(index=False):
                    url = None if pd.isna(row.url) else row.url
                    data, sha = encode_record(row.id, url, row.payload, row.refers_to, date)
                    out.write(data)
                    rows.append((f"{folder}/{name}", at, len(data), url, sha))
                    at += len(data)
                yield pd.DataFrame(rows, columns=["file", "offset", "length", "url", "payload_digest"])

    return write


def write_archives(
    pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    least_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write the archives below ``folder`` (default: the shared folder) and return the committed index."""
    spark = pages.sparkSession
    folder = folder or f"{stage_root(spark)}/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
    rows = mark_revisits(pages, id_col, payload_col, least_bytes).select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col("_payload").alias("payload"), F.col("_refers").alias("refers_to"))
    return stage(rows.mapInPandas(_writer(folder, date), INDEX_SCHEMA), "warc-index")[0]


def byte_ranges(index: DataFrame, gap: int = 1 << 16, most: int = 8 << 20) -> DataFrame:
    """Ranges to read: ``file, start, stop, records``; neighbours closer than ``gap`` share one of about ``most`` bytes."""
    in_file = W.partitionBy("file").orderBy("offset")
    before = F.lag(F.col("offset") + F.col("length")).over(in_file)
    new = before.isNull() | (F.col("offset") - before > gap) | (F.floor(F.col("offset") / most) != F.floor(F.lag("offset").over(in_file) / most))
    return (
        index.select("file", "offset", "length").withColumn("_new", new.cast("int")).withColumn("_range", F.sum("_new").over(in_file))
        .groupBy("file", "_range")
        .agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"),
             F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records"))
        .select("file", "start", "stop", "records")
    )


def _reader(keep_payload: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for r in batch.itertuples(index=False):
                store, path = fs.FileSystem.from_uri(r.file)
                with store.open_input_file(path) as source:
                    source.seek(r.start)
                    data = source.read(r.stop - r.start)
                rows = []
                for rec in r.records:
                    a = rec["offset"] - r.start
                    got = decode_record(data[a : a + rec["length"]])
                    rows.append((r.file, rec["offset"], *got[:-1], got[-1] if keep_payload else None))
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD_SCHEMA.split(", ")])
                yield out.astype({"id": "Int64", "refers_to": "Int64"})

    return read


def read_records(
    spark: SparkSession, selected: DataFrame, gap: int = 1 << 16, most: int = 8 << 20, keep_payload: bool = True, task_bytes: int = 64 << 20,
) -> DataFrame:
    """The records that the index rows ``selected`` name, each range of bytes read once, about ``task_bytes`` a task.

    Index rows are small beside what they point to, so the ranges are dealt by the bytes to read.
    """
    total = selected.agg(F.sum("length")).first()[0] or 0
    ranges = byte_ranges(selected, gap, most).repartition(max(1, math.ceil(total / task_bytes)), "file", "start")
    return ranges.mapInPandas(_reader(keep_payload), RECORD_SCHEMA)
