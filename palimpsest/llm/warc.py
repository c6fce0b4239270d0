"""WARC archives: written with revisit records for repeated payloads, read by boundary chains.

Reading does not trust the magic ``WARC/1.0``: a payload may contain it.  Tasks emit every
offset at which a record could begin together with the offset at which its successor would
begin by its own Content-Length; pointer jumping from the start of each file keeps the
offsets that the chain reaches, and all others are rejected.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, few_rows, table, text_of

MAGIC = b"WARC/1.0\r\n"
END = "\r\n\r\n"
#: Payloads from this size on are stored once and revisited.
MIN_REVISIT = 1000
#: An archive file is rotated at this many records; files bound what a reading task holds.
RECORDS_PER_FILE = 4096
#: Repeated payloads that are told to all tasks at most.
BROADCAST_ROWS = 100_000

RECORD_SCHEMA = "path string, offset long, successor long, record_id long, uri string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def plan_records(ws: Workspace, pages: DataFrame, *, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, refers_to`` for each row.

    ``refers_to`` is null for a response.  Of equal payloads of ``min_revisit`` bytes or
    more, the rows with the largest page_id are responses (all of them, if it repeats) and
    the rest revisit it.
    """
    page = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        text_of("html").alias("payload"),
    )
    page = page.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    page = page.withColumn("payload_digest", F.sha1(F.col("payload").cast("binary")))
    # equal SHA-1 and SHA-256 stand for equal payloads; the partial maxima make hot groups small
    same = F.concat("payload_digest", F.sha2(F.col("payload").cast("binary"), 256))
    large = page.where(F.col("payload_bytes") >= min_revisit)
    owners = large.groupBy(same.alias("_same")).agg(F.max("page_id").alias("_owner"), F.count("*").alias("_n"))
    owners = owners.where("_n > 1 and _owner is not null").drop("_n")
    owners = ws.save(owners, "owners")
    keyed = page.withColumn("_same", F.when(F.col("payload_bytes") >= min_revisit, same))
    # payloads stay where they are if the repeated ones are few, else both sides are shuffled
    joined = keyed.join(F.broadcast(owners) if few_rows(owners, BROADCAST_ROWS) else owners, "_same", "left")
    return joined.withColumn("refers_to", F.when(~F.col("_owner").eqNullSafe(F.col("page_id")), F.col("_owner"))).drop("_same", "_owner")


def _name(column: str):
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(column).cast("string"), F.lit("null")), F.lit(">"))


def write_warc(pages: DataFrame, path: str, *, min_revisit: int = MIN_REVISIT) -> None:
    """Writes a record for each row of ``pages(page_id, url, html)`` into WARC files at ``path``.

    A null html is an empty payload, a null url an empty target; line ends in a url are
    percent-encoded.  A null page_id is written as such.  Other columns are ignored.
    """
    planned = plan_records(Workspace(pages.sparkSession, "warc-plan"), pages, min_revisit=min_revisit)
    uri = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    stored = F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), _name("page_id"),
        F.lit("\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: "), _name("refers_to"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), (F.octet_length(http) + stored).cast("string"),
        F.lit(END),
    )
    record = F.concat(head, http, F.when(revisit, "").otherwise(F.col("payload")))
    planned.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "none").text(path)


_FIELD = re.compile(rb"\r\n(WARC-Type|WARC-Record-ID|WARC-Target-URI|WARC-Payload-Digest|WARC-Refers-To|Content-Length): ?([^\r\n]*)")
_LENGTH = re.compile(rb"\r\nContent-Length: ?(\d+)", re.I)


def _number(name: bytes | None) -> int | None:
    m = re.fullmatch(rb"<urn:page:(-?\d+)>", name or b"")
    return int(m[1]) if m else None


def _candidate(data, at: int):
    """What the bytes at ``at`` say if a record begins there; None if they can't be one."""
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        return None
    head = dict(reversed(_FIELD.findall(data[at:stop])))  # the first of a field counts
    length = head.get(b"Content-Length", b"")
    if not length.isdigit():
        return None
    body = stop + 4
    after = body + int(length) + 4
    if after > len(data) or data[after - 4 : after] != b"\r\n\r\n":
        return None
    split = data.find(b"\r\n\r\n", body, after - 4)
    http = data[body:split] if split >= 0 else b""
    payload = data[split + 4 : after - 4] if split >= 0 else data[body : after - 4]
    kind = head.get(b"WARC-Type", b"").decode("latin1")
    digest = head.get(b"WARC-Payload-Digest", b"").removeprefix(b"sha1:").decode("latin1")
    if kind == "revisit":
        m = _LENGTH.search(http)
        size = int(m[1]) if m else None
    else:
        size, stated, digest = len(payload), digest, hashlib.sha1(payload).hexdigest()
        if stated and stated != digest:
            kind = "damaged"
    return after, _number(head.get(b"WARC-Record-ID")), head.get(b"WARC-Target-URI", b"").decode("utf-8", "replace"), size, digest, kind, _number(head.get(b"WARC-Refers-To"))


_ARROW = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("successor", pa.int64()), ("record_id", pa.int64()), ("uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, scalar in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = scalar.as_py()
            rows, at = [(path, len(data), len(data), None, None, None, None, "end", None)], data.find(MAGIC)
            while at >= 0:
                if found := _candidate(data, at):
                    rows.append((path, at, *found))
                at = data.find(MAGIC, at + 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def reached(offsets: np.ndarray, successors: np.ndarray) -> np.ndarray:
    """Which of the ascending ``offsets`` the chain from 0 reaches, by pointer jumping.

    Each round the set of reached offsets doubles along jumps twice as long.  The last
    offset is the end of the file, its own successor; what points at no offset goes no further.
    """
    last = len(offsets) - 1
    jump = np.searchsorted(offsets, successors)
    jump = np.where((jump <= last) & (offsets[np.minimum(jump, last)] == successors), jump, np.arange(last + 1))
    seen = np.zeros(len(offsets), bool)
    seen[0] = offsets[0] == 0
    while True:
        now = seen.copy()
        now[jump[seen]] = True
        if (now == seen).all():
            return seen
        seen, jump = now, jump[jump]


def _chain(pdf):
    pdf = pdf.sort_values("offset", kind="stable").reset_index(drop=True)
    seen = reached(pdf["offset"].to_numpy(), pdf["successor"].to_numpy())
    ends = pdf.loc[seen & (pdf["record_type"] == "end").to_numpy()]
    if len(pdf) > 1 and ends.empty or (pdf["record_type"].iloc[0] == "end" and pdf["offset"].iloc[0] > 0):
        raise ValueError(f"{pdf['path'].iloc[0]}: the chain of records breaks off before the end of the file")
    out = pdf.loc[seen & (pdf["record_type"] != "end").to_numpy()]
    if (out["record_type"] == "damaged").any():
        raise ValueError(f"{pdf['path'].iloc[0]}: a payload differs from its digest")
    return out


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files at ``path``, one row each, as in ``RECORD_SCHEMA``.

    A file whose chain breaks off, or a payload that its stated digest denies, is an error.
    Empty files have no records.  A task holds one file at a time, so archives should be
    rotated, as those of ``write_warc`` are.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content").where(F.length("content") > 0)
    found = files.mapInArrow(_candidates, RECORD_SCHEMA)
    return found.groupBy("path").applyInPandas(_chain, RECORD_SCHEMA)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Workspace(spark, 'warc').path}/archive"
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, strlen(h)::bigint as payload_bytes, sha1(h) as payload_digest,
             case when strlen(h) >= 1000 then max(page_id) over (partition by h) else page_id end as owner from p)
select page_id, payload_bytes, payload_digest,
       case when owner = page_id then 'response' else 'revisit' end as record_type,
       case when owner <> page_id then owner end as refers_to
from d
"""
