"""Removal of repeated byte strings by blockwise suffix sorting.

Every start of a ``length``-byte string is a suffix to sort as far as ``length`` bytes; a
suffix that equals an earlier one is a repeat, and its bytes go.  Suffixes are sorted one
bucket at a time:

1. A string's *anchor* is the 32-byte substring with the least hash in it.  Equal strings
   have equal anchors at equal places, so buckets of anchors are closed.  Runs of suffixes
   with one anchor are one record: a hash of the anchor, one of the run's whole context.
2. An anchor that occurs once has no repeats.  Runs with equal contexts repeat the first.
   Only runs whose anchor has several contexts are compared by their bytes.
3. Their contexts make the text of a bucket, whose suffixes are sorted by their first and
   last bytes.  Longer ties are resolved by precomputed ranks of a difference-cover sample:
   for any two suffixes there is a shift below 7 at which both are in the sample, and the
   ranks there say whether the 91 bytes from the shift on are equal.

Memory is bounded by a bucket; anchors with very many contexts are split by a hash of
each whole string, which equal strings share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, bucket_count, few_rows, table, with_key

#: Bytes of the strings that must not repeat, and of their anchors.
LENGTH, ANCHOR = 100, 32
#: Bytes of text that are scanned at once; positions take its 18 bits.
CHUNK_BITS = 18
CHUNK = 1 << CHUNK_BITS
#: Anchor records a task holds before it hands them on; records in a bucket; contexts in a sorted bucket.
FLUSH, BUCKET, SORTED = 300_000, 250_000, 10_000
#: Records of a packed row that is compared with none and so goes to any bucket.
PASSED = 8192
#: Contexts of one anchor, in a task's flush and in a bucket, beyond which strings are dealt by their own hash.
LOCAL_HOT, HOT = 256, 20_000
#: Documents that are told to all tasks at most; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: A difference cover of the residues modulo PERIOD.
PERIOD, COVER = 7, (0, 1, 3)

_U = np.uint64
_M = 0x9E3779B97F4A7C15
_PACK = [("a", "<u8"), ("c", "<u8"), ("k", "<i8"), ("s", "<u4"), ("l", "u1"), ("n", "u1")]


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


@cache
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2^64, and a value for each byte."""

    def powers(m: int) -> np.ndarray:
        out = np.ones(1, _U)
        while len(out) < CHUNK + 1:
            out = np.concatenate([out, out * _U(pow(m, len(out), 1 << 64))])
        return out[: CHUNK + 1]

    return powers(_M), powers(pow(_M, -1, 1 << 64)), mix64(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[: len(v) - (w - size)], v[w - size :]) if w > size else v


def anchors(parts: list[bytes], length: int = LENGTH) -> dict[str, np.ndarray]:
    """Records of the runs of suffixes with one anchor, in texts of a chunk in all.

    ``a`` anchor hash, ``c`` context hash, ``i`` the text, ``s`` the run's first suffix in
    it, ``l`` how far the anchor is from there, ``n`` the run's number of suffixes.
    """
    power, inverse, of_byte = _powers()
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.cumsum(sizes) - sizes
    none = {x: np.empty(0, t) for x, t in [*_PACK, ("i", "<i8")]}
    if len(data) < length:
        return none
    prefix = np.zeros(len(data) + 1, _U)
    np.cumsum(of_byte[data] * power[: len(data)], dtype=_U, out=prefix[1:])
    n_grams = len(data) - ANCHOR + 1
    gram = mix64((prefix[ANCHOR:] - prefix[:n_grams]) * inverse[:n_grams])
    low = _U(CHUNK - 1)
    least = _sliding_min((gram & ~low) | np.arange(n_grams, dtype=_U), length - ANCHOR + 1)
    at = (least & low).astype(np.int64)
    room = np.repeat(starts + sizes, sizes)[: len(at)] - np.arange(len(at))
    first = np.flatnonzero(room >= length)
    if not len(first):
        return none
    at = at[first]
    run = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    n = np.diff(np.append(run, len(at)))
    first, at = first[run], at[run]
    lead = at - first
    context = (prefix[first + n - 1 + length] - prefix[first]) * inverse[first]
    context = mix64(context + lead.astype(_U) * _U(0xA0761D6478BD642F) + n.astype(_U) * _U(0xE7037ED1A0B428DB))
    text = np.searchsorted(starts, first, "right") - 1
    while (empty := sizes[text] == 0).any():  # empty texts share a start with the next
        text[empty] -= 1
    return {"a": gram[at], "c": context, "i": text, "s": first - starts[text], "l": lead.astype(np.uint8), "n": n.astype(np.uint8)}


def _repeated(values: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    ordered = np.sort(values)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return np.zeros(len(values), bool)
    return again[np.minimum(np.searchsorted(again, values), len(again) - 1)] == values


def _later_copies(r: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Masks of records to keep (one for each anchor and context) and of true repeats of those."""
    keep, later = np.ones(len(r["c"]), bool), np.zeros(len(r["c"]), bool)
    at = np.flatnonzero(_repeated(r["c"]))
    if len(at):
        at = at[np.lexsort((r["s"][at], r["k"][at], r["c"][at], r["a"][at]))]
        fresh = np.append(True, (r["a"][at][1:] != r["a"][at][:-1]) | (r["c"][at][1:] != r["c"][at][:-1]))
        head = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        keep[at[~fresh]] = False
        later[at] = (r["k"][at] != r["k"][head]) | (r["s"][at] != r["s"][head])
    return keep, later


def _context_counts(a: np.ndarray) -> np.ndarray:
    """For each record how many records its anchor has."""
    ordered = np.sort(a)
    return np.searchsorted(ordered, a, "right") - np.searchsorted(ordered, a, "left")


_SCAN = pa.schema([("kind", pa.int32()), ("bucket", pa.int32())] + [(x, pa.binary()) for x, _ in _PACK])
SCANNED = "kind int, bucket int, a binary, c binary, k binary, s binary, l binary, n binary"


def _scan(length: int, n_buckets: int):
    """Anchor records by bucket (kind 0), repeats seen within the task (1), runs of locally hot anchors (2).

    Only kind 0 is compared again, so only it goes by its anchor; ``n_buckets`` is a power of two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        total = 0

        def row(kind: int, r: dict, at, bucket) -> tuple:
            return (kind, int(bucket), *(np.ascontiguousarray(r[x][at], t).tobytes() for x, t in _PACK))

        def packed(r: dict):
            # the low bits: as the least hash of its window, an anchor's high bits are mostly 0
            bucket = (r["a"] & _U(n_buckets - 1)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            edge = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)[: len(order)])
            for lo, hi in zip(edge, [*edge[1:], len(order)], strict=True):
                yield row(0, r, order[lo:hi], bucket[order[lo]])

        def passed(kind: int, r: dict):
            for i in range(0, len(r["a"]), PASSED):
                spot = mix64(r["k"][i : i + 1].astype(_U) * _U(_M) + r["s"][i : i + 1])[0]
                yield row(kind, r, slice(i, i + PASSED), spot & _U(n_buckets - 1))

        def flush():
            r = {x: np.concatenate([h[x] for h in held]).astype(t) for x, t in _PACK}
            keep, later = _later_copies(r)
            sub = lambda m: {x: v[m] for x, v in r.items()}
            rows = list(passed(1, sub(later)))
            r = sub(keep)
            hot = _context_counts(r["a"]) >= LOCAL_HOT
            if hot.any():
                rows += passed(2, sub(hot))
                one = np.unique(r["a"][hot], return_index=True)[1]
                r["n"] = r["n"] | np.where(hot, np.uint8(128), np.uint8(0))  # tells the bucket
                send = ~hot
                send[np.flatnonzero(hot)[one]] = True
                r = sub(send)
            rows += packed(r)
            for i in range(0, len(rows), 256):
                part = rows[i : i + 256]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), _SCAN, strict=True)], schema=_SCAN)

        def take(parts, keys, offsets):
            r = anchors(parts, length)
            r["k"], r["s"] = np.array(keys, np.int64)[r["i"]], np.array(offsets, np.int64)[r["i"]] + r["s"]
            held.append(r)
            return len(r["a"])

        for batch in batches:
            parts, keys, offsets, size = [], [], [], 0
            for key, scalar in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                text = scalar.as_py()
                if len(text) < length:
                    continue
                for at in range(0, len(text) - length + 1, CHUNK - length + 1):
                    piece = text[at : at + CHUNK]
                    if size + len(piece) > CHUNK:
                        total += take(parts, keys, offsets)
                        parts, keys, offsets, size = [], [], [], 0
                        if total >= FLUSH:
                            yield from flush()
                            held, total = [], 0
                    parts.append(piece)
                    keys.append(key)
                    offsets.append(at)
                    size += len(piece)
            if parts:
                total += take(parts, keys, offsets)
        if held:
            yield from flush()

    return run


RESOLVED = "kind int, key long, grp long, at long, lead int, n int, hot boolean"


def _resolve(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: suffix runs that repeat an earlier one (kind 1), and runs to compare by bytes (2)."""

    def unpack(kind: int) -> dict:
        rows = pdf[pdf["kind"] == kind]
        return {x: np.frombuffer(b"".join(rows[x]), t) for x, t in _PACK}

    def frame(kind: int, r: dict, hot) -> pd.DataFrame:
        return pd.DataFrame({"kind": np.int32(kind), "key": r["k"], "grp": r["a"].astype(np.int64), "at": r["s"].astype(np.int64), "lead": r["l"].astype(np.int32), "n": r["n"].astype(np.int32), "hot": hot})

    out = [frame(1, unpack(1), False), frame(2, unpack(2), True)]
    r = unpack(0)
    sub = lambda m: {x: v[m] for x, v in r.items()}
    flagged = r["n"] >= 128
    hot_anchors = np.unique(r["a"][flagged])
    r = sub(_repeated(r["a"]) | np.isin(r["a"], hot_anchors))
    r["n"] = r["n"] & np.uint8(127)
    flagged = np.isin(r["a"], hot_anchors)
    # the records of hot anchors that tasks sent are among those of kind 2 or below
    keep, later = _later_copies(r)
    out.append(frame(1, sub(later), False))
    r, flagged = sub(keep), flagged[keep]
    counts = _context_counts(r["a"])
    hot = flagged | (counts > HOT)
    several = (counts > 1) | flagged
    out.append(frame(2, sub(several), hot[several]))
    return pd.concat([x for x in out if len(x)] or out[:1])


def _contexts(length: int, n_buckets: int):
    """The bytes of the runs that documents list; hot ones string by string."""
    schema = pa.schema([("bucket", pa.int32()), ("grp", pa.int64()), ("key", pa.int64()), ("at", pa.int64()), ("lead", pa.int32()), ("n", pa.int32()), ("context", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            rows = []
            for key, scalar, runs in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
                text = scalar.as_py()
                for x in runs.as_py():
                    grp, at, lead, n = x["grp"], x["at"], x["lead"], x["n"]
                    if not x["hot"]:
                        rows.append((grp % n_buckets, grp, key, at, lead, n, text[at : at + n - 1 + length]))
                        continue
                    for j in range(n):
                        string = text[at + j : at + j + length]
                        own = xxhash.xxh3_64_intdigest(string, seed=grp & (1 << 64) - 1) - (1 << 63)
                        rows.append((own % n_buckets, own, key, at + j, lead - j, 1, string))
                    if len(rows) > 50_000:
                        yield out(rows)
                        rows = []
            if rows:
                yield out(rows)

    return run


def _big_endian(text: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    value = np.zeros(len(at), _U)
    for j in range(n):
        value = (value << _U(8)) | text[at + j].astype(_U)
    return value


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks of rows by the given keys, equal for equal rows."""
    order = np.lexsort(keys[::-1])
    fresh = np.zeros(len(order), np.int64)
    for k in keys:
        fresh[1:] |= k[order][1:] != k[order][:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(fresh)
    return rank


def cover_ranks(text: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Rank of the 13 words of 7 bytes at each position of the cover sample; -1 elsewhere.

    Ranks of 7 bytes are doubled within the sample: it holds p + 7 with p.
    """
    span = (length - PERIOD - 2) // PERIOD * PERIOD
    where = np.flatnonzero(np.isin(np.arange(len(text)) % PERIOD, COVER))
    where = where[where + PERIOD <= len(text)]
    slot = np.full(len(text) + 1, -1, np.int64)
    slot[where] = np.arange(len(where))
    rank, width = _dense(_big_endian(text, where, PERIOD)), PERIOD

    def joined(rank, shift):
        to = np.minimum(where + shift, len(text))
        second = np.where(slot[to] >= 0, rank[slot[to]], -1)
        return _dense(rank, second)

    while width * 2 <= span:
        rank, width = joined(rank, width), width * 2
    if width < span:
        rank = joined(rank, span - width)
    out = np.full(len(text), -1, np.int64)
    out[where] = rank
    return out


#: The least shift that takes two residues into the cover.
SHIFT = np.array([[next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)])


def repeated_strings(contexts: list[bytes], grp: np.ndarray, key: np.ndarray, at: np.ndarray, lead: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes of a bucket's contexts repeat an earlier one: (context, offset) of each."""
    text = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    base, n = np.cumsum(sizes) - sizes, sizes - length + 1
    row = np.repeat(np.arange(len(contexts)), n)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    place = base[row] + offset
    anchor = mix64(grp.astype(_U)[row] + (lead[row] - offset).astype(_U) * _U(_M))
    head, near, tail = _big_endian(text, place, 8), _big_endian(text, place + length - 16, 8), _big_endian(text, place + length - 8, 8)
    order = np.lexsort((at[row] + offset, key[row], tail, near, head, anchor))
    fresh = np.ones(len(order), bool)
    fresh[1:] = False
    for k in (anchor, head, near, tail):
        fresh[1:] |= k[order][1:] != k[order][:-1]
    tie = np.cumsum(fresh) - 1
    tied = np.bincount(tie)[tie] > 1
    left, tie = order[tied], tie[tied]
    if not len(left):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    rank = cover_ranks(text, length)
    found = []
    while len(left):
        first = np.append(True, tie[1:] != tie[:-1])
        leader = left[np.maximum.accumulate(np.where(first, np.arange(len(left)), 0))]
        p, q = place[leader], place[left]
        shift = SHIFT[p % PERIOD, q % PERIOD]
        equal = rank[p + shift] == rank[q + shift]
        other = (key[row[left]] != key[row[leader]]) | (at[row[left]] + offset[left] != at[row[leader]] + offset[leader])
        found.append(left[equal & other])
        left, tie = left[~equal], tie[~equal]
    found = np.concatenate(found)
    return row[found], offset[found]


def _sort_bucket(length: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key, at = pdf["key"].to_numpy(), pdf["at"].to_numpy()
        row, offset = repeated_strings(list(pdf["context"]), pdf["grp"].to_numpy(), key, at, pdf["lead"].to_numpy().astype(np.int64), length)
        order = np.lexsort((offset, row))
        row, offset = row[order], offset[order]
        if not len(row):
            return pd.DataFrame({"key": [], "at": [], "n": []})
        first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)))
        return pd.DataFrame({"key": key[row[first]], "at": at[row[first]] + offset[first], "n": np.diff(np.append(first, len(row)))})

    return run


def merged(spans: np.ndarray) -> np.ndarray:
    """The maximal runs that half-open spans (rows of from, to) cover."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.append(True, spans[1:, 0] > reach[:-1]))
    return np.stack([spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]], 1)


_CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, scalar, spans in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
                text, runs = scalar.as_py(), np.empty((0, 2), np.int64)
                if spans.is_valid and len(spans):
                    flat = spans.values
                    at = flat.field("at").to_numpy(zero_copy_only=False)
                    runs = merged(np.stack([at, at + flat.field("n").to_numpy(zero_copy_only=False) - 1 + length], 1))
                kept, last = hashlib.sha256(), 0
                for a, b in runs.tolist():
                    kept.update(text[last:a])
                    last = b
                kept.update(text[last:])
                rows.append((doc_id, len(text), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), kept.hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _CUT, strict=True)], schema=_CUT)

    return run


def repeated_runs(ws: Workspace, keyed: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """``key, at, n``: runs of ``n`` suffixes from byte ``at`` on that repeat an earlier string of ``length`` bytes."""
    if not 64 <= length <= 150:
        raise ValueError("length must be from 64 to 150 bytes")
    size = keyed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_buckets = min(1 << 30, bucket_count(size // 35, BUCKET))
    scanned = keyed.select("key", "text").mapInArrow(_scan(length, n_buckets), SCANNED)
    resolved = ws.save(scanned.groupBy("bucket").applyInPandas(_resolve, RESOLVED), "resolved")
    asked = resolved.where("kind = 2")
    counts = asked.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("hot"), F.col("n")).otherwise(0)), F.lit(0))).first()
    n_sorted = bucket_count(counts[0] + counts[1], SORTED)
    lists = asked.groupBy("key").agg(F.collect_list(F.struct("grp", "at", "lead", "n", "hot")).alias("runs"))
    lists = ws.save(lists, "asked")
    owners = lists.select("key")
    texts = keyed.select("key", "text")
    if not keyed.groupBy("key").count().where("count > 1").isEmpty():
        texts = texts.dropDuplicates(["key"])
    texts = texts.join(F.broadcast(owners) if few_rows(owners, BROADCAST_ROWS) else owners, "key", "left_semi")
    contexts = texts.join(lists, "key").select("key", "text", "runs").mapInArrow(_contexts(length, n_sorted), "bucket int, grp long, key long, at long, lead int, n int, context binary")
    sorted_ = ws.save(contexts.groupBy("bucket").applyInPandas(_sort_bucket(length), "key long, at long, n int"), "sorted")
    return resolved.where("kind = 1").select("key", "at", "n").unionByName(sorted_)


def remove_repeats(docs: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """What is left of ``docs(doc_id, text)`` without the bytes of strings that start earlier too.

    One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.  A byte goes
    if a ``length``-byte string of its document covers it that also starts earlier: in a
    document with a smaller id, or before in the same one.  A null text is empty; texts
    shorter than ``length`` stay whole.  A null id comes last; of several texts with one id
    the one with the smaller hash comes first; rows that repeat id and text are one document
    and each gets its result.  An empty table gives no rows.  Other columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "suffix")
    keyed = with_key(ws, docs)
    runs = repeated_runs(ws, keyed, length=length)
    spans = ws.save(runs.groupBy("key").agg(F.collect_list(F.struct("at", "n")).alias("spans")), "spans")
    ws.drop("resolved", "sorted", "asked")
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    owners = spans.select("key")
    if not few_rows(owners, BROADCAST_ROWS):
        return keyed.join(spans, "key", "left").select("doc_id", "text", "spans").mapInArrow(_cut(length), kind)
    whole = keyed.join(F.broadcast(owners), "key", "left_anti").withColumn("spans", F.lit(None).cast("array<struct<at:bigint,n:int>>"))
    cut = keyed.join(F.broadcast(owners), "key", "left_semi").join(spans, "key")
    return whole.select("doc_id", "text", "spans").unionByName(cut.select("doc_id", "text", "spans")).mapInArrow(_cut(length), kind)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
