"""Line dedup by winnowing: later copies of runs of lines go.

The non-blank lines of a document are hashed; of every window of ``run`` consecutive hashes
the least is a fingerprint, so any run of that many lines that two places share has a
fingerprint at the same line of both.  Fingerprints that occur once are dropped; around the
others the match is extended to both sides through the windows that they stand for, and
windows that start earlier elsewhere too are deleted with all their lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, few_rows, table, with_key

#: Consecutive lines that make a repeat.
RUN = 3
#: Documents that are told to all tasks at most; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Fingerprints a task compares among themselves before it hands them on.
FLUSH = 300_000


def content_lines(text: str) -> list[tuple[int, bytes]]:
    """Number and stripped bytes of each line that isn't blank (ASCII white space counts)."""
    stripped = (x.strip() for x in text.encode().split(b"\n"))
    return [(i, x) for i, x in enumerate(stripped) if x]


def winnow(hashes: list[int], run: int) -> list[tuple[int, int, int]]:
    """(fingerprint, first window, windows) of each stretch of windows with one least hash, the last of equal ones."""
    n = len(hashes) - run + 1
    if n < 1:
        return []
    h = np.array(hashes, np.uint64)
    windows = np.lib.stride_tricks.sliding_window_view(h, run)
    at = np.arange(n) + run - 1 - np.argmin(windows[:, ::-1], axis=1)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return [(int(h[at[i]]) - (1 << 63), int(i), int(m)) for i, m in zip(first, np.diff(np.append(first, n)), strict=True)]


_PRINTS = pa.schema([("print", pa.int64()), ("key", pa.int64()), ("at", pa.int32()), ("windows", pa.list_(pa.binary())), ("again", pa.bool_())])
PRINTS = "print long, key long, at int, windows array<binary>, again boolean"


def _fingerprints(run: int):
    """Fingerprints with the digests of their windows; ``again`` where the task has seen all of that before."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[tuple, tuple[int, int]] = {}
        rows: list[tuple] = []

        def out():
            data = rows + [(p, k, at, list(w), False) for (p, w), (k, at) in first.items()]
            for i in range(0, len(data), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*data[i : i + 20_000], strict=True), _PRINTS, strict=True)], schema=_PRINTS)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines = [x for _, x in content_lines(text)]
                for mark, at, n in winnow([xxhash.xxh3_64_intdigest(x) for x in lines], run):
                    windows = tuple(xxhash.xxh3_128_digest(b"\n".join(lines[at + j : at + j + run])) for j in range(n))
                    here, known = (key, at), first.get((mark, windows))
                    if known is None or here < known:
                        first[mark, windows] = here
                        here = known
                    if here is not None and here != first[mark, windows]:
                        rows.append((mark, *here, list(windows), True))
                if len(rows) + len(first) > FLUSH:
                    yield from out()
                    first.clear()
                    rows.clear()
        yield from out()

    return go


def repeated_windows(ws: Workspace, keyed: DataFrame, run: int = RUN) -> DataFrame:
    """``key, starts``: the windows of a document, by their first non-blank line, that start earlier too."""
    prints = ws.save(keyed.select("key", "text").mapInArrow(_fingerprints(run), PRINTS), "prints")
    common = ws.save(prints.where("not again").groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print"), "common")
    shared = prints.where("not again").join(common, "print", "left_semi")
    spread = lambda df: df.select("key", "at", F.posexplode("windows").alias("j", "window")).select("key", (F.col("at") + F.col("j")).alias("at"), "window")
    windows = ws.save(spread(shared), "windows")
    place = F.struct("key", "at")
    earliest = ws.save(windows.groupBy("window").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "earliest")
    later = windows.join(earliest, "window").where(place != F.col("first")).select("key", "at")
    again = later.unionByName(spread(prints.where("again")).select("key", "at"))
    starts = ws.save(again.groupBy("key").agg(F.collect_set("at").alias("starts")), "starts")
    ws.drop("prints", "common", "windows", "earliest")
    return starts


def cut(text: str, starts, run: int) -> tuple[str, int, int]:
    """What is left of a text, its number of lines, and how many went."""
    raw = text.split("\n")
    if starts is None or not len(starts):
        return text, len(raw), 0
    content = content_lines(text)
    gone = {content[i + j][0] for i in starts for j in range(run)}
    return "\n".join(x for i, x in enumerate(raw) if i not in gone), len(raw), len(gone)


def dedup_lines(docs: DataFrame, *, run: int = RUN) -> DataFrame:
    """``docs`` with ``text`` cut, and ``n_lines`` and ``n_removed`` beside its columns.

    A line goes if ``run`` or more consecutive non-blank lines, it among them, also occur
    earlier: in a document with a smaller doc_id or further up in the same one.  Lines are
    compared without white space at their ends; blank lines are passed over and stay.  A
    null text counts as empty and stays null.  Null ids come last; of texts with one id the
    one with the smaller hash comes first; rows that repeat id and text are one document,
    and each gets its result.  Columns named ``n_lines`` or ``n_removed`` are replaced, all
    others stay.  An empty table gives no rows.
    """
    ws = Workspace(docs.sparkSession, "lines")
    keep = [c for c in docs.columns if c.lower() not in ("text", "n_lines", "n_removed")]
    row = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in keep], F.col("text").isNull().alias("_null")).alias("_row"))
    keyed = with_key(ws, row, ("text", "_row"))
    starts = repeated_windows(ws, keyed, run)
    owners = starts.select("key")

    @F.pandas_udf("text string, n_lines int, n_removed int")
    def left(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([cut(t, s, run) for t, s in zip(texts, found, strict=True)], columns=["text", "n_lines", "n_removed"])

    others = [F.col(f"_row.`{c}`") for c in keep]
    lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).cast("int")
    same = [*others, F.when(~F.col("_row._null"), F.col("text")).alias("text"), lines.alias("n_lines"), F.lit(0).alias("n_removed")]
    if few_rows(owners, BROADCAST_ROWS):
        whole = keyed.join(F.broadcast(owners), "key", "left_anti").select(*same)
        touched = keyed.join(F.broadcast(owners), "key", "left_semi").join(starts, "key")
    else:
        joined = keyed.join(starts, "key", "left")
        whole, touched = joined.where("starts is null").select(*same), joined.where("starts is not null")
    cutted = touched.select("_row", left("text", "starts").alias("_x")).select(*others, "_x.text", "_x.n_lines", "_x.n_removed")
    order = [c for c in docs.columns if c in keep or c == "text"]
    return whole.unionByName(cutted).select(*[F.col(f"`{c}`") for c in order], "n_lines", "n_removed")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


ORACLE = """
with raw as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
stripped as (select *, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) as l from raw),
content as (
  select doc_id, pos, l, row_number() over w as k,
         lead(l, 1) over w as l1, lead(l, 2) over w as l2
  from stripped where l <> '' window w as (partition by doc_id order by pos)),
starts as (
  select doc_id, k, row_number() over (partition by l, l1, l2 order by doc_id, k) as nth from content where l2 is not null),
gone as (select distinct doc_id, k + j as k from starts, (select unnest([0, 1, 2]) as j) where nth > 1),
gone_pos as (select c.doc_id, c.pos from content c join gone g using (doc_id, k))
select r.doc_id, count(*)::int as n_lines, count(g.pos)::int as n_removed,
       md5(coalesce(string_agg(r.line, chr(10) order by r.pos) filter (g.pos is null), '')) as kept_md5
from raw r left join gone_pos g on r.doc_id = g.doc_id and r.pos = g.pos
group by r.doc_id
"""
