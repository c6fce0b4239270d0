"""A versioned store of named arrays on Spark tables.

Layout under ``root``: ``blobs/<snapshot>/`` and ``entries/<snapshot>/`` (Parquet, written
once), ``about/<snapshot>.json`` (what recovery needs of a snapshot), ``pins.json``,
``readers/`` (snapshots that are being read), ``writer.json`` (who may change the store) and
``head.json``, which lists the snapshots and is replaced last, so a reader sees a whole
version or none.  Deltas are always against the last full, so a load reads two snapshots
at most.

Opening a store changes nothing on disk.  Files of a snapshot that the head no longer lists
are deleted once no reader holds it.
"""

from __future__ import annotations

import contextlib
import datetime
import enum
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..operators import history, policy

ENTRIES = (
    "snapshot_id string, rank int, ordinal int, name string, shape array<bigint>, dtype string, original_dtype string, "
    "quant_scale float, storage string, alias_of string, compressed_size bigint, raw_size bigint, hash_raw string, shuffled boolean"
)
BLOBS = "name string, rank int, payload binary"
ARRAYS = "ordinal int, name string, shape array<bigint>, dtype string, data binary"


class NotFound(KeyError):
    pass


class Corrupt(ValueError):
    pass


class Locked(RuntimeError):
    pass


class Outcome(enum.Enum):
    MERGED = "merged"
    NOTHING = "nothing to merge"
    BUSY = "busy"


#: Seconds after which an entry of ``readers`` or ``writer.json`` is taken as left by a crash.
STALE = 900.0
#: Seconds that a folder must have lain unlisted before recovery deletes it.
GRACE = 900.0


@dataclass
class Retention:
    max_full: int = 5
    max_deltas_per_full: int = 10
    full_every_steps: int = 5000
    max_total: int | None = None
    rollback_interval: int = 10_000
    max_rollback: int = 3

    def cap(self) -> int:
        return self.max_total if self.max_total is not None else self.max_full * (1 + self.max_deltas_per_full)


@dataclass
class Snapshot:
    id: str
    step: int
    base: str | None
    finalized: bool
    created_at: str
    metadata: dict[str, str] = field(default_factory=dict)
    level: int = 3
    world_size: int = 1


class Files:
    """Small files through Hadoop's file systems, so that any store Spark reads will do."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self.path("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Writes beside the file and renames over it."""
        part = f"{name}.{uuid.uuid4().hex}.part"
        out = self.fs.create(self.path(part), True)
        out.write(bytearray(text.encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").toUri(), self.spark._jsparkSession.sessionState().newHadoopConf())
        option = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        option[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self.path(part), self.path(name), option)

    def list(self, name: str) -> list[str]:
        if not self.exists(name):
            return []
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.path(name)) if not x.getPath().getName().endswith(".part"))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def take(self, name: str, text: str) -> bool:
        """Writes a file that isn't there yet; False if it is."""
        try:
            out = self.fs.create(self.path(name), False)
        except Exception as e:
            if self.exists(name):
                return False
            raise e
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def age(self, name: str) -> float:
        """Seconds since anything directly in ``name`` changed; infinity if it isn't there."""
        if not self.exists(name):
            return float("inf")
        at = [self.fs.getFileStatus(self.path(name))]
        if at[0].isDirectory():
            at += self.fs.listStatus(self.path(name))
        return time.time() - max(x.getModificationTime() for x in at) / 1000


def complete_files(files: Files, snapshot_id: str) -> list[str]:
    """The files that a finalized snapshot was published with, if all are there; else none."""
    names = json.loads(files.read(f"about/{snapshot_id}.json") or "{}").get("files", [])
    here = {folder: set(files.list(folder)) for folder in {n.rpartition("/")[0] for n in names}}
    return names if all(n.rpartition("/")[2] in here[n.rpartition("/")[0]] for n in names) else []


_STORED = "rank int, ordinal int, name string, shape array<bigint>, dtype string, original_dtype string, quant_scale float, storage string, alias_of string, raw_size bigint, hash_raw string, shuffled boolean, payload binary"


def _casted(batches):
    """Casts and hashes arrays: adds stored bytes, dtype, scale and content hash."""
    for pdf in batches:
        rows = [codec.cast_array(bytes(d), t, p or "none") for d, t, p in zip(pdf["data"], pdf["dtype"], pdf["policy"], strict=True)]
        pdf["original_dtype"] = [t if r[1] != t else None for r, t in zip(rows, pdf["dtype"], strict=True)]
        pdf["data"], pdf["dtype"], pdf["quant_scale"] = [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]
        pdf["hash_raw"] = [codec.content_hash(r[0]) for r in rows]
        pdf["raw_size"] = [len(r[0]) for r in rows]
        yield pdf.drop(columns=["policy"])


def _packed(level: int, max_ratio: float):
    """Chooses full or delta for the rows that are neither skipped nor aliases, and compresses."""

    def one(row):
        if row.storage in ("skipped", "alias"):
            return row.storage, False, None
        data, width = bytes(row.data), codec.element_size(row.dtype)
        if row.base is not None and len(row.base) == len(data) and codec.pays_off(bytes(row.base), data, width, level, max_ratio):
            delta = codec.compute_delta(bytes(row.base), data)
            if delta is not None:
                return "delta", width > 1, codec.compress(codec.shuffle(delta, width), level)
        return "full", False, codec.compress(data, level)

    def run(batches):
        for pdf in batches:
            made = [one(r) for r in pdf.itertuples()]
            pdf["storage"], pdf["shuffled"], pdf["payload"] = [m[0] for m in made], [m[1] for m in made], [m[2] for m in made]
            yield pdf.drop(columns=["data", "base"])

    return run


def _unpacked(level: int, base_level: int):
    """Stored payloads to raw stored bytes, verified by their hash."""

    def one(r):
        if r.storage == "alias":
            return None
        own = None if r.payload is None else codec.decompress(bytes(r.payload), level)
        base = None if r.base_payload is None else codec.decompress(bytes(r.base_payload), base_level)
        if r.storage == "delta":
            width = codec.element_size(r.dtype)
            own = codec.xor(base, codec.unshuffle(own, width) if r.shuffled else own)
        elif r.storage == "skipped":
            own = base
        if own is None or codec.content_hash(own) != r.hash_raw:
            raise Corrupt(f"{r.name}: the stored bytes differ from their hash")
        return own

    def run(batches):
        for pdf in batches:
            pdf["data"] = [one(r) for r in pdf.itertuples()]
            yield pdf[["rank", "ordinal", "name", "shape", "dtype", "original_dtype", "quant_scale", "alias_of", "data"]]

    return run


def _uncast(batches):
    for pdf in batches:
        back = lambda r: codec.uncast_array(bytes(r.data), r.dtype, r.original_dtype, None if r.quant_scale != r.quant_scale else r.quant_scale)
        pdf["data"] = [back(r) for r in pdf.itertuples()]
        pdf["dtype"] = [r.original_dtype or r.dtype for r in pdf.itertuples()]
        yield pdf[["rank", "ordinal", "name", "shape", "dtype", "data"]]


class SnapshotStore:
    """Versions of a set of named arrays; see the module for the layout.

    ``save``, ``load``, ``load_arrays``, ``describe``, ``list_snapshots``, ``stats``, pins,
    retention, folding and merging of deltas, and recovery of what a crash left behind.
    Multi-rank saves go through ``create``, ``save_rank`` and ``finalize``.
    """

    def __init__(self, spark: SparkSession, root: str, *, retention: Retention | None = None, save_dtype: list[tuple[str, str]] | None = None, level: int = 3, max_ratio: float = codec.MAX_RATIO, dedup: bool = True):
        self.spark, self.root, self.level, self.max_ratio, self.dedup = spark, root.rstrip("/"), level, max_ratio, dedup
        self.rules = save_dtype or []
        self.files = Files(spark, self.root)
        head = json.loads(self.files.read("head.json") or "{}")
        self.retention = Retention(**head["retention"]) if "retention" in head else (retention or Retention())
        self.doomed: dict[str, float] = dict(head.get("doomed", {}))
        self.best: float | None = head.get("best")
        self.snapshots = self._healed([Snapshot(**s) for s in head.get("snapshots", [])])
        self.me = uuid.uuid4().hex

    def _healed(self, listed: list[Snapshot]) -> list[Snapshot]:
        """Without finalized snapshots whose entries or blobs are gone, and without deltas on them."""
        here = set(self.files.list("entries")) & set(self.files.list("blobs"))
        gone = {s.id for s in listed if s.finalized and s.id not in here}
        self.dropped = [s.id for s in listed if s.id in gone or s.base in gone]
        return [s for s in listed if s.id not in self.dropped]

    # -- publishing ---------------------------------------------------------------------

    def publish(self) -> None:
        head = {"format": 2, "retention": asdict(self.retention), "best": self.best, "doomed": self.doomed, "snapshots": [asdict(s) for s in self.snapshots]}
        self.files.write("head.json", json.dumps(head))

    @contextlib.contextmanager
    def writing(self, wait: float = 0.0) -> Iterator[None]:
        """Holds the store's writer lock; raises ``Locked`` if another holds it for longer than ``wait`` seconds."""
        end = time.monotonic() + wait
        while not self.files.take("writer.json", json.dumps({"owner": self.me})):
            if self.files.age("writer.json") > STALE:
                self.files.delete("writer.json")
            elif time.monotonic() >= end:
                raise Locked(f"{self.root} is being written by {self.files.read('writer.json')}")
            else:
                time.sleep(0.1)
        try:
            yield
        finally:
            self.files.delete("writer.json")

    @contextlib.contextmanager
    def reading(self, snapshot_id: str) -> Iterator[str]:
        """While held, files of the snapshot and its base stay, whatever retention or merging decide."""
        snap = self._find(snapshot_id)
        name = f"readers/{uuid.uuid4().hex}.json"
        self.files.write(name, json.dumps([i for i in (snap.id, snap.base) if i]))
        try:
            yield snapshot_id
        finally:
            self.files.delete(name)

    def being_read(self) -> set[str]:
        held: set[str] = set()
        for x in self.files.list("readers"):
            if self.files.age(f"readers/{x}") > STALE:
                self.files.delete(f"readers/{x}")
            else:
                held |= set(json.loads(self.files.read(f"readers/{x}") or "[]"))
        return held

    def sweep(self) -> list[str]:
        """Deletes the files of snapshots that are no longer listed and that nobody reads; returns their ids."""
        held, known = self.being_read(), {s.id for s in self.snapshots}
        free = [i for i in self.doomed if i not in held and i not in known]
        for i in free:
            for part in (f"entries/{i}", f"blobs/{i}", f"about/{i}.json"):
                self.files.delete(part)
            del self.doomed[i]
        if free:
            self.publish()
        return free

    def files_of(self, snapshot_id: str, rank: int | None = None) -> list[str]:
        """Names of a snapshot's files, of one rank or of all."""
        self._find(snapshot_id)
        blobs = [x for x in self.files.list(f"blobs/{snapshot_id}") if x.startswith("rank=") and rank in (None, int(x.removeprefix("rank=")))]
        folders = [f"blobs/{snapshot_id}/{r}" for r in blobs] + [f"entries/{snapshot_id}"]
        names = [f"{f}/{x}" for f in folders for x in self.files.list(f) if x[0] not in "._"]
        return sorted([*names, f"about/{snapshot_id}.json"])

    def _find(self, snapshot_id: str) -> Snapshot:
        try:
            uuid.UUID(snapshot_id)
        except ValueError as e:
            raise ValueError(f"not a snapshot id: {snapshot_id!r}") from e
        for s in self.snapshots:
            if s.id == snapshot_id:
                return s
        raise NotFound(snapshot_id)

    def latest(self) -> Snapshot:
        done = [s for s in self.snapshots if s.finalized]
        if not done:
            raise NotFound("no finalized snapshot")
        return done[-1]

    def last_full(self) -> Snapshot | None:
        return next((s for s in reversed(self.snapshots) if s.finalized and s.base is None and s.id not in self.doomed), None)

    def full_is_due(self, step: int) -> bool:
        full, run = self.last_full(), 0
        for s in reversed(self.snapshots):
            if s.base is None:
                break
            run += 1
        return full is None or self.retention.cap() <= 1 or max(0, step - full.step) >= self.retention.full_every_steps or run >= self.retention.max_deltas_per_full

    # -- saving -------------------------------------------------------------------------

    def save(self, arrays: DataFrame, step: int, metadata: dict[str, str] | None = None, snapshot_id: str | None = None) -> str:
        """Saves ``arrays`` (columns of ``ARRAYS``) as the version of ``step``; returns its id.

        An id that is given and finalized makes the call a no-op; one that a crash has left
        unfinalized is written again, so replays neither repeat nor lose a version.
        """
        known = next((s for s in self.snapshots if s.id == snapshot_id), None) if snapshot_id else None
        if known and known.finalized:
            return known.id
        if known and known.world_size != 1:
            raise ValueError(f"{known.id} is saved by {known.world_size} ranks")
        new = known.id if known else self.create(step, metadata, snapshot_id=snapshot_id)
        self.save_rank(new, arrays, 0)
        self.finalize(new)
        return new

    def create(self, step: int, metadata: dict[str, str] | None = None, *, world_size: int = 1, snapshot_id: str | None = None) -> str:
        base = None if self.full_is_due(step) else self.last_full().id
        now = datetime.datetime.now(datetime.UTC).isoformat()
        new = Snapshot(snapshot_id or str(uuid.uuid4()), int(step), base, False, now, {str(k): str(v) for k, v in (metadata or {}).items()}, self.level, world_size)
        self._announce(new)
        return new.id

    def _announce(self, new: Snapshot) -> None:
        """Lists a snapshot before any of its files are written."""
        self.files.write(f"about/{new.id}.json", json.dumps({"snapshot": asdict(new)}))
        self.snapshots.append(new)
        self.publish()

    def withdraw(self, snapshot_id: str) -> None:
        """Takes back a snapshot that was announced and not finalized."""
        if self._find(snapshot_id).finalized:
            raise ValueError(f"{snapshot_id} is finalized")
        self.snapshots = [s for s in self.snapshots if s.id != snapshot_id]
        self.doomed[snapshot_id] = time.time()
        self.publish()
        self.sweep()

    def save_rank(self, snapshot_id: str, arrays: DataFrame, rank: int) -> None:
        """Writes one rank's blobs and entries; nothing is published."""
        snap = self._find(snapshot_id)
        named = policy.first_match(arrays.select(F.lit(rank).alias("rank"), "ordinal", "name", F.col("shape").cast("array<bigint>").alias("shape"), "dtype", "data"), self.rules, out="policy")
        columns = "rank int, ordinal int, name string, shape array<bigint>, dtype string, data binary, original_dtype string, quant_scale float, hash_raw string, raw_size bigint"
        cast = named.mapInPandas(_casted, columns).persist()
        try:
            meta = cast.drop("data")
            if self.dedup:
                large = meta.where(F.col("raw_size") >= codec.MIN_DELTA)
                owner = large.groupBy("hash_raw", "dtype").agg(F.min_by("name", "ordinal").alias("owner"))
                aliased = large.join(owner, ["hash_raw", "dtype"]).where("owner != name").select("name", F.col("owner").alias("alias_of"))
                meta = meta.join(aliased, "name", "left")
            else:
                meta = meta.withColumn("alias_of", F.lit(None).cast("string"))
            if snap.base:
                base = self._resolved(snap.base, rank).select("name", F.col("hash_raw").alias("b_hash"), F.col("raw_size").alias("b_size"), F.col("b_storage"), "owner")
                meta = meta.join(base, "name", "left")
            else:
                meta = meta.select("*", *[F.lit(None).cast(t).alias(n) for n, t in (("b_hash", "string"), ("b_size", "bigint"), ("b_storage", "string"), ("owner", "string"))])
            storage = F.when(F.col("alias_of").isNotNull(), "alias").when(F.col("hash_raw") == F.col("b_hash"), "skipped").when((F.col("raw_size") == F.col("b_size")) & (F.col("raw_size") >= codec.MIN_DELTA), "delta").otherwise("full")
            kinds = meta.withColumn("storage", storage)
            rows = kinds.join(cast.select("name", "data"), "name")
            if snap.base:
                wanted = kinds.where("storage = 'delta'").select("name", "owner")
                blobs = self._blobs(snap.base, rank).select(F.col("name").alias("owner"), F.col("payload").alias("p"))
                level = self._find(snap.base).level
                raw = wanted.join(blobs, "owner").select("name", codec.as_udf(codec.decompress, "binary", level)(F.col("p")).alias("base"))
                rows = rows.join(raw, "name", "left")
            else:
                rows = rows.withColumn("base", F.lit(None).cast("binary"))
            rows = rows.select("rank", "ordinal", "name", "shape", "dtype", "original_dtype", "quant_scale", "storage", "alias_of", "raw_size", "hash_raw", "data", "base")
            stored = rows.mapInPandas(_packed(self.level, self.max_ratio), _STORED)
            stored.write.mode("overwrite").parquet(f"{self.root}/blobs/{snapshot_id}/rank={rank}")
        finally:
            cast.unpersist()

    def finalize(self, snapshot_id: str) -> None:
        """Collects the ranks' entries, publishes the snapshot and applies retention."""
        snap = self._find(snapshot_id)
        here = len([x for x in self.files.list(f"blobs/{snapshot_id}") if x.startswith("rank=") and self.files.exists(f"blobs/{snapshot_id}/{x}/_SUCCESS")])
        if here < snap.world_size:
            raise ValueError(f"only {here}/{snap.world_size} ranks have saved")
        self._write_entries(snapshot_id)
        snap.finalized = True
        names = [x for x in self.files_of(snapshot_id) if not x.startswith("about/")]
        self.files.write(f"about/{snapshot_id}.json", json.dumps({"snapshot": asdict(snap), "files": names}))
        self.publish()
        self.apply_retention()

    def _write_entries(self, snapshot_id: str) -> None:
        stored = self.spark.read.schema(_STORED).parquet(f"{self.root}/blobs/{snapshot_id}")
        entries = stored.select(F.lit(snapshot_id).alias("snapshot_id"), "rank", "ordinal", "name", "shape", "dtype", "original_dtype", "quant_scale", "storage", "alias_of", F.coalesce(F.octet_length("payload"), F.lit(0)).cast("bigint").alias("compressed_size"), "raw_size", "hash_raw", "shuffled")
        entries.write.mode("overwrite").parquet(f"{self.root}/entries/{snapshot_id}")

    # -- reading ------------------------------------------------------------------------

    def entries(self, *ids: str) -> DataFrame:
        if not ids:
            return self.spark.createDataFrame([], ENTRIES)
        return self.spark.read.schema(ENTRIES).parquet(*[f"{self.root}/entries/{i}" for i in ids])

    def _blobs(self, snapshot_id: str, rank: int) -> DataFrame:
        return self.spark.read.schema(_STORED).parquet(f"{self.root}/blobs/{snapshot_id}").where(F.col("rank") == rank)

    def _resolved(self, snapshot_id: str, rank: int) -> DataFrame:
        """Entries of a full with the name that owns each payload."""
        e = self.entries(snapshot_id).where(F.col("rank") == rank)
        return e.withColumn("owner", F.coalesce("alias_of", "name")).withColumnRenamed("storage", "b_storage")

    def load(self, snapshot_id: str, names: list[str] | None = None, rank: int = 0) -> DataFrame:
        """``rank, ordinal, name, shape, dtype, data`` as saved; a name that is missing is an error."""
        snap = self._find(snapshot_id)
        if not snap.finalized:
            raise NotFound(f"{snapshot_id} is not finalized")
        e = self.entries(snapshot_id).where(F.col("rank") == rank)
        if names is not None:
            wanted = list(dict.fromkeys(names))
            chosen = e.where(F.col("name").isin(wanted))
            held = {r["name"]: r["alias_of"] for r in chosen.select("name", "alias_of").collect()}  # names asked for
            if missing := [n for n in wanted if n not in held]:
                raise NotFound(f"no array {missing[0]!r} in {snapshot_id}")
            owners = sorted({*wanted, *(a for a in held.values() if a)})
            e = e.where(F.col("name").isin(owners))
        own = self._blobs(snapshot_id, rank).select("name", "payload")
        if names is not None:
            own = own.where(F.col("name").isin(owners))  # reaches the scan
        rows = e.join(own, "name")
        if snap.base:
            resolved, theirs = self._resolved(snap.base, rank).select("name", "owner"), self._blobs(snap.base, rank)
            if names is not None:
                resolved = resolved.where(F.col("name").isin(owners))
                theirs = theirs.where(F.col("name").isin(sorted({r["owner"] for r in resolved.collect()})))  # owners of names asked for
            base = resolved.join(theirs.select(F.col("name").alias("owner"), F.col("payload").alias("base_payload")), "owner").drop("owner")
            rows = rows.join(base, "name", "left")
            base_level = self._find(snap.base).level
        else:
            rows, base_level = rows.withColumn("base_payload", F.lit(None).cast("binary")), snap.level
        raw = rows.mapInPandas(_unpacked(snap.level, base_level), "rank int, ordinal int, name string, shape array<bigint>, dtype string, original_dtype string, quant_scale float, alias_of string, data binary")
        owner = raw.where("alias_of is null").select(F.col("name").alias("_owner"), F.col("data").alias("_data"))
        whole = raw.join(owner, F.col("alias_of") == F.col("_owner"), "left")
        bytes_ = F.when(F.col("alias_of").isNull(), F.col("data")).when(F.col("_data").isNull(), F.raise_error(F.concat(F.lit("alias without owner: "), "name"))).otherwise(F.col("_data"))
        out = whole.withColumn("data", bytes_).drop("_owner", "_data").mapInPandas(_uncast, "rank int, ordinal int, name string, shape array<bigint>, dtype string, data binary")
        return out.where(F.col("name").isin(wanted)) if names is not None else out

    def load_latest(self, names: list[str] | None = None, rank: int = 0) -> tuple[str, DataFrame]:
        snap = self.latest()
        return snap.id, self.load(snap.id, names, rank)

    def describe(self, snapshot_id: str | None = None, rank: int = 0) -> DataFrame:
        """One row per array, from metadata only, with what is known of the snapshot.

        ``dtype`` is that of the array as it was saved.  A rank that saved nothing raises.
        """
        snap = self._find(snapshot_id) if snapshot_id else self.latest()
        e = self.entries(snap.id).where(F.col("rank") == rank)
        if e.isEmpty() and not self.files.exists(f"blobs/{snap.id}/rank={rank}"):
            raise NotFound(f"rank {rank} saved nothing in {snap.id}")
        about = [F.lit(snap.id).alias("id"), F.lit(snap.step).cast("long").alias("step"), F.lit(snap.created_at).alias("created_at"), F.lit(snap.base is not None).alias("is_delta"),
                 F.lit(snap.base).cast("string").alias("base_snapshot_id"), F.lit(rank).alias("rank"), F.lit(snap.world_size).alias("ranks"), F.lit(json.dumps(snap.metadata)).alias("metadata")]
        return e.select(*about, "name", "shape", F.coalesce("original_dtype", "dtype").alias("dtype"), F.col("dtype").alias("stored_dtype"), "storage", "alias_of", "raw_size", "compressed_size", "hash_raw")

    def history(self) -> DataFrame:
        place = {s.id: i + 1 for i, s in enumerate(self.snapshots)}
        pins = set(self.pinned_steps())
        newest = {s.step: s.id for s in self.snapshots if s.finalized}
        rows = [("", place[s.id], s.step, place.get(s.base), s.finalized, s.step in pins and newest.get(s.step) == s.id, s.id) for s in self.snapshots]
        return self.spark.createDataFrame(rows, "store string, pos bigint, step bigint, base bigint, finalized boolean, pinned boolean, id string")

    def list_snapshots(self) -> DataFrame:
        done = [s.id for s in self.snapshots if s.finalized]
        h = self.history()
        e = self.entries(*done).join(h.select(F.col("id").alias("snapshot_id"), "store", "pos"), "snapshot_id").withColumnRenamed("storage", "kind")
        about = self.spark.createDataFrame([(s.id, s.metadata) for s in self.snapshots], "id string, metadata map<string,string>")
        return history.list_snapshots(h, e).join(h.select("store", "pos", "id"), ["store", "pos"]).join(about, "id").orderBy("pos")

    def stats(self) -> DataFrame:
        return history.stats(self.list_snapshots())

    def report(self) -> str:
        """The statistics as text, in ASCII."""
        row = self.stats().first()  # one store
        if row is None:
            return "no snapshots yet"
        s = row.asDict()
        size = lambda n: next((f"{n / k:.1f} {u}" for k, u in ((1 << 30, "GiB"), (1 << 20, "MiB"), (1 << 10, "KiB")) if n >= k), f"{n} B")
        return "\n".join([
            f"snapshots   {s['total_snapshots']}: {s['full_snapshots']} full, {s['delta_snapshots']} delta",
            f"arrays      {s['total_tensors_saved']}: {s['full_tensors']} full, {s['delta_tensors']} delta, {s['skipped_tensors']} skipped",
            f"raw         {size(s['total_raw_bytes'])}",
            f"stored      {size(s['total_compressed_bytes'])}, {s['compression_ratio']:.1%} of raw",
            f"all in full {size(s['estimated_naive_bytes'])}, of which {s['savings_percent']:.1f}% are saved",
        ])

    def resume_step(self) -> int:
        """The step after that of the last finalized snapshot in list order."""
        return next((s.step + 1 for s in reversed(self.snapshots) if s.finalized), 0)

    def save_best(self, arrays: DataFrame, step: int, metric: float, *, name: str = "metric", lower: bool = True, metadata: dict[str, str] | None = None) -> str | None:
        """Saves only a metric better than all before, also those of earlier sessions and of evicted snapshots."""
        if self.best is not None and not (metric < self.best if lower else metric > self.best):
            return None
        new = self.save(arrays, step, (metadata or {}) | {"best": "true", name: repr(float(metric))})
        self.best = float(metric)
        self.publish()
        return new

    def save_final(self, arrays: DataFrame, step: int, metadata: dict[str, str] | None = None, *, sync_to: str | None = None) -> str:
        """Saves, merges the deltas into a full, and copies the store to ``sync_to`` if given."""
        from . import sync

        new = self.save(arrays, step, (metadata or {}) | {"final": "true"})
        self.merge_now()
        if sync_to:
            sync.push(self.spark, self.root, sync_to)
        return new

    # -- pins and retention -------------------------------------------------------------

    def pinned_steps(self) -> list[int]:
        return sorted(set(json.loads(self.files.read("pins.json") or "[]")))

    def pin(self, step: int) -> bool:
        if not any(s.finalized and s.step == step for s in self.snapshots):
            return False
        self.files.write("pins.json", json.dumps(sorted({*self.pinned_steps(), step})))
        return True

    def unpin(self, step: int) -> bool:
        if step not in self.pinned_steps():
            return False
        self.files.write("pins.json", json.dumps([s for s in self.pinned_steps() if s != step]))
        return True

    def _protected(self, h: DataFrame) -> DataFrame:
        return history.protected(h, interval=self.retention.rollback_interval, keep=self.retention.max_rollback)

    def _keep(self, left: DataFrame) -> list[str]:
        """Publishes the snapshots that are left, then deletes the files of the others that nobody reads."""
        ids = {r["id"] for r in left.select("id").collect()}  # snapshots of one store
        gone = [s.id for s in self.snapshots if s.id not in ids]
        if gone:
            self.snapshots = [s for s in self.snapshots if s.id in ids]
            self.doomed |= dict.fromkeys(gone, time.time())
            self.publish()
        self.sweep()
        return gone

    def apply_retention(self) -> list[str]:
        fulls, total = sum(s.finalized and s.base is None for s in self.snapshots), sum(s.finalized for s in self.snapshots)
        if fulls <= self.retention.max_full and total <= self.retention.cap():
            return []
        h = self.history()
        shielded = self._protected(h)
        left = history.retain_fulls(h, shielded, max_full=self.retention.max_full, keep_newest=True)
        return self._keep(history.retain_total(left, shielded, cap=self.retention.cap()))

    def fold(self, stride: int, max_chain: int | None = None) -> list[str]:
        """Folds a run of trailing deltas into the newest, but for protected ones; no bytes are read.

        A run of ``max_chain`` or more is merged into a full instead, whatever the stride is.
        """
        h = self.history()
        pending = len(self.snapshots) - max((i + 1 for i, s in enumerate(self.snapshots) if s.base is None), default=0)
        if max_chain is not None and pending >= max_chain:
            before = [s.id for s in self.snapshots]
            self.merge()
            now = {s.id for s in self.snapshots}
            return [i for i in before if i not in now]
        if stride <= 0:
            return []
        left = history.stride_fold(h, stride=stride)
        keep = left.unionByName(h.join(self._protected(h), ["store", "pos"], "left_semi")).dropDuplicates(["id"])
        return self._keep(keep)

    def merge(self) -> str | None:
        """Rewrites the newest trailing delta as a full; the new id, or None. See ``try_merge``."""
        return self.try_merge()[1]

    def try_merge(self) -> tuple[Outcome, str | None]:
        """Rewrites the newest trailing delta as a full and drops its base and deltas.

        Busy while another snapshot is being saved or one that would go is being read.
        Protected snapshots are not merged away.  Bytes are verified before they are signed
        again.  The new snapshot is listed before it is written, and withdrawn if that fails.
        """
        plan = history.full_merge_plan(self.history()).first()
        if plan is None:
            return Outcome.NOTHING, None
        tip, base = self.snapshots[plan["pos"] - 1], self.snapshots[plan["base"] - 1]
        old = {s.id for s in self.snapshots if s.id == base.id or s.base == base.id}
        if any(not s.finalized for s in self.snapshots) or old & self.being_read():
            return Outcome.BUSY, None
        h = self.history()
        shielded = {self.snapshots[r["pos"] - 1].id for r in self._protected(h).collect()}
        ranks = sorted({int(x.removeprefix("rank=")) for s in (base, tip) for x in self.files.list(f"blobs/{s.id}") if x.startswith("rank=")})
        held = {int(x.removeprefix("rank=")) for x in self.files.list(f"blobs/{tip.id}") if x.startswith("rank=")}
        meta = tip.metadata | {"full_merge": "true", "merged_deltas": str(plan["merged_deltas"])}
        new = Snapshot(str(uuid.uuid4()), tip.step, None, False, tip.created_at, meta, self.level, len(ranks))
        self._announce(new)
        try:
            for rank in ranks:
                self.save_rank(new.id, self.load((tip if rank in held else base).id, rank=rank), rank)
            self.finalize(new.id)
        except BaseException:
            if not new.finalized:
                self.withdraw(new.id)
            raise
        if not old & shielded:
            self._keep(self.history().where(~F.col("id").isin(sorted(old))))
        self.snapshots.sort(key=lambda s: s.step)
        self.publish()
        return Outcome.MERGED, new.id

    def merge_now(self, wait: float = 300.0, pause: float = 0.5) -> Outcome:
        """Merges, trying again while the store is busy; what came of it in the end."""
        end = time.monotonic() + wait
        while (outcome := self.try_merge()[0]) is Outcome.BUSY and time.monotonic() < end:
            time.sleep(pause)
        return outcome

    # -- recovery -----------------------------------------------------------------------

    def recover(self, *, grace: float = GRACE, wait: float = 0.0) -> tuple[list[str], list[str]]:
        """Takes back whole snapshots that the head doesn't list and deletes the rest; ids of both.

        Under the writer's lock.  A folder is taken back if its description names it, all its
        ranks are there, every stored array has its hash, and its base is listed or taken back
        before it (fulls come first, then by step).  Others go once they have lain unchanged
        for ``grace`` seconds and nobody reads them.  Unfinalized snapshots in the head stay.
        """
        with self.writing(wait):
            listed = json.loads(self.files.read("head.json") or "{}")
            known = {s["id"] for s in listed.get("snapshots", [])} | {s.id for s in self.snapshots} | set(self.doomed)
            found = {*self.files.list("blobs"), *self.files.list("entries"), *(x.removesuffix(".json") for x in self.files.list("about"))}
            orphans = [(self._about(i), i) for i in sorted(found - known)]
            whole = sorted((s for s, _ in orphans if s), key=lambda s: (s.base is not None, s.step, s.created_at))
            taken = []
            for snap in whole:
                if (snap.base is None or any(s.id == snap.base and s.finalized for s in self.snapshots)) and self._readmit(snap):
                    taken.append(snap.id)
            if taken:
                self.snapshots.sort(key=lambda s: s.step)
                self.publish()
            held, gone = self.being_read(), []
            for _, i in orphans:
                parts = (f"entries/{i}", f"blobs/{i}", f"about/{i}.json")
                old = min(self.files.age(p) for p in parts if self.files.exists(p)) >= grace
                if i not in taken and i not in held and old:
                    for p in parts:
                        self.files.delete(p)
                    gone.append(i)
            self.sweep()
            return taken, gone

    def _about(self, name: str) -> Snapshot | None:
        """The description of a folder; None if there is none or it names another snapshot."""
        try:
            snap = Snapshot(**json.loads(self.files.read(f"about/{name}.json") or "{}")["snapshot"])
            return snap if snap.id == name and str(uuid.UUID(name)) == name else None
        except (KeyError, TypeError, ValueError):
            return None

    def _readmit(self, snap: Snapshot) -> bool:
        """Lists an orphan after all its arrays have been read and compared with their hashes."""
        self.snapshots.append(snap)
        snap.finalized = True
        try:
            names = complete_files(self.files, snap.id)
            ranks = [int(x.removeprefix("rank=")) for x in self.files.list(f"blobs/{snap.id}") if x.startswith("rank=") and (names or self.files.exists(f"blobs/{snap.id}/{x}/_SUCCESS"))]
            if len(ranks) < snap.world_size:
                raise Corrupt(f"only {len(ranks)}/{snap.world_size} ranks")
            if not names:
                self._write_entries(snap.id)
            for rank in ranks:
                self.load(snap.id, rank=rank).write.format("noop").mode("overwrite").save()
            return True
        except Exception:  # whatever makes it unreadable
            self.snapshots.remove(snap)
            return False
