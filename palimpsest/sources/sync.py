"""Copies of a store: listings are compared by name, files are copied in parallel, the head goes last."""

from __future__ import annotations

import json
import shutil
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import versions
from .store import Files, complete_files

#: Files are copied by this many tasks, or threads of the driver, at once.
TRANSFERS = 8
#: Files of a store that say what is going on there and are never copied.
OWN = ("head.json", "writer.json", "readers/")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """``name, length`` of all files below ``root``; partial files and those of ``OWN`` are left out."""
    fs = Files(spark, root)
    home = fs.fs.makeQualified(fs.path("")).toUri().getPath().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    path = F.regexp_replace("path", r"^[a-z0-9]+:(//[^/]*)?/*", "/")
    out = files.select(F.substring(path, len(home) + 1, 1 << 20).alias("name"), "length")
    own = F.lit(False)
    for x in OWN:
        own |= F.col("name").startswith(x)
    return out.where(~F.col("name").endswith(".part") & ~own)


def _copy(source: str, target: str):
    def run(rows):
        gone = 0
        for r in rows:
            a, b = Path(source) / r["name"], Path(target) / r["name"]
            b.parent.mkdir(parents=True, exist_ok=True)
            try:
                shutil.copyfile(a, f"{b}.part")
            except FileNotFoundError:  # retention has removed it meanwhile
                gone += 1
                continue
            Path(f"{b}.part").rename(b)
        yield gone

    return run


def _local(path: str) -> str | None:
    """The path if it is one of a mounted file system."""
    bare = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
    return None if ":" in bare.split("/")[0] else bare


def transfer(spark: SparkSession, source: str, target: str, names: DataFrame, *, shared: bool = True) -> int:
    """Copies the files ``names(name)``, each beside its place and then renamed; how many had vanished.

    Paths that all executors share (``shared``) are copied by tasks; between other file systems
    threads of the driver copy, ``TRANSFERS`` at once.
    """
    a, b = _local(source), _local(target)
    if shared and a and b:
        Path(b).mkdir(parents=True, exist_ok=True)
        copy = _copy(a, b)

        def tasks(batches):
            import pyarrow as pa

            rows = ({"name": n} for batch in batches for n in batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(copy(rows)), pa.int64())], names=["gone"])

        return names.select("name").repartition(TRANSFERS).mapInArrow(tasks, "gone long").agg(F.coalesce(F.sum("gone"), F.lit(0))).first()[0]
    here, there = Files(spark, source), Files(spark, target)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    move = spark._jvm.org.apache.hadoop.fs.FileUtil

    def one(name: str) -> int:
        part = there.path(f"{name}.part")
        there.fs.mkdirs(part.getParent())
        if not here.exists(name):
            return 1
        move.copy(here.fs, here.path(name), there.fs, part, False, True, conf)
        there.fs.delete(there.path(name), False)
        there.fs.rename(part, there.path(name))
        return 0

    with ThreadPoolExecutor(TRANSFERS) as pool:
        return sum(pool.map(one, (r["name"] for r in names.select("name").toLocalIterator())))


def push(spark: SparkSession, source: str, target: str, *, prefix: str = "", shared: bool = True) -> dict[str, int]:
    """Brings ``target`` up to ``source``; counts of files synced, skipped, vanished and deleted.

    Files are immutable, so a name that is there is taken as equal.  The head goes after all
    files it names, and files of snapshots that it no longer lists go after that.  With a
    ``prefix`` only files below it are copied, and the head stays.
    """
    there = Files(spark, target)
    there.fs.mkdirs(there.path(""))
    head = Files(spark, source).read("head.json")  # files it names are listed after it
    wanted, held = listing(spark, source), listing(spark, target)
    if prefix:
        wanted, held = wanted.where(F.col("name").startswith(prefix)), held.where(F.col("name").startswith(prefix))
    wanted = wanted.persist()
    try:
        todo = versions.absent(wanted, held, ["name"]).persist()
        counts = {"synced": todo.count(), "skipped": wanted.join(todo.select("name"), "name", "left_anti").count()}
        counts["vanished"] = transfer(spark, source, target, todo, shared=shared)
        counts["synced"] -= counts["vanished"]
        todo.unpersist()
    finally:
        wanted.unpersist()
    counts["deleted"] = 0
    if head is not None and not prefix:
        there.write("head.json", head)
        state = json.loads(head)
        known = [s["id"] for s in state["snapshots"]]
        stale = listing(spark, target).select(F.regexp_extract("name", r"^(?:blobs|entries|about)/([^/]+?)(?:\.json)?(?:/|$)", 1).alias("id"), "name")
        stale = stale.where((F.col("id") != "") & ~F.col("id").isin(known)).groupBy("id").agg(F.count("*").alias("n"))
        for r in stale.toLocalIterator():
            for part in (f"entries/{r['id']}", f"blobs/{r['id']}", f"about/{r['id']}.json"):
                there.delete(part)
            counts["deleted"] += r["n"]
    return counts


def restore(spark: SparkSession, source: str, target: str, *, everything: bool = False, shared: bool = True) -> bool:
    """Brings the newest version that is whole at ``source`` (and its base) to ``target``; False if there is none."""
    here = Files(spark, source)
    head = here.read("head.json")
    if head is None:
        return False
    state = json.loads(head)

    held = {s["id"]: s for s in state["snapshots"] if s["finalized"] and complete_files(here, s["id"])}
    usable = [s for s in held.values() if s["base"] is None or s["base"] in held]
    if not usable:
        return False
    last = usable[-1]
    chosen = usable if everything else [s for s in usable if s["id"] in (last["id"], last["base"])]
    ids = [s["id"] for s in chosen]
    there = Files(spark, target)
    there.fs.mkdirs(there.path(""))
    names = listing(spark, source)
    names = names.where(F.regexp_extract("name", r"^(?:blobs|entries|about)/([^/]+?)(?:\.json)?(?:/|$)", 1).isin(ids) | (F.col("name") == "pins.json"))
    transfer(spark, source, target, names, shared=shared)
    there.write("head.json", json.dumps(state | {"snapshots": chosen, "doomed": {}}))
    return True
