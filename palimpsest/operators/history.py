"""Questions about histories of snapshots.

A history has a row per snapshot: ``store`` (whose history), ``pos`` (place in list order),
``step``, ``base`` (``pos`` of the full that a delta is against, null for a full),
``finalized`` and ``pinned``.  All stores are answered at once; everything is windows,
grouped aggregates and equi-joins on the store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_full() -> Column:
    return F.col("base").isNull()


def _store() -> Window:
    return Window.partitionBy("store").orderBy("pos")


def list_snapshots(history: DataFrame, entries: DataFrame) -> DataFrame:
    """Finalized snapshots with sums of sizes and counts of kinds over their entries; zeros for one without entries."""
    kind = lambda k: F.sum(F.when(F.col("kind").isin(*k), 1).otherwise(0)).alias(f"{k[0]}_tensors")
    totals = entries.groupBy("store", "pos").agg(
        F.sum("compressed_size").alias("total_compressed"), F.sum("raw_size").alias("total_raw"),
        kind(("skipped", "alias")), kind(("delta",)), kind(("full",)), F.countDistinct("rank").alias("ranks"),
    )
    done = history.where("finalized").select("store", "pos", "step", F.col("base").isNotNull().alias("is_delta"))
    return done.join(totals, ["store", "pos"], "left").fillna(0, [c for c in totals.columns if c not in ("store", "pos")])


def stats(listed: DataFrame) -> DataFrame:
    """Size statistics of each store from ``list_snapshots``: what is kept against what saving all in full would take.

    The naive cost takes the first full's raw size for every snapshot, or the first
    snapshot's where no full is left.
    """
    full = ~F.col("is_delta")
    first = F.coalesce(F.min_by("total_raw", F.when(full, F.col("pos"))), F.min_by("total_raw", "pos"))
    kinds = ("skipped_tensors", "delta_tensors", "full_tensors")
    g = listed.groupBy("store").agg(
        F.count("*").alias("total_snapshots"), F.count_if(full).alias("full_snapshots"), F.count_if("is_delta").alias("delta_snapshots"),
        *[F.sum(k).alias(k) for k in kinds], F.sum("total_raw").alias("total_raw_bytes"), F.sum("total_compressed").alias("total_compressed_bytes"),
        (first * F.count("*")).alias("estimated_naive_bytes"),
    )
    naive, raw, kept = F.col("estimated_naive_bytes"), F.col("total_raw_bytes"), F.col("total_compressed_bytes")
    return g.withColumns({
        "total_tensors_saved": F.col(kinds[0]) + F.col(kinds[1]) + F.col(kinds[2]),
        "compression_ratio": F.when(raw > 0, kept / raw).otherwise(1.0),
        "total_saved_bytes": naive - kept,
        "savings_percent": F.when(naive > 0, (naive - kept) / naive * 100).otherwise(0.0),
    })


def latest(history: DataFrame) -> DataFrame:
    """The last finalized snapshot of each store, in list order."""
    return history.where("finalized").groupBy("store").agg(F.max("pos").alias("pos")).join(history, ["store", "pos"])


def last_full(history: DataFrame) -> DataFrame:
    return history.where("finalized and base is null").groupBy("store").agg(F.max("pos").alias("pos")).join(history, ["store", "pos"])


def pending_deltas(history: DataFrame) -> DataFrame:
    """How many deltas the history ends with."""
    full = F.coalesce(F.max(F.when(is_full(), F.col("pos"))), F.lit(0))
    return history.groupBy("store").agg((F.max("pos") - full).alias("pending"))


def resume_step(history: DataFrame) -> DataFrame:
    """The step after that of the last finalized snapshot in list order; 0 without any."""
    newest = F.max(F.when(F.col("finalized"), F.struct("pos", "step")))
    return history.groupBy("store").agg(F.coalesce(newest["step"] + 1, F.lit(0)).alias("resume_step"))


def improvements(df: DataFrame, *, by: str, order: list[str], metric: str) -> DataFrame:
    """Rows whose metric is below all before; a store's first row always counts."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_best", F.min(metric).over(w)).where(F.col("_best").isNull() | (F.col(metric) < F.col("_best"))).drop("_best")


def cadence(steps: DataFrame, *, max_deltas: int, every: int | None = None, cap: int | None = None) -> DataFrame:
    """``steps(store, pos, step)`` with ``is_full`` and ``base``: when a full is due.

    A ``cap`` of one snapshot in all leaves no room for a delta beside its base.  Without a step gate it is every ``max_deltas + 1``-th.  With one, a fold over the ordered
    steps of a store carries the last full.
    """
    if cap is not None and cap <= 1:
        return steps.withColumn("is_full", F.lit(True)).withColumn("base", F.lit(None).cast("bigint"))
    if every is None:
        due = (F.col("pos") - 1) % (max_deltas + 1) == 0
        return steps.withColumn("is_full", due).withColumn("base", F.when(~due, F.col("pos") - (F.col("pos") - 1) % (max_deltas + 1)))
    rows = steps.groupBy("store").agg(F.array_sort(F.collect_list(F.struct("pos", "step"))).alias("xs"))
    start = F.struct(F.lit(None).cast("bigint").alias("full"), F.lit(None).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("fulls"))

    def fold(acc: Column, x: Column) -> Column:
        gap = F.greatest(x["step"].cast("bigint") - acc["at"], F.lit(0))
        due = acc["full"].isNull() | (gap >= every) | (x["pos"] - acc["full"] > max_deltas)
        return F.struct(F.when(due, x["pos"].cast("bigint")).otherwise(acc["full"]).alias("full"), F.when(due, x["step"].cast("bigint")).otherwise(acc["at"]).alias("at"), F.concat(acc["fulls"], F.array(F.when(due, x["pos"].cast("bigint")).otherwise(acc["full"]))).alias("fulls"))

    folded = rows.withColumn("fulls", F.aggregate("xs", start, fold)["fulls"])
    out = folded.select("store", F.explode(F.arrays_zip("xs", "fulls")).alias("x")).select("store", "x.xs.pos", "x.xs.step", F.col("x.fulls").alias("_f"))
    return out.withColumn("is_full", F.col("_f") == F.col("pos")).withColumn("base", F.when(F.col("_f") != F.col("pos"), F.col("_f"))).drop("_f")


def rollback_safe(history: DataFrame, *, interval: int, keep: int) -> DataFrame:
    """The newest ``keep`` finalized fulls on the interval; 0 for either disables."""
    if not interval or not keep:
        return history.limit(0)
    fulls = history.where(F.col("finalized") & is_full() & (F.col("step") % interval == 0))
    rank = F.row_number().over(Window.partitionBy("store").orderBy(F.col("pos").desc()))
    return fulls.withColumn("_r", rank).where(F.col("_r") <= keep).drop("_r")


def protected(history: DataFrame, *, interval: int = 0, keep: int = 0) -> DataFrame:
    """``store, pos`` of what retention leaves alone: rollback-safe, pinned, and bases of pinned."""
    pinned = history.where("pinned")
    bases = pinned.where("base is not null").select("store", F.col("base").alias("pos"))
    return rollback_safe(history, interval=interval, keep=keep).select("store", "pos").union(pinned.select("store", "pos")).union(bases).distinct()


def _flagged(history: DataFrame, shielded: DataFrame) -> DataFrame:
    return history.join(shielded.withColumn("_prot", F.lit(True)), ["store", "pos"], "left").withColumn("_prot", F.coalesce("_prot", F.lit(False)))


def retain_fulls(history: DataFrame, shielded: DataFrame, *, max_full: int, keep_newest: bool = False) -> DataFrame:
    """What is left when the oldest unprotected fulls above ``max_full`` go with their deltas.

    ``keep_newest`` never evicts the newest finalized snapshot nor its base.
    """
    h = _flagged(history, shielded)
    full = F.col("finalized") & is_full()
    if keep_newest:
        newest = Window.partitionBy("store")
        last = F.max_by(F.coalesce("base", "pos"), F.when(F.col("finalized"), F.col("pos"))).over(newest)
        h = h.withColumn("_prot", F.col("_prot") | F.coalesce(F.col("pos") == last, F.lit(False)))
    free = F.when(full & ~F.col("_prot"), 1).otherwise(0)
    running = F.sum(free).over(_store().rowsBetween(Window.unboundedPreceding, 0))
    excess = F.sum(F.when(full, 1).otherwise(0)).over(Window.partitionBy("store")) - max_full
    dead = h.withColumn("_n", running).withColumn("_x", excess).where((free == 1) & (F.col("_n") <= F.col("_x"))).select("store", F.col("pos").alias("_dead"))
    group = F.coalesce("base", "pos")
    return history.withColumn("_dead", group).join(dead, ["store", "_dead"], "left_anti").select(*history.columns)


def retain_total(history: DataFrame, shielded: DataFrame, *, cap: int) -> DataFrame:
    """What is left when the oldest removable snapshots above ``cap`` go, a full only after its deltas.

    The newest finalized snapshot always stays.
    """
    h = _flagged(history, shielded)
    store = Window.partitionBy("store")
    newest = F.max(F.when(F.col("finalized"), F.col("pos"))).over(store)
    total = F.sum(F.when(F.col("finalized"), 1).otherwise(0)).over(store)
    h = h.withColumn("_total", total).withColumn("_free", F.col("finalized") & (F.col("pos") != newest) & ~F.col("_prot"))
    deps = h.where("base is not null").groupBy("store", F.col("base").alias("pos")).agg(F.bool_and("_free").alias("_all"), F.max("pos").alias("_last"))
    h = h.join(deps, ["store", "pos"], "left")
    out = h.where(F.col("_free") & (F.col("base").isNotNull() | F.coalesce("_all", F.lit(True))))
    order = Window.partitionBy("store").orderBy(F.greatest("pos", F.coalesce("_last", "pos")), is_full(), "pos")
    dead = out.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= F.col("_total") - cap).select("store", "pos")
    return history.join(dead, ["store", "pos"], "left_anti")


def _tail(history: DataFrame) -> DataFrame:
    last = F.coalesce(F.max(F.when(is_full(), F.col("pos"))).over(Window.partitionBy("store")), F.lit(0))
    return history.withColumn("_full", last).where("pos > _full").drop("_full")


def stride_fold(history: DataFrame, *, stride: int) -> DataFrame:
    """What is left when runs of ``stride`` or more trailing deltas fold into the newest finalized one."""
    tail = _tail(history).withColumn("_n", F.count("*").over(Window.partitionBy("store"))).where(F.col("_n") >= stride)
    keep = tail.where("finalized").groupBy("store").agg(F.max(F.struct("pos", "base")).alias("_keep"))
    dead = tail.where("finalized").join(keep, "store").where((F.col("pos") != F.col("_keep.pos")) & F.col("base").eqNullSafe(F.col("_keep.base"))).select("store", "pos")
    return history.join(dead, ["store", "pos"], "left_anti")


def full_merge_plan(history: DataFrame) -> DataFrame:
    """For each store that ends in deltas: the newest finalized delta, its base, and how many deltas it replaces."""
    done = _tail(history).where("finalized")
    return done.groupBy("store").agg(F.max(F.struct("pos", "base", "step")).alias("x"), F.count("*").alias("merged_deltas")).select("store", F.col("x.pos").alias("pos"), F.col("x.base").alias("base"), F.col("x.step").alias("step"), "merged_deltas")


def complete(parts: DataFrame, *, by: list[str], part: str, expected: Column) -> DataFrame:
    """Groups of which all expected parts are there."""
    return parts.groupBy(*by).agg(F.countDistinct(part).alias("parts"), expected.alias("expected")).where("parts >= expected")


def reachable(files: DataFrame, held: DataFrame) -> DataFrame:
    """``store, pos`` of snapshots all of whose files are held, and whose base's are too."""
    state = files.join(held.select("path").distinct().withColumn("_h", F.lit(True)), "path", "left")
    whole = state.groupBy("store", "pos").agg(F.bool_and(F.coalesce("_h", F.lit(False))).alias("ok"), F.first("base", ignorenulls=True).alias("base")).where("ok")
    # a full answers to its own place, a delta to its base's: one shuffle groups both
    group = Window.partitionBy("store", F.coalesce("base", "pos"))
    based = F.max(F.when(F.col("base").isNull(), 1)).over(group)
    return whole.withColumn("_based", based).where("_based = 1").select("store", "pos")


def recovery_order(orphans: DataFrame, known_fulls: DataFrame) -> DataFrame:
    """Orphans that can be readmitted, oldest step first: fulls, and deltas whose base is known or readmitted."""
    fulls = orphans.where("base is null")
    bases = fulls.select("store", F.col("pos").alias("base")).union(known_fulls.select("store", F.col("pos").alias("base")))
    deltas = orphans.where("base is not null").join(bases.distinct(), ["store", "base"], "left_semi").select(*orphans.columns)
    both = fulls.unionByName(deltas)
    return both.withColumn("admit", F.row_number().over(Window.partitionBy("store").orderBy("step", "pos")))
