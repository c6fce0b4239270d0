"""Comparing and reconstructing versions of keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: bytes below which content is neither stored as a delta nor as an alias.
LEAST_BYTES = 4096
#: Fixed value: hops that an alias may take to its owner.
MOST_HOPS = 8

def classify(target: DataFrame, base: DataFrame, keys: list[str], *, hash_col: str = "h", size_col: str = "n", base_kind: str | None = None, least: int = 0) -> DataFrame:
    """``target`` with ``kind``: skipped if the base holds the same content, delta if the same size, else full.

    A delta also needs ``least`` bytes, and, where ``base_kind`` names that column of the base,
    a base that is stored in full.  Keys must be unique in ``base``.  Only keys, hashes, sizes
    and kinds of the base are joined.
    """
    full = F.lit(True) if base_kind is None else F.col(base_kind) == "full"
    held = base.select(*keys, F.col(hash_col).alias("_base_hash"), F.col(size_col).alias("_base_size"), full.alias("_base_full"))
    delta = (F.col(size_col) == F.col("_base_size")) & F.col("_base_full") & (F.col(size_col) >= least)
    kind = F.when(F.col(hash_col) == F.col("_base_hash"), "skipped").when(delta, "delta").otherwise("full")
    return target.join(held, keys, "left").withColumn("kind", kind).drop("_base_hash", "_base_size", "_base_full")


def dedup_plan(df: DataFrame, content: list[str], *, key: str, order: str, size: str | None = None, least: int = LEAST_BYTES) -> DataFrame:
    """``df`` with ``alias_of``: the first row of equal content, null for that row itself.

    Where ``size`` names a column, rows of fewer than ``least`` bytes are no aliases.  The
    owner is found by a grouped minimum that combines before the shuffle, and rows take it
    by a join, so one content that very many rows share is no single task's work.
    """
    owner = df.groupBy(*content).agg(F.min_by(key, order).alias("_owner"))
    a, b = df.alias("a"), owner.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in content]
    other = F.col("b._owner") != F.col(f"a.{key}")
    if size is not None:
        other &= F.col(f"a.{size}") >= least
    return a.join(b, same).select("a.*", F.when(other, F.col("b._owner")).alias("alias_of"))


def alias_owners(entries: DataFrame, *, key: str = "name", alias: str = "alias_of") -> DataFrame:
    """``key, owner, hops`` of every entry: the end of its chain of aliases, itself for an owner.

    Chains take ``MOST_HOPS`` hops at most; a longer one, a cycle, or a name that isn't there raises.
    """
    links = entries.select(F.col(key).alias("_k"), F.col(alias).alias("_next"))
    at = entries.select(key, F.coalesce(alias, key).alias("owner"), F.when(F.col(alias).isNull(), 0).otherwise(1).alias("hops"), F.lit(True).alias("_open"))
    for _ in range(MOST_HOPS):
        joined = at.join(links, at["owner"] == links["_k"], "left")
        gone = F.raise_error(F.concat(F.lit("alias without owner: "), "owner"))
        step = F.col("_next").isNotNull()
        owner = F.when(F.col("_k").isNull(), gone).when(step, F.col("_next")).otherwise(F.col("owner"))
        at = joined.select(key, owner.alias("owner"), (F.col("hops") + step.cast("int")).alias("hops"), step.alias("_open"))
    looped = F.when(F.col("_open"), F.raise_error(F.concat(F.lit("aliases form a cycle or a chain too long: "), F.col(key)))).otherwise(F.col("owner"))
    return at.select(key, looped.alias("owner"), "hops")


def resolve_aliases(entries: DataFrame, *, key: str = "name", alias: str = "alias_of", payload: str = "data") -> DataFrame:
    """Payloads of aliases from their owners (one hop); a dangling alias raises."""
    owner = entries.where(F.col(alias).isNull()).select(F.col(key).alias("_k"), F.col(payload).alias("_p"))
    joined = entries.join(owner, F.col(alias) == F.col("_k"), "left")
    found = F.when(F.col(alias).isNull(), F.col(payload)).when(F.col("_k").isNotNull(), F.col("_p"))
    found = F.when(F.col(alias).isNotNull() & F.col("_k").isNull(), F.raise_error(F.concat(F.lit("alias without owner: "), F.col(alias)))).otherwise(found)
    return joined.select(*[c for c in entries.columns if c != payload], found.alias(payload))


def xor_delta(base: DataFrame, target: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys of both sides with ``delta``, the XOR of an integer column."""
    return base.select(*keys, F.col(value).alias("_b")).join(target.select(*keys, F.col(value).alias("_t")), keys).select(*keys, F.col("_b").bitwiseXOR(F.col("_t")).alias("delta"))


def apply_delta(base: DataFrame, delta: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The target of ``xor_delta``; keys without a delta keep the base's value, a delta without a base raises."""
    both = base.withColumn("_base", F.lit(True)).join(delta, keys, "full")
    whole = F.when(F.col("_base").isNull(), F.raise_error(F.lit("a delta has no base"))).otherwise(F.col(value).bitwiseXOR(F.coalesce("delta", F.lit(0))))
    return both.withColumn(value, whole).drop("delta", "_base")


def base_in_effect(snapshots: DataFrame, *, by: list[str], seq: str = "pos", is_full: Column | None = None) -> DataFrame:
    """``snapshots`` with ``base_for``: the last full before each in list order."""
    full = F.col("is_full") if is_full is None else is_full
    w = Window.partitionBy(*by).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    return snapshots.withColumn("base_for", F.last(F.when(full, F.col(seq)), ignorenulls=True).over(w))


def load_keys(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of the ``wanted`` keys; one that is missing raises when it is read."""
    held = df.withColumn("_here", F.lit(True))
    joined = wanted.select(key).distinct().join(held, key, "left")
    missing = F.when(F.col("_here").isNull(), F.raise_error(F.concat(F.lit("no such key: "), F.col(key).cast("string")))).otherwise(F.lit(True))
    return joined.where(missing).drop("_here")


def absent(wanted: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """What has to be copied: listed here, not there; compared by name only."""
    return wanted.join(held.select(*keys), keys, "left_anti")
