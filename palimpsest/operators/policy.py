"""Ordered glob rules: the first that matches decides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import parse_dtype
from ..functions.columns import glob_to_like

#: A policy with more rules than this isn't broadcast.
BROADCAST_RULES = 10_000


def rules_frame(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """``ord, pattern, like, dtype`` of rules as pairs of glob and dtype name."""
    rows = [(i, p, glob_to_like(p), parse_dtype(d)) for i, (p, d) in enumerate(rules)]
    return spark.createDataFrame(rows, "ord int, pattern string, like string, dtype string")


def first_match(names: DataFrame, rules: list[tuple[str, str]], *, name: str = "name", out: str = "dtype") -> DataFrame:
    """``names`` with the dtype of the first matching rule, null for none.

    Rules are a literal CASE in the plan, so no join is needed; a rule ``none`` shadows later ones.
    """
    found = None
    for pattern, dtype in rules:
        match = F.col(name).like(glob_to_like(pattern))
        value = F.lit(parse_dtype(dtype))
        found = F.when(match, value) if found is None else found.when(match, value)
    return names.withColumn(out, found if found is not None else F.lit(None).cast("string"))


def dead_patterns(names: DataFrame, rules: DataFrame, *, name: str = "name") -> DataFrame:
    """Rules that match no name."""
    small = F.broadcast(rules) if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES else rules
    used = names.select(name).distinct().join(small, F.expr(f"`{name}` like `like`"), "inner").select("ord").distinct()
    return rules.join(used, "ord", "left_anti")


def casts_anything(rules: DataFrame) -> DataFrame:
    return rules.agg(F.coalesce(F.bool_or(F.col("dtype") != "none"), F.lit(False)).alias("casts_anything"))
