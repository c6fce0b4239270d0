"""Mixing sources to target weights by a time-varying curriculum (DataFrame functions only).

Each source has a weight schedule over training time t in [0, 1].  Its integral is the
source's weight; targets follow from the weights by water-filling under a repetition
limit.  Documents of a source are laid end to end in a pseudo-random order, which gives
each an interval of the source's cumulative token demand; inverting the integrated
schedule at the middle of that interval assigns the document a training position, and
the result is range-sorted by position.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, ascii_words_count, bucket_count, table

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: The mix takes this share of all words, and no source more than MAX_REPEATS times its own.
SHARE_NUM, SHARE_DEN, MAX_REPEATS = 3, 2, 2
#: Schedules fall or rise linearly by this part of the mean weight, in turns by rank.
TILT = 0.5
#: Rows that one window task orders within a source.
ROWS_PER_BLOCK = 20_000


def _ranked_sources(ws: Workspace, docs: DataFrame) -> DataFrame:
    """One row per source with its size and its rank in code-point order, null last.

    The rank is that of a range sort: offsets of the sorted partitions plus the place
    inside, so no task sees all sources.
    """
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = ws.save(
        sizes.orderBy(F.col("source").isNull(), "source").withColumn("_at", F.monotonically_increasing_id()), "sources"
    )
    part = F.shiftright("_at", 33)
    counts = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # one row per partition of the sort
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (
        ordered.withColumn("_part", part)
        .join(offsets, "_part")
        .withColumn("rank", F.col("_off") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .select("source", "source_size", "rank")
    )


def source_targets(ws: Workspace, docs: DataFrame, weights=WEIGHTS, share=(SHARE_NUM, SHARE_DEN), max_repeats=MAX_REPEATS) -> DataFrame:
    """``source, source_size, rank, weight, target``: water-filling of the whole share.

    A source whose part by weight exceeds ``max_repeats`` times its size stops there; what
    it can't take is shared again by weight among the others until none is above.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ws.save(_ranked_sources(ws, docs).withColumn("weight", weight.cast("long")), "ranked")
    # a pass fixes the sources that the level of the pass before fills; sums stay exact integers
    limit = F.col("source_size") * max_repeats
    total = int(ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("z")).first()["z"])
    num, den = 0, 1
    while True:
        whole = lambda x: F.lit(Decimal(x)).cast("decimal(38,0)")
        full = (limit * whole(den) <= F.col("weight") * whole(num)) if num else F.col("source_size") <= 0
        left, w = ranked.agg(
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)),
        ).first()
        rest = total * share[0] - int(left) * share[1]
        if not w or (rest, int(w) * share[1]) == (num, den):
            break
        num, den = rest, int(w) * share[1]
    level = F.lit(float(num)) * F.col("weight") / F.lit(float(den))
    target = F.when(full, limit.cast("double")).otherwise(level)
    return ranked.withColumn("target", target)


def mix(docs: DataFrame, *, weights=WEIGHTS, share=(SHARE_NUM, SHARE_DEN), max_repeats: int = MAX_REPEATS, tilt: float = TILT) -> DataFrame:
    """The mix of ``docs(doc_id, text, source)``, range-sorted by training position.

    Returns one row per input row: ``doc_id, source, size, source_size, target, taken,
    copies, position, positions, text_hash``.  ``taken`` counts the words the mix takes with repeats; a source's sum is
    its target to the word, except that every document of a source is first taken whole
    floor(target / size) times and one document at most is cut.  ``positions`` are the times
    in [0, 1] of its copies and ``position`` the first of them, null where nothing is taken.

    Null or blank texts have size 0 and take nothing.  A null source is a source of its
    own, last in order.  Ties and repeated rows are ordered by a hash of the id and then by
    text, so reruns agree.  An empty table gives an empty mix.  Other columns are ignored.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "mix")
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        ascii_words_count("text").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("_order"),
        F.xxhash64("text").alias("_tie"),
    )
    sized = ws.save(sized, "sized")
    targets = source_targets(ws, sized, weights, share, max_repeats)

    # prefix sums within a source, in blocks of the hash order so that a hot source is split
    n_blocks = min(65536, bucket_count(sized.count(), ROWS_PER_BLOCK))
    digits = F.conv(F.substring("_order", 1, 4), 16, 10).cast("long")
    blocked = sized.withColumn("_block", F.floor(digits * n_blocks / 65536).cast("int"))
    before = Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    per_block = blocked.groupBy("source", "_block").agg(F.sum("size").alias("_sum"))
    per_block = per_block.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    t, p = targets.alias("t"), per_block.alias("p")
    per_block = p.join(t, F.col("p.source").eqNullSafe(F.col("t.source"))).select("p.*", "t.source_size", "t.rank", "t.target")

    within = Window.partitionBy("source", "_block").orderBy("_order", "doc_id", "size", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    blocked = blocked.withColumn("_in", F.coalesce(F.sum("size").over(within), F.lit(0)))
    p, b = per_block.alias("p"), blocked.alias("b")
    laid = b.join(p, F.col("b.source").eqNullSafe(F.col("p.source")) & (F.col("b._block") == F.col("p._block"))).select(
        "b.doc_id", "b._tie", "b.source", "b.size", "p.source_size", "p.rank", "p.target", (F.col("p._base") + F.col("b._in")).alias("_from")
    )

    size, z, target = F.col("size"), F.col("source_size"), F.col("target")
    passes = F.when(z > 0, F.floor(target / z)).otherwise(0).cast("long")
    extra_all = F.round(target - passes * z).cast("long")
    extra = F.greatest(F.lit(0), F.least(size, extra_all - F.col("_from")))
    # schedule w(t) = 1 + s (1 - 2 t), integral C(t) = (1 + s) t - s t^2 with C(1) = 1, solved for t
    s = F.when(F.col("rank") % 2 == 0, F.lit(float(tilt))).otherwise(F.lit(-float(tilt)))
    one, two, four = F.lit(1.0), F.lit(2.0), F.lit(4.0)

    def at(copy):
        u = F.least(one, (copy * z + F.col("_from") + size / two) / target)
        return (two * u) / ((one + s) + F.sqrt((one + s) * (one + s) - four * s * u))

    mixed = laid.select(
        "doc_id", "_tie", "source", "size", z.cast("long").alias("source_size"), "target", "rank", "_from",
        (passes * size + extra).cast("long").alias("taken"), (passes + (extra > 0).cast("long")).alias("copies"),
    )
    mixed = mixed.withColumn("copies", F.when(F.col("taken") > 0, F.col("copies")).otherwise(0))
    mixed = mixed.withColumn("position", F.when(F.col("taken") > 0, at(F.lit(0))))
    copy = F.transform(F.sequence(F.lit(0), F.col("copies") - 1), at)
    mixed = mixed.withColumn("positions", F.when(F.col("copies") > 0, copy).otherwise(F.array().cast("array<double>")))
    return mixed.drop("rank", "_from").orderBy(F.col("position").asc_nulls_last(), "doc_id").withColumnRenamed("_tie", "text_hash")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "position")


ORACLE = """
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
         md5(coalesce(doc_id::varchar, '')) as ord
  from documents),
src as (
  select source, sum(size)::bigint as z, row_number() over (order by source nulls last) - 1 as rk from sized group by source),
weighted as (select *, case rk % 3 when 0 then 3 when 1 then 1 else 2 end as w from src),
steps as (
  select *, sum(z) over (order by z::double / w, rk rows between unbounded preceding and current row) as zcum,
         sum(w) over (order by z::double / w, rk rows between current row and unbounded following) as wrest,
         sum(z) over () as zall
  from weighted),
level as (
  -- the first source, in order of its limit, that the level does not fill
  select (3 * zall - 4 * (zcum - z))::bigint as num, (2 * wrest)::bigint as den
  from steps where 2 * z * (2 * wrest) > w * (3 * zall - 4 * (zcum - z)) order by z::double / w, rk limit 1),
target as (
  select s.source, s.rk, s.z, case when 2 * s.z * l.den <= s.w * l.num then (2 * s.z)::double else l.num::double * s.w / l.den::double end as target
  from weighted s, level l),
laid as (
  select d.doc_id, d.size, t.z, t.rk, t.target,
         coalesce(sum(d.size) over (partition by d.source order by d.ord, d.doc_id rows between unbounded preceding and 1 preceding), 0) as f,
         case when t.z > 0 then floor(t.target / t.z)::bigint else 0 end as passes
  from sized d join target t on d.source is not distinct from t.source),
taken as (
  select *, (passes * size + greatest(0, least(size, round(target - passes * z)::bigint - f)))::bigint as taken,
         least(1.0::double, (0 * z + f + size / 2.0::double) / target) as u,
         case when rk % 2 = 0 then 0.5::double else -0.5::double end as s
  from laid)
select doc_id, size, z as source_size, target, taken,
       case when taken > 0 then (2.0::double * u) / ((1.0::double + s) + sqrt((1.0::double + s) * (1.0::double + s) - 4.0::double * s * u)) end as position
from taken
"""
