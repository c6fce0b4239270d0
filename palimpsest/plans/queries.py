"""Queries over the driver's tables, each one operator of the package.

Histories come from ``events``: a user is a store, events in order of time its snapshots;
every eleventh is a full, errors are unfinalized deltas, and some are pinned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codec, columns
from ..operators import history, policy, versions

#: Rules of the policy query, first match wins.
RULES = [("*BRUSHED*", "bf16"), ("*/Brand#1*", "fp8"), ("PROMO*", "none"), ("*STEEL*", "fp16"), ("*", "fp32")]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", F.row_number().over(w).cast("long").alias("pos"))
    delta = (F.col("pos") - 1) % 11 != 0
    return e.select(
        F.col("user_id").alias("store"), "pos", (F.col("pos") * 100).alias("step"), F.when(delta, F.col("pos") - (F.col("pos") - 1) % 11).alias("base"),
        (~delta | (F.col("event_type") != "error")).alias("finalized"), (F.col("event_id") % 29 == 0).alias("pinned"), "event_id", "event_type", "value",
    )


def entries(h: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "skipped").when(F.col("event_type") == "click", "delta").when(F.col("event_type") == "signup", "alias").otherwise("full")
    raw = F.col("event_id") % 900 + 100 + F.col("rank")
    return h.withColumn("rank", F.explode(F.array(F.lit(0), F.lit(1)))).select("store", "pos", "rank", kind.alias("kind"), raw.alias("raw_size"), (raw - F.col("event_id") % 97).alias("compressed_size"))


def _versions(spark, d):
    o = _read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    hashed = lambda df: df.select("o_orderkey", F.md5(F.concat_ws("|", "o_orderstatus", "o_orderpriority")).alias("h"), F.length(F.concat_ws("|", "o_orderstatus", "o_orderpriority")).alias("n"))
    base = hashed(o.where("o_orderkey % 10 <> 1"))
    target = hashed(o.where("o_orderkey % 10 <> 2").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus"))))
    return base, target


def _cents(spark, d, change=False):
    v = F.round(F.col("o_totalprice") * 100).cast("long")
    return _read(spark, d, "orders").select("o_orderkey", (F.when(F.col("o_orderkey") % 3 == 0, v + 7).otherwise(v) if change else v).alias("v"))


def classify(spark, d):
    base, target = _versions(spark, d)
    return versions.classify(target, base, ["o_orderkey"]).groupBy("kind").agg(F.count("*").alias("n"))


def dedup_plan(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", F.md5("text").alias("h"), "lang")
    return versions.dedup_plan(docs, ["h", "lang"], key="doc_id", order="doc_id").select("doc_id", "alias_of")


def dedup_plan_large(spark, d):
    """Aliases among texts of 4,096 bytes or more only."""
    docs = _read(spark, d, "documents").select("doc_id", F.md5("text").alias("h"), "lang", F.octet_length("text").alias("n"))
    return versions.dedup_plan(docs, ["h", "lang"], key="doc_id", order="doc_id", size="n").select("doc_id", "alias_of")


def classify_documents(spark, d):
    """Texts against a version in which every third is reversed and every fifth is itself a delta."""
    docs = _read(spark, d, "documents").select("doc_id", "text")
    hashed = lambda t: docs.select("doc_id", F.md5(t).alias("h"), F.octet_length(t).alias("n"))
    base = hashed(F.when(F.col("doc_id") % 3 == 0, F.reverse("text")).otherwise(F.col("text"))).withColumn("k", F.when(F.col("doc_id") % 5 == 0, "delta").otherwise("full"))
    return versions.classify(hashed(F.col("text")), base, ["doc_id"], base_kind="k", least=versions.LEAST_BYTES).select("doc_id", "kind")


def alias_chains(spark, d):
    """Owners at the end of chains of up to four hops, counted below zero towards a later key.

    Every fifth key from 1 on, both ways, is an owner.  Keys above 1 lead to the key before, keys
    below 1 to the key after: the remainder keeps the sign of what it divides, as in the SQL.
    """
    k = F.col("p_partkey")
    e = _read(spark, d, "part").select(k.cast("string").alias("name"), F.when((k - 1) % 5 != 0, F.when(k > 1, k - 1).otherwise(k + 1).cast("string")).alias("alias_of"))
    later = F.col("owner").cast("long") > F.col("name").cast("long")
    return versions.alias_owners(e).withColumn("hops", F.when(later, -F.col("hops")).otherwise(F.col("hops")))


def rank_totals(spark, d):
    """Sizes and kinds of each snapshot by rank."""
    e = entries(histories(spark, d))
    return e.groupBy("store", "pos", "rank").agg(F.sum("raw_size").alias("raw"), F.sum("compressed_size").alias("compressed"), F.count_if(F.col("kind").isin("skipped", "alias")).alias("skipped"))


def casts_anything(spark, d):
    """Whether any rule of each of two policies casts."""
    one = lambda name, rules: policy.casts_anything(policy.rules_frame(spark, rules)).select(F.lit(name).alias("policy"), "casts_anything")
    return one("mixed", RULES).unionByName(one("none", [("*", "none")]))


def object_keys(spark, d):
    return _read(spark, d, "pages").select("page_id", columns.object_key("/runs/a/", F.col("url")).alias("key"), columns.object_key("//", F.col("url")).alias("bare"))


def alias_resolve(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", F.md5("text").alias("h"), "lang", "n_chars")
    plan = versions.dedup_plan(docs, ["h", "lang"], key="doc_id", order="doc_id").withColumn("data", F.when(F.col("alias_of").isNull(), F.col("n_chars")))
    rows = plan.select(F.col("doc_id").cast("string").alias("name"), F.col("alias_of").cast("string").alias("alias_of"), "data")
    return versions.resolve_aliases(rows)


def xor_delta(spark, d):
    x = versions.xor_delta(_cents(spark, d), _cents(spark, d, True), ["o_orderkey"], "v")
    return x.select("o_orderkey", "delta", F.bit_count("delta").alias("bits"))


def apply_delta(spark, d):
    x = versions.xor_delta(_cents(spark, d), _cents(spark, d, True), ["o_orderkey"], "v")
    return versions.apply_delta(_cents(spark, d), x, ["o_orderkey"], "v")


def delta_density(spark, d):
    e = _read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x * 10).cast("int")).alias("a"))
    return e.select("vec_id", columns.array_density(columns.array_xor(F.col("a"), F.reverse("a"))).alias("density"))


def element_size(spark, d):
    t = _read(spark, d, "part").select("p_partkey", F.element_at(F.array(*[F.lit(x) for x in ("float32", "bfloat16", "int64", "bool", "complex128")]), (F.col("p_partkey") % 5 + 1).cast("int")).alias("dtype"))
    return t.select("p_partkey", "dtype", columns.element_size(F.col("dtype")).alias("bytes"))


def part_size(spark, d):
    return _read(spark, d, "orders").select("o_orderkey", columns.part_size(F.col("o_orderkey") * 20_000_000).alias("bytes"))


def pack_offsets(spark, d):
    docs = _read(spark, d, "documents").select("source", "doc_id", "n_chars")
    return docs.withColumn("offset", columns.pack_offset("n_chars", by=["source"], order="doc_id"))


def fp8_scale(spark, d):
    """Scales of embeddings, and of every fifth as zeros."""
    v = F.when(F.col("vec_id") % 5 == 0, F.transform("embedding", lambda x: x * F.lit(0.0).cast("float"))).otherwise(F.col("embedding"))
    return _read(spark, d, "embeddings").select("vec_id", columns.fp8_scale(v, 448.0).cast("double").alias("scale"))


def glob_first_match(spark, d):
    p = _read(spark, d, "part").select("p_partkey", F.concat("p_type", F.lit("/"), "p_brand").alias("name"))
    return policy.first_match(p, RULES).select("p_partkey", "dtype")


def dead_patterns(spark, d):
    p = _read(spark, d, "part").select(F.col("p_type").alias("name"))
    rules = policy.rules_frame(spark, [*RULES, ("NO SUCH*", "fp16"), ("*%*", "fp16")])
    return policy.dead_patterns(p, rules).select("ord", "pattern")


def list_snapshots(spark, d):
    h = histories(spark, d)
    return history.list_snapshots(h, entries(h))


def stats(spark, d):
    return history.stats(list_snapshots(spark, d))


def describe(spark, d):
    h = histories(spark, d)
    return entries(h).join(history.latest(h).select("store", "pos"), ["store", "pos"], "left_semi")


def load_latest(spark, d):
    return history.latest(histories(spark, d)).select("store", "pos", "event_id", "value")


def load_arrays(spark, d):
    wanted = _read(spark, d, "orders").where("o_orderkey % 100 = 0").select("o_orderkey")
    return versions.load_keys(_cents(spark, d), "o_orderkey", wanted)


def last_full(spark, d):
    return history.last_full(histories(spark, d)).select("store", "pos", "event_id")


def base_in_effect(spark, d):
    h = histories(spark, d).withColumn("is_full", F.col("base").isNull())
    return versions.base_in_effect(h, by=["store"]).select("store", "pos", "base_for")


def pending_deltas(spark, d):
    return history.pending_deltas(histories(spark, d))


def resume_step(spark, d):
    return history.resume_step(histories(spark, d))


def save_best(spark, d):
    e = _read(spark, d, "events").select("event_id", "user_id", "ts", "value")
    return history.improvements(e, by="user_id", order=["ts", "event_id"], metric="value").select("event_id", "user_id", "value")


def force_full_cadence(spark, d):
    steps = histories(spark, d).select("store", "pos", "step")
    return history.cadence(steps, max_deltas=10)


def force_full_capped(spark, d):
    return history.cadence(histories(spark, d).select("store", "pos", "step"), max_deltas=10, cap=1)


def resume_out_of_order(spark, d):
    """Steps of histories in which every seventh save has an earlier step than those before."""
    h = histories(spark, d).withColumn("step", F.when(F.col("pos") % 7 == 0, F.col("step") - 650).otherwise(F.col("step")))
    return history.resume_step(h)


def stats_without_fulls(spark, d):
    h = histories(spark, d)
    return history.stats(history.list_snapshots(h.where("base is not null"), entries(h)))


def force_full_gated(spark, d):
    steps = histories(spark, d).select("store", "pos", (F.col("event_id") * 10).alias("step"))
    return history.cadence(steps, max_deltas=10, every=10_000_000).select("store", "pos", "is_full", "base")


def rollback_safe(spark, d):
    return history.rollback_safe(histories(spark, d), interval=200, keep=2).select("store", "pos")


def protected(spark, d):
    return history.protected(histories(spark, d), interval=200, keep=2)


def retention_r1(spark, d):
    h = histories(spark, d)
    return history.retain_fulls(h, history.protected(h), max_full=3).select("event_id")


def retention_r2(spark, d):
    h = histories(spark, d)
    return history.retain_total(h, history.protected(h), cap=20).select("event_id")


def stride_survivors(spark, d):
    return history.stride_fold(histories(spark, d), stride=2).select("event_id")


def full_merge_plan(spark, d):
    return history.full_merge_plan(histories(spark, d))


def finalize_complete(spark, d):
    li = _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return history.complete(li, by=["l_orderkey"], part="l_linenumber", expected=F.max("l_linenumber").cast("long"))


def sync_absent(spark, d):
    docs = _read(spark, d, "documents").select("doc_id")
    return versions.absent(docs, _read(spark, d, "labels").select("doc_id"), ["doc_id"])


def reachable(spark, d):
    h = histories(spark, d)
    files = h.select("store", "pos", "base", F.col("event_id").alias("path"))
    return history.reachable(files, h.where("event_id % 13 <> 0").select(F.col("event_id").alias("path")))


def recovery_order(spark, d):
    h = histories(spark, d)
    orphans = h.where("event_id % 3 = 0").select("store", "pos", "step", "base")
    return history.recovery_order(orphans, h.where("event_id % 3 = 1 and base is null")).select("store", "pos", "admit")


def codec_round_trip(spark, d):
    """Byte planes, zstd, hash and XOR of whole texts against their reversal; rows say whether all came back.

    A null text has a row of nulls beside its id.
    """
    t = _read(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("b"), F.reverse("text").cast("binary").alias("r"))
    packed = codec.as_udf(lambda a, b: codec.compress(codec.shuffle(codec.xor(a, b), 4)), "binary")
    made = t.select("doc_id", "b", "r", packed("b", "r").alias("z"))
    back = codec.as_udf(lambda z, b: codec.xor(b, codec.unshuffle(codec.decompress(z), 4)), "binary")
    return made.select("doc_id", codec.as_udf(codec.content_hash, "string")("b").alias("hash"), F.octet_length("z").alias("bytes"), (back("z", "b") == F.col("r")).alias("same"))


def narrow_floats(spark, d):
    """Sizes and largest errors of embeddings saved as narrow floats."""
    e = _read(spark, d, "embeddings").select("vec_id", "embedding")

    def error(kind):
        import numpy as np

        def one(v):
            x = np.asarray(v, "<f4")
            data, stored, scale = codec.cast_array(x.tobytes(), "float32", kind)
            back = np.frombuffer(codec.uncast_array(data, stored, "float32", scale), "<f4")
            return float(np.abs(back - x).max())

        return codec.as_udf(one, "double")("embedding")

    return e.select("vec_id", *[error(k).alias(k) for k in ("bfloat16", "float16", "float8_e4m3fn", "float8_e5m2")])


QUERIES = {f.__name__: f for f in (
    classify, classify_documents, dedup_plan, dedup_plan_large, alias_resolve, alias_chains, rank_totals, casts_anything, object_keys, xor_delta, apply_delta, delta_density, element_size, part_size, pack_offsets, fp8_scale,
    glob_first_match, dead_patterns, list_snapshots, stats, describe, load_latest, load_arrays, last_full, base_in_effect,
    pending_deltas, resume_step, save_best, force_full_cadence, force_full_capped, force_full_gated, resume_out_of_order, stats_without_fulls, rollback_safe, protected, retention_r1, retention_r2,
    stride_survivors, full_merge_plan, finalize_complete, sync_absent, reachable, recovery_order, codec_round_trip, narrow_floats,
)}
