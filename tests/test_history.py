import random

import pytest

from palimpsest.operators import history, policy, versions

SCHEMA = "store int, pos long, step long, base long, finalized boolean, pinned boolean"


def histories(n, seed=3):
    r = random.Random(seed)
    rows = []
    for store in range(n):
        full = None
        for pos in range(1, r.randint(1, 10)):
            base = None if full is None or r.random() < 0.35 else full
            rows.append((store, pos, pos * 10, base, r.random() < 0.8, r.random() < 0.15))
            if base is None and rows[-1][4]:
                full = pos
    return rows


def by_store(rows):
    out = {}
    for x in rows:
        out.setdefault(x[0], []).append(x)
    return out


def shielded(rows):
    out = {x[1] for x in rows if x[5]}
    return out | {x[3] for x in rows if x[5] and x[3]}


def loop_fulls(rows, most):
    rows, keep = list(rows), shielded(rows)
    while sum(x[3] is None and x[4] for x in rows) > most:
        free = [x for x in rows if x[3] is None and x[4] and x[1] not in keep]
        if not free:
            break
        rows = [x for x in rows if free[0][1] not in (x[1], x[3])]
    return rows


def loop_total(rows, cap):
    rows, keep = list(rows), shielded(rows)
    while True:
        done = [x for x in rows if x[4]]
        if len(done) <= cap:
            return rows
        free = [x for x in done if x is not done[-1] and x[1] not in keep and (x[3] is not None or not any(y[3] == x[1] for y in rows))]
        if not free:
            return rows
        rows.remove(free[0])


def places(df):
    return {(r["store"], r["pos"]) for r in df.collect()}


def test_retention_agrees_with_the_loops(spark):
    rows = histories(1500)
    h = spark.createDataFrame(rows, SCHEMA).repartition(4).cache()
    prot = history.protected(h)
    for most in (0, 1, 2):
        want = {(x[0], x[1]) for own in by_store(rows).values() for x in loop_fulls(own, most)}
        assert places(history.retain_fulls(h, prot, max_full=most)) == want
    for cap in (1, 3, 5):
        want = {(x[0], x[1]) for own in by_store(rows).values() for x in loop_total(own, cap)}
        assert places(history.retain_total(h, prot, cap=cap)) == want


def test_newest_survives_the_cap_on_fulls(spark):
    h = spark.createDataFrame([(0, 1, 1, None, True, True), (0, 2, 2, None, True, False)], SCHEMA)
    prot = history.protected(h)
    assert places(history.retain_fulls(h, prot, max_full=1)) == {(0, 1)}
    assert places(history.retain_fulls(h, prot, max_full=1, keep_newest=True)) == {(0, 1), (0, 2)}


def test_gated_cadence_agrees_with_the_loop(spark):
    r = random.Random(5)
    steps = [(s, p, sum(r.choice([1, 5, 40]) for _ in range(p))) for s in range(60) for p in range(1, 15)]
    got = {(x["store"], x["pos"]): x["is_full"] for x in history.cadence(spark.createDataFrame(steps, "store int, pos long, step long"), max_deltas=3, every=60).collect()}
    for store in range(60):
        full = at = None
        for _, pos, step in sorted(x for x in steps if x[0] == store):
            due = full is None or max(0, step - at) >= 60 or pos - full - 1 >= 3
            if due:
                full, at = pos, step
            assert got[store, pos] == due


def test_stride_and_merge(spark):
    rows = [(0, 1, 1, None, True, False), (0, 2, 2, 1, True, False), (0, 3, 3, 1, False, False), (0, 4, 4, 1, True, False), (1, 1, 1, None, True, False), (1, 2, 2, 1, True, False)]
    h = spark.createDataFrame(rows, SCHEMA)
    assert places(history.stride_fold(h, stride=3)) == {(0, 1), (0, 3), (0, 4), (1, 1), (1, 2)}
    plan = {r["store"]: (r["pos"], r["base"], r["merged_deltas"]) for r in history.full_merge_plan(h).collect()}
    assert plan == {0: (4, 1, 2), 1: (2, 1, 1)}


def test_policy(spark):
    names = spark.createDataFrame([("a.weight",), ("b%x",), ("c_bias",), ("abias",)], "name string")
    got = {r["name"]: r["dtype"] for r in policy.first_match(names, [("*.weight", "bf16"), ("b%*", "none"), ("*_bias", "fp16")]).collect()}
    assert got == {"a.weight": "bfloat16", "b%x": "none", "c_bias": "float16", "abias": None}
    rules = policy.rules_frame(spark, [("*", "none"), ("zzz", "fp8")])
    assert [r["pattern"] for r in policy.dead_patterns(names, rules).collect()] == ["zzz"]
    assert policy.casts_anything(rules).first()[0] and not policy.casts_anything(policy.rules_frame(spark, [("*", "none")])).first()[0]


def test_missing_key_is_named(spark):
    import pytest

    df = spark.createDataFrame([("a", 1)], "k string, v int")
    with pytest.raises(Exception, match="no such key: b"):
        versions.load_keys(df, "k", spark.createDataFrame([("a",), ("b",)], "k string")).collect()


def test_dangling_alias_raises(spark):
    import pytest

    df = spark.createDataFrame([("a", "gone", None)], "name string, alias_of string, data int")
    with pytest.raises(Exception, match="alias without owner"):
        versions.resolve_aliases(df).collect()


def test_alias_chains_end_or_raise(spark):
    from palimpsest.operators import versions

    rows = [("a", None), *[(chr(98 + i), chr(97 + i)) for i in range(8)]]
    got = {r["name"]: (r["owner"], r["hops"]) for r in versions.alias_owners(spark.createDataFrame(rows, "name string, alias_of string")).collect()}
    assert got == {chr(97 + i): ("a", i) for i in range(9)}
    for bad, word in ([("x", "y"), ("y", "x")], "cycle"), ([("x", "gone")], "without owner"), ([*rows, ("z", "i")], "too long"):
        with pytest.raises(Exception, match=word):
            versions.alias_owners(spark.createDataFrame(bad, "name string, alias_of string")).collect()


def test_a_delta_without_a_base_raises(spark):
    from palimpsest.operators import versions

    base, delta = spark.createDataFrame([(1, 5)], "k long, v long"), spark.createDataFrame([(2, 3)], "k long, delta long")
    with pytest.raises(Exception, match="no base"):
        versions.apply_delta(base, delta, ["k"], "v").collect()
