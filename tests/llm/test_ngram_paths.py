"""The n-gram join beyond its bounds: split buckets, several blocks of a group, nearest rounds, shuffle joins."""

import random

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import ngram_join
from palimpsest.llm.common import Workspace


def brute(texts):
    sets = []
    for t in texts:
        w = t.encode().lower().split()
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = {}
    for i, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(i)
    seen = set()
    for own in by.values():
        for k, a in enumerate(own):
            for b in own[k + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    if 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]):
                        x, y = sorted((find(a), find(b)))
                        root[y] = x
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def family(r, n, words=60, edits=6):
    """Edits of one text: some pairs are linked, many are just not."""
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    base = [word() for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(r.randrange(0, edits)):
            own[r.randrange(words)] = word()
        out.append(" ".join(own))
    return out


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(df).collect()}


def test_group_of_several_blocks_and_rounds(spark, monkeypatch):
    r = random.Random(8)
    texts = family(r, 260, edits=9) + family(r, 60, words=30, edits=4) + [family(r, 1)[0] for _ in range(20)]
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "NEAREST", 1)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    calls, real = [], ngram_join._Join.residual

    def residual(self, roots, tried, label, nearest):
        pairs, partial = real(self, roots, tried, label, nearest)
        calls.append((nearest, partial))
        return pairs, partial

    monkeypatch.setattr(ngram_join._Join, "residual", residual)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert result(df) == brute(texts)
    assert calls[0][0] == 1 and any(p for _, p in calls)


@pytest.mark.parametrize("times", [0, 4])
def test_split_buckets(spark, monkeypatch, times):
    r = random.Random(9)
    texts = family(r, 150, edits=8) + family(r, 40, words=40)
    monkeypatch.setattr(ngram_join, "HOT_TIMES", times)
    monkeypatch.setattr(ngram_join, "BUCKET_WORDS", 400)
    monkeypatch.setattr(ngram_join, "bucket_count", lambda n, per: 1)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    join = ngram_join._Join(df, 5, 3, 4)
    join.sign()
    assert join.matched.where("part > 1").count() > 0
    assert result(df) == brute(texts)


def test_a_pair_is_said_by_one_group():
    x = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 80, dtype=np.uint64))
    y = np.append(x[:-1], x[-1] + np.uint64(1))
    said = []
    for grp in (3, 5):
        rows = [(grp, 0, 0, k, k, len(s), ngram_join.parity_sketch(s), 0, [3, 5]) for k, s in enumerate((x, y))]
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=list("abcdefghi"))
        said += [p for out in ngram_join._residual(3, 4, None)(iter([batch])) for p in zip(*(c.to_pylist() for c in out.columns), strict=True)]
    assert said == [(0, 1)]


def test_batches_are_bounded_only_while_a_table_is_written(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    ws = Workspace(spark, "test")
    assert ws.save(spark.range(3), "x").count() == 3 and spark.conf.get(name, None) == before
