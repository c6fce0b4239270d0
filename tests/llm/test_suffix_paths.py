"""Every path of the suffix operator, run without Spark so that its bounds can be set small, against brute force."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from palimpsest.llm import suffix


def brute(docs):
    seen, out = set(), {}
    for key, t in docs:
        cover = np.zeros(len(t), bool)
        for j in range(len(t) - 99):
            if t[j : j + 100] in seen:
                cover[j : j + 100] = True
            seen.add(t[j : j + 100])
        out[key] = cover
    return out


def batches(docs, n):
    for i in range(0, len(docs), n):
        part = docs[i : i + n]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.int64()), pa.array([t for _, t in part], pa.binary())], names=["key", "text"])


def covered(docs, *, n_buckets=1, n_sorted=1, tasks=1, batch=3):
    """What the operator's stages remove, tasks and buckets in a row."""
    scanned = []
    for t in range(tasks):
        for out in suffix._scan(100, n_buckets)(batches(docs[t::tasks], batch)):
            scanned += out.to_pylist()
    scanned = pd.DataFrame(scanned, columns=["kind", "bucket", *(x for x, _ in suffix._PACK)])
    resolved = pd.concat([suffix._resolve(g) for _, g in scanned.groupby("bucket")] or [pd.DataFrame({c: [] for c in ("kind", "key", "grp", "at", "lead", "n", "hot")})])
    runs = [resolved[resolved["kind"] == 1][["key", "at", "n"]]]
    asked = resolved[resolved["kind"] == 2]
    text = dict(docs)
    rows = [(k, text[k], g[["grp", "at", "lead", "n", "hot"]].to_dict("records")) for k, g in asked.groupby("key")]
    if rows:
        kind = pa.list_(pa.struct([("grp", pa.int64()), ("at", pa.int64()), ("lead", pa.int32()), ("n", pa.int32()), ("hot", pa.bool_())]))
        source = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], kind)], names=["key", "text", "runs"])
        contexts = pd.concat([b.to_pandas() for b in suffix._contexts(100, n_sorted)(iter([source]))])
        runs += [suffix._sort_bucket(100)(g) for _, g in contexts.groupby("bucket")]
    out = {k: np.zeros(len(t), bool) for k, t in docs}
    for key, at, n in pd.concat(runs).itertuples(index=False):
        out[int(key)][int(at) : int(at) + int(n) + 99] = True
    return out


def agrees(docs, **how):
    want, got = brute(docs), covered(docs, **how)
    return all((want[k] == got[k]).all() for k in want)


def corpus(seed, n=40):
    r = random.Random(seed)
    text = lambda k: bytes(r.choices(b"abcdefgh ", k=k))
    shared = [text(130), text(400), text(1500), b"q" * 250]
    docs = []
    for i in range(n):
        parts = [text(r.randrange(0, 300))]
        for _ in range(r.randrange(0, 4)):
            s = r.choice(shared)
            a = r.randrange(0, len(s) // 2)
            parts += [s[a : a + r.randrange(60, len(s))], text(r.randrange(0, 40))]
        docs.append((i, b"".join(parts)))
    docs += [(n, docs[3][1]), (n + 1, b""), (n + 2, docs[5][1] * 3), (n + 3, shared[2])]
    return docs


def test_nothing_repeats():
    r = random.Random(1)
    assert agrees([(i, bytes(r.choices(range(256), k=400))) for i in range(3)])


def test_one_task_has_no_repeat_of_its_own():
    r = random.Random(2)
    t = bytes(r.choices(b"abcd", k=500))
    assert agrees([(1, t), (2, t)], tasks=2) and agrees([(1, t), (2, t[:300]), (3, b"x" + t)], tasks=3)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("how", [{}, {"n_buckets": 8, "n_sorted": 4, "tasks": 3}, {"n_buckets": 1 << 20, "n_sorted": 64, "tasks": 2}])
def test_plain(seed, how):
    assert agrees(corpus(seed), **how)


@pytest.mark.parametrize("seed", range(3))
def test_hot_anchors_in_tasks(monkeypatch, seed):
    monkeypatch.setattr(suffix, "LOCAL_HOT", 2)
    assert agrees(corpus(seed), n_buckets=4, n_sorted=8, tasks=3)


@pytest.mark.parametrize("seed", range(3))
def test_hot_anchors_in_buckets(monkeypatch, seed):
    monkeypatch.setattr(suffix, "HOT", 2)
    assert agrees(corpus(seed), n_buckets=4, n_sorted=8, tasks=2)


@pytest.mark.parametrize("seed", range(3))
def test_small_flushes(monkeypatch, seed):
    monkeypatch.setattr(suffix, "FLUSH", 20)
    monkeypatch.setattr(suffix, "LOCAL_HOT", 4)
    assert agrees(corpus(seed), n_buckets=4, n_sorted=2, tasks=2, batch=1)


def test_texts_over_several_chunks():
    r = random.Random(5)
    t = bytes(r.choices(b"abcdefgh", k=suffix.CHUNK + 5000))
    docs = [(1, t), (2, t[suffix.CHUNK - 300 : suffix.CHUNK + 300]), (3, t[-700:] + t[:400])]
    assert agrees(docs, n_buckets=4) and agrees(docs, n_buckets=4, tasks=3)


def scanned_records(docs, n_buckets):
    """Records of each kind by bucket."""
    out = {}
    for part in suffix._scan(100, n_buckets)(batches(docs, 100)):
        for x in part.to_pylist():
            out.setdefault(x["kind"], []).append((x["bucket"], len(x["n"])))
    return {kind: np.bincount([b for b, _ in v], weights=[n for _, n in v], minlength=n_buckets) for kind, v in out.items()}


def test_least_hashes_fill_all_buckets():
    r = random.Random(6)
    by = scanned_records([(i, r.randbytes(1000)) for i in range(2000)], 32)[0]
    assert by.max() < 1.5 * by.mean()


def test_records_of_one_anchor_that_are_not_compared_fill_all_buckets(monkeypatch):
    monkeypatch.setattr(suffix, "PASSED", 64, raising=False)
    r = random.Random(7)
    common = r.randbytes(90)
    docs = [(i, r.randbytes(90) + common + r.randbytes(90)) for i in range(3000)]
    docs += [(3000 + i, b"same" * 30) for i in range(3000)]
    by = scanned_records(docs, 8)
    assert all(by[kind].max() < 0.5 * by[kind].sum() for kind in (1, 2))
    assert agrees(docs[:500] + docs[-500:], n_buckets=8, n_sorted=4, tasks=2, batch=100)
