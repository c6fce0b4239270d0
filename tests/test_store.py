import random
import uuid

import pytest

from palimpsest.sources import sync
from palimpsest.sources.store import ARRAYS, Locked, NotFound, Outcome, Retention, SnapshotStore
from palimpsest.streaming import saver


def frame(spark, arrays):
    rows = [(i, n, [len(d)], t, bytearray(d)) for i, (n, t, d) in enumerate(arrays)]
    return spark.createDataFrame(rows, ARRAYS)


def content(df):
    return {r["name"]: bytes(r["data"]) for r in df.collect()}


def kinds(store, snapshot_id=None):
    return {r["name"]: r["storage"] for r in store.describe(snapshot_id).collect()}


@pytest.fixture
def noise():
    r = random.Random(9)
    return bytearray(r.randbytes(50_000)), r.randbytes(20_000)


def test_versions_round_trip(spark, tmp_path, noise):
    w, tied = noise
    store = SnapshotStore(spark, str(tmp_path / "s"))
    arrays = lambda: [("w", "uint8", bytes(w)), ("t1", "float32", tied), ("t2", "float32", tied), ("tiny ü*", "uint8", b"abc"), ("empty", "uint8", b"")]
    first = store.save(frame(spark, arrays()), 1, {"a": "b"})
    assert kinds(store) == {"w": "full", "t1": "full", "t2": "alias", "tiny ü*": "full", "empty": "full"}
    before = content(store.load(first))
    w[7] ^= 255
    second = store.save(frame(spark, arrays()), 2)
    assert kinds(store) == {"w": "delta", "t1": "skipped", "t2": "alias", "tiny ü*": "skipped", "empty": "skipped"}
    assert content(store.load(first)) == before and content(store.load(second)) == {n: d for n, _, d in arrays()}
    assert content(store.load(second, ["t2"])) == {"t2": tied}
    with pytest.raises(NotFound, match="nothing"):
        store.load(second, ["nothing"])
    with pytest.raises(ValueError):
        store.load("no uuid")
    again = SnapshotStore(spark, str(tmp_path / "s"))
    assert again.resume_step() == 3 and content(again.load_latest()[1]) == content(store.load(second))
    # names swap places: what was an alias owns the bytes now
    third = store.save(frame(spark, [("t2", "float32", tied), ("t1", "float32", tied), ("new", "uint8", b"x")]), 3)
    assert content(store.load(third)) == {"t1": tied, "t2": tied, "new": b"x"}
    merged = store.merge()
    assert content(store.load(merged)) == {"t1": tied, "t2": tied, "new": b"x"}
    assert [s.id for s in store.snapshots] == [merged] and store.snapshots[0].metadata["merged_deltas"] == "2"


def test_ranks(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    new = store.create(5, world_size=2)
    store.save_rank(new, frame(spark, [("shard", "uint8", b"\1" * 100)]), 0)
    with pytest.raises(ValueError, match="1/2"):
        store.finalize(new)
    store.save_rank(new, frame(spark, [("shard", "uint8", b"\2" * 100)]), 1)
    store.finalize(new)
    assert [content(store.load(new, rank=r))["shard"][0] for r in (0, 1)] == [1, 2]


def test_policy_pins_best_and_recovery(spark, tmp_path):
    import numpy as np

    root = str(tmp_path / "s")
    store = SnapshotStore(spark, root, retention=Retention(max_full=1, max_deltas_per_full=0, max_total=1, rollback_interval=0), save_dtype=[("*bias", "none"), ("*", "bf16")])
    x = np.linspace(0, 1, 5000, dtype="<f4")
    arrays = frame(spark, [("w", "float32", x.tobytes()), ("bias", "float32", x.tobytes()), ("n", "int32", b"1234")])
    assert store.save_best(arrays, 1, 0.5) and store.save_best(arrays, 2, 0.7) is None
    d = {r["name"]: (r["dtype"], r["stored_dtype"]) for r in store.describe().collect()}
    assert d == {"w": ("float32", "bfloat16"), "bias": ("float32", "float32"), "n": ("int32", "int32")}
    back = np.frombuffer(content(store.load_latest()[1])["w"], "<f4")
    assert np.abs(back - x).max() < 0.01
    assert store.pin(1) and not store.pin(99) and store.pinned_steps() == [1]
    store.save(arrays, 3)
    assert sorted(s.step for s in store.snapshots) == [1, 3]
    assert store.unpin(1) and not store.unpin(1)
    store.save(arrays, 4)
    assert [s.step for s in store.snapshots] == [4]
    (tmp_path / "s/blobs/orphan").mkdir()
    again = SnapshotStore(spark, root)
    assert (tmp_path / "s/blobs/orphan").exists()  # opening deletes nothing
    assert again.recover() == ([], []) and again.recover(grace=0) == ([], ["orphan"])
    assert again.best == 0.5 and again.save_best(arrays, 5, 0.6) is None  # the best one was evicted
    assert content(again.load_latest()[1]) == content(store.load_latest()[1])


def test_damage_is_found(spark, tmp_path):
    from palimpsest.sources import store as module

    store = SnapshotStore(spark, str(tmp_path / "s"))
    new = store.save(frame(spark, [("w", "uint8", b"a" * 5000)]), 1)
    from pyspark.sql import functions as F

    path = str(tmp_path / "s/entries" / new)
    bad = store.entries(new).withColumn("hash_raw", F.lit("0" * 32)).collect()
    spark.createDataFrame(bad, module.ENTRIES).write.mode("overwrite").parquet(path)
    with pytest.raises(Exception, match="differ from their hash"):
        store.load(new).collect()


def test_sync_and_restore(spark, tmp_path):
    a, b, c = (str(tmp_path / x) for x in "abc")
    store = SnapshotStore(spark, a)
    for i in range(3):
        store.save(frame(spark, [("w", "uint8", bytes([i]) * 6000)]), i)
    first = sync.push(spark, a, b)
    assert first["synced"] > 0 and sync.push(spark, a, b) == {"synced": 0, "skipped": first["synced"], "vanished": 0, "deleted": 0}
    assert sync.restore(spark, b, c) and not sync.restore(spark, str(tmp_path / "none"), c)
    assert content(SnapshotStore(spark, c).load_latest()[1]) == {"w": b"\2" * 6000}
    assert len(SnapshotStore(spark, c).snapshots) == 2


def test_stream_saves_each_batch_once(spark, tmp_path):
    frame(spark, [("w", "uint8", b"q" * 100)]).write.parquet(str(tmp_path / "in"))
    store = SnapshotStore(spark, str(tmp_path / "s"))
    for checkpoint in ("c1", "c2"):  # the second replays the batch
        q = saver.save_stream(spark.readStream.schema(ARRAYS).parquet(str(tmp_path / "in")), store, str(tmp_path / checkpoint), name="q")
        q.awaitTermination()
    assert [s.step for s in store.snapshots] == [0] and content(store.load_latest()[1]) == {"w": b"q" * 100}
    assert [saver.due(n, 2) for n in range(1, 5)] == [False, True, False, True] and not saver.due(4, 0)


def test_replay_after_a_crash_saves_the_version(spark, tmp_path):
    root, name = str(tmp_path / "s"), str(uuid.uuid4())
    arrays = frame(spark, [("w", "uint8", b"a" * 5000)])
    for last in ("create", "save_rank", "finalize"):
        store = SnapshotStore(spark, root)
        if not any(s.id == name for s in store.snapshots):
            store.create(7, snapshot_id=name)
        if last != "create":
            store.save_rank(name, arrays, 0)
    with pytest.raises(NotFound):
        SnapshotStore(spark, root).latest()
    store = SnapshotStore(spark, root)
    assert store.save(arrays, 7, snapshot_id=name) == name
    again = SnapshotStore(spark, root)
    assert again.save(arrays, 7, snapshot_id=name) == name and len(again.snapshots) == 1
    assert content(again.load_latest()[1]) == {"w": b"a" * 5000}


def two_versions(spark, root, noise, **how):
    store, (w, _) = SnapshotStore(spark, root, **how), noise
    ids = []
    for step in (1, 2):
        w[step] ^= 255
        ids.append(store.save(frame(spark, [("w", "uint8", bytes(w))]), step))
    return store, ids, bytes(w)


def test_merge_beside_a_second_store_and_when_it_fails(spark, tmp_path, noise, monkeypatch):
    root = str(tmp_path / "s")
    store, ids, want = two_versions(spark, root, noise)
    real = SnapshotStore.save_rank

    def beside(self, *args):
        real(self, *args)
        SnapshotStore(spark, root).recover(grace=0)

    def broken(self, *args):
        raise OSError("disk")

    monkeypatch.setattr(SnapshotStore, "save_rank", broken)
    with pytest.raises(OSError):
        store.merge()
    assert [s.id for s in store.snapshots] == ids == [s.id for s in SnapshotStore(spark, root).snapshots]
    monkeypatch.setattr(SnapshotStore, "save_rank", beside)
    merged = store.merge()
    assert content(SnapshotStore(spark, root).load(merged)) == {"w": want}


def test_readers_keep_files_and_hold_up_merges(spark, tmp_path, noise):
    store, ids, want = two_versions(spark, str(tmp_path / "s"), noise, retention=Retention(max_full=1, max_deltas_per_full=1, max_total=2, rollback_interval=0))
    with store.reading(ids[1]):
        assert store.try_merge() == (Outcome.BUSY, None) and store.merge_now(wait=0) is Outcome.BUSY
        lazy = store.load(ids[1])
        store.save(frame(spark, [("w", "uint8", b"x" * 9000)]), 3)
        assert ids[1] not in [s.id for s in store.snapshots] and content(lazy) == {"w": want}
    assert set(store.sweep()) == set(ids) and not (tmp_path / "s/blobs" / ids[1]).exists()
    assert store.merge_now(wait=0) is Outcome.NOTHING


def test_one_writer(spark, tmp_path, noise):
    root = str(tmp_path / "s")
    store, _, _ = two_versions(spark, root, noise)
    with store.writing(), pytest.raises(Locked):
        SnapshotStore(spark, root).recover()
    assert SnapshotStore(spark, root).recover() == ([], [])


def test_orphans_come_back_whole_or_not_at_all(spark, tmp_path, noise):
    root = str(tmp_path / "s")
    store, ids, want = two_versions(spark, root, noise)
    damaged = store.save(frame(spark, [("w", "uint8", b"q" * 8000)]), 3)
    half = store.create(4, world_size=2)
    store.save_rank(half, frame(spark, [("w", "uint8", b"r" * 8000)]), 0)
    (tmp_path / "s/head.json").unlink()  # a head that never made it
    for x in (tmp_path / "s").glob(f"blobs/{damaged}/rank=0/*.parquet"):
        x.write_bytes(x.read_bytes()[: x.stat().st_size // 2])
    for x in (tmp_path / "s").glob(f"blobs/{damaged}/rank=0/.*.crc"):
        x.unlink()
    again = SnapshotStore(spark, root)
    assert again.snapshots == []
    taken, gone = again.recover(grace=0)
    assert taken == ids and sorted(gone) == sorted([damaged, half])
    assert content(SnapshotStore(spark, root).load_latest()[1]) == {"w": want}


def test_snapshots_without_files_are_dropped_with_their_deltas(spark, tmp_path, noise):
    import shutil

    root = str(tmp_path / "s")
    store, ids, _ = two_versions(spark, root, noise, retention=Retention(max_deltas_per_full=1))
    third = store.save(frame(spark, [("w", "uint8", b"z" * 9000)]), 3)
    shutil.rmtree(tmp_path / "s/blobs" / ids[0])
    again = SnapshotStore(spark, root)
    assert again.dropped == ids and [s.id for s in again.snapshots] == [third]
    assert content(again.load_latest()[1]) == {"w": b"z" * 9000}


def test_final_saves_reports_and_depth(spark, tmp_path, noise):
    w, _ = noise
    store = SnapshotStore(spark, str(tmp_path / "s"), retention=Retention(rollback_interval=0))
    assert store.report() == "no snapshots yet"
    for step in range(3):
        w[step] ^= 255
        store.save(frame(spark, [("w", "uint8", bytes(w))]), step)
    assert store.fold(stride=9) == [] and "3: 1 full, 2 delta" in store.report()
    assert len(store.fold(stride=9, max_chain=2)) == 3 and len(store.snapshots) == 1
    row = store.describe().first()
    assert (row["step"], row["is_delta"], row["base_snapshot_id"], row["ranks"]) == (2, False, None, 1)
    final = store.save_final(frame(spark, [("w", "uint8", bytes(w) + b"!")]), 9, sync_to=str(tmp_path / "copy"))
    assert store.latest().metadata["final"] == "true" and store.latest().base is None and final
    assert content(SnapshotStore(spark, str(tmp_path / "copy")).load_latest()[1]) == {"w": bytes(w) + b"!"}
    assert any(x.startswith(f"blobs/{store.latest().id}/rank=0/part-") for x in store.files_of(store.latest().id, 0))
    with pytest.raises(NotFound):
        store.describe(rank=3)


def test_sync_through_the_file_system_s_own_copy_deletes_and_prefix(spark, tmp_path, noise):
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    store, ids, want = two_versions(spark, a, noise, retention=Retention(rollback_interval=0))
    only = sync.push(spark, a, b, prefix=f"blobs/{ids[0]}", shared=False)
    assert only["synced"] > 0 and not (tmp_path / "b/head.json").exists()
    sync.push(spark, a, b, shared=False)
    assert content(SnapshotStore(spark, b).load_latest()[1]) == {"w": want}
    store.merge()
    done = sync.push(spark, a, b, shared=False)
    assert done["deleted"] > 0 and not (tmp_path / "b/blobs" / ids[0]).exists()
    assert sync.restore(spark, b, f"file://{tmp_path}/c", shared=False)
    assert content(SnapshotStore(spark, f"file://{tmp_path}/c").load_latest()[1]) == {"w": want}


def test_restore_passes_over_versions_with_missing_files(spark, tmp_path, noise):
    import shutil

    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    store, ids, _ = two_versions(spark, a, noise)
    shutil.rmtree(tmp_path / "a/blobs" / ids[1])
    assert sync.restore(spark, a, b) and [s.id for s in SnapshotStore(spark, b).snapshots] == [ids[0]]
