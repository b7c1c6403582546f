"""The keyed store: merges in place, rewrites only what it touches, and survives a lost writer."""

import glob
import os
from datetime import datetime

from tallyspark.sources.keyed_store import KeyedStore

A, B, C = datetime(2024, 1, 1), datetime(2024, 1, 2), datetime(2024, 1, 3)


def rows(spark, keys, value, t):
    return spark.createDataFrame([(k, value, t) for k in keys], "text_hash string, v long, last_updated_at timestamp")


def content(store):
    return {r["text_hash"]: r["v"] for r in store.read().collect()}


def files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/__part=*/*.parquet")}


def test_upserts_keep_the_last_write_and_touch_few_folders(spark, tmp_path):
    path = str(tmp_path / "store")
    store = KeyedStore(spark, path, partitions=8)
    assert store.read() is None and store.lookup(rows(spark, "ab", 0, A))[1].count() == 2
    keys = [f"k{i}" for i in range(60)]
    store.upsert(rows(spark, keys, 1, A))
    before = files(path)
    touched = store.upsert(rows(spark, ["k3", "new"], 2, B).unionByName(rows(spark, ["k3"], 3, C)))
    after = files(path)
    assert 1 <= len(touched) <= 2
    same = {f for f in before if f in after and before[f] == after[f]}
    assert {int(f.split("__part=")[1].split("/")[0]) for f in same} == set(range(8)) - set(touched)
    assert content(store) == {k: 1 for k in keys} | {"k3": 3, "new": 2}
    store.upsert(rows(spark, ["k3"], 9, A))  # an older write does not win
    assert content(store)["k3"] == 3
    hits, misses = store.lookup(rows(spark, ["k1", "k1", "nothing"], 0, A))
    assert [r["v"] for r in hits.collect()] == [1] and [r[0] for r in misses.collect()] == ["nothing"]
    assert store.upsert(rows(spark, [], 0, A)) == [] and len(content(store)) == 61


def test_a_committed_stage_is_replayed_and_a_torn_one_dropped(spark, tmp_path):
    path = str(tmp_path / "store")
    store = KeyedStore(spark, path, partitions=4)
    store.upsert(rows(spark, ["a", "b"], 1, A))
    store.stage(rows(spark, ["a"], 2, B))  # the writer is lost after the commit mark
    torn = store.stage(rows(spark, ["b"], 7, B))
    os.remove(f"{torn}/_SUCCESS")  # another before it
    assert content(KeyedStore(spark, path, partitions=4)) == {"a": 2, "b": 1}
    assert not os.path.exists(torn) and store.recover() == 0
