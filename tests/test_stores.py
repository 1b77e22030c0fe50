import os
import random

import pytest

from laborcast.sources.stores import BucketStore, merge_rows, replace_snapshots


def files(path):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def keyed(spark, rows):
    return spark.createDataFrame(rows, "k string, o int, v string")


def contents(store):
    return sorted(map(tuple, store.read().collect()), key=repr)


@pytest.mark.parametrize("keep", ["first", "last"])
def test_merge_against_a_dict(spark, tmp_path, keep):
    store, rng, want = BucketStore(spark, str(tmp_path / "t"), ["k"], buckets=8), random.Random(2), {}
    assert store.read() is None
    for number in range(4):
        rows = [(rng.choice([None, *"abcdefghij"]), 100 * number + i, f"{number}.{i}") for i in range(30)]
        assert merge_rows(store, keyed(spark, rows), order="o", keep=keep, batch_id=str(number))
        for k, o, v in rows:
            if keep == "last" or k not in want:
                want[k] = (k, o, v)
        assert contents(store) == sorted(want.values(), key=repr)
        assert not merge_rows(store, keyed(spark, [("a", 10**6, "again")]), order="o", keep=keep, batch_id=str(number))
        assert contents(store) == sorted(want.values(), key=repr)


def test_a_change_touches_only_the_buckets_of_its_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    store = BucketStore(spark, path, ["k"], buckets=16)
    merge_rows(store, keyed(spark, [(f"k{i}", i, "old") for i in range(200)]), order="o", keep="last")
    before, folders = files(path), store.manifest()["folders"]
    batch = keyed(spark, [("k7", 1000, "new")])
    met = [r["b"] for r in batch.select(store.bucket().alias("b")).collect()]
    plan = store.read(met)._jdf.queryExecution().executedPlan().toString()
    merge_rows(store, batch, order="o", keep="last")
    after = store.manifest()["folders"]
    assert [b for b in folders if folders[b] != after[b]] == [str(b) for b in met]
    assert all(files(path).get(f) == t for f, t in before.items()) and plan.count("InMemoryFileIndex(1 paths)") == 1
    assert {r.v for r in store.read().where("k = 'k7'").collect()} == {"new"} and store.read().count() == 200
    assert store.read(version=1).where("v = 'new'").count() == 0  # the version before can still be read
    assert store.expire() == 0 and store.read().count() == 200  # the first generation still holds the other buckets
    merge_rows(store, keyed(spark, [(f"k{i}", 2000 + i, "last") for i in range(200)]), order="o", keep="last")
    assert store.expire() == 2 and store.read().where("v = 'last'").count() == 200


def test_a_change_that_dies_or_comes_second_leaves_the_table(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path / "t"), ["k"], buckets=4)
    merge_rows(store, keyed(spark, [("a", 1, "x")]), order="o", keep="last")

    def dies(old, new):
        raise ValueError("lost")

    with pytest.raises(ValueError):
        store.change(keyed(spark, [("a", 2, "y")]), dies)
    assert contents(store) == [("a", 1, "x")]

    def overtaken(old, new):
        merge_rows(BucketStore(spark, store.path, ["k"]), keyed(spark, [("a", 5, "other")]), order="o", keep="last")
        return new

    with pytest.raises(RuntimeError):
        store.change(keyed(spark, [("a", 2, "y")]), overtaken)
    assert contents(store) == [("a", 5, "other")] and BucketStore(spark, store.path, ["k"], buckets=99).buckets == 4


def test_snapshots_replace_whole_markets(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path / "t"), ["role", "city"], buckets=4)
    schema = "role string, city string, fetched_at int, job int"
    put = lambda rows, number: replace_snapshots(store, spark.createDataFrame(rows, schema), batch_id=number)
    put([("a", "x", 5, 1), ("a", "x", 5, 2), ("a", "x", 4, 3), ("a", None, 5, 4), ("b", "y", 9, 5)], "0")
    assert contents(store) == [("a", "x", 5, 1), ("a", "x", 5, 2), ("a", None, 5, 4), ("b", "y", 9, 5)] or len(contents(store)) == 4
    put([("a", "x", 6, 7), ("a", None, 5, 8), ("b", "y", 8, 9), ("c", "z", 1, 10)], "1")
    want = {("a", "x", 6, 7), ("a", None, 5, 8), ("b", "y", 9, 5), ("c", "z", 1, 10)}
    assert set(contents(store)) == want and not put([("a", "x", 7, 11)], "1") and set(contents(store)) == want
    put([], "2")
    assert set(contents(store)) == want
