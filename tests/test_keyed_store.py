"""The store of runs: files opened, levels, crashes and newest rows."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from revgauge.operators import dedup
from revgauge.sources import keyed_store
from revgauge.sources.keyed_store import KeyedStore


def keyed(spark, a, b):
    return spark.range(a, b).select(F.col("id").alias("n"), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 16).alias("review_hash"))


def numbers(df):
    return sorted(r.n for r in df.collect()) if df is not None else []


def parquet_files(root):
    return sum(f.endswith(".parquet") for _, _, names in os.walk(root) for f in names)


def test_only_files_that_may_hold_a_key_are_opened(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path), "review_hash", rows_per_file=50, fanout=99)
    assert store.rows() is None and store.files_for(keyed(spark, 0, 5)) == [] and numbers(store.new_rows(keyed(spark, 0, 5))) == list(range(5))
    for a in (0, 1000, 2000):
        store.append(store.new_rows(keyed(spark, a, a + 1000)))
    assert store.rows().count() == 3000 and len(store.rows().inputFiles()) == 60
    held = store.files_for(keyed(spark, 1000, 1003))
    assert 1 <= len(held) <= 5   # three keys, and now and then one that only seems to be there
    fresh = store.new_rows(keyed(spark, 2995, 3005))
    assert numbers(fresh) == list(range(3000, 3005))
    files = set(store.rows().inputFiles())
    assert len({f for f in fresh.inputFiles() if f in files}) <= 8
    # of keys that are not there, few files seem to hold one
    assert len(store.files_for(keyed(spark, 9000, 9010))) <= 4


def test_batches_leave_few_files(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path), "review_hash", fanout=3)
    for i in range(17):
        store.append(keyed(spark, 6 * i, 6 * i + 6), i)
    store.append(keyed(spark, 0, 6), 16)   # a batch that runs again changes nothing
    assert numbers(store.rows()) == list(range(102))
    assert sorted(level for _, level, _ in store._runs()) == [0, 0, 1, 1, 2]   # 17 in base 3
    assert parquet_files(tmp_path) <= 2 * 5 + 3


@pytest.mark.parametrize("step", ["_write", "_swap"])
def test_a_crash_before_the_swap_loses_nothing(spark, tmp_path, monkeypatch, step):
    store = KeyedStore(spark, str(tmp_path), "review_hash", fanout=2)
    store.append(keyed(spark, 0, 10), 0)
    real = getattr(KeyedStore, step)

    def crash(self, *args):
        if step == "_write":
            real(self, *args)
        raise RuntimeError("killed")

    monkeypatch.setattr(KeyedStore, step, crash)
    with pytest.raises(RuntimeError):
        store.append(keyed(spark, 10, 20), 1)
    assert numbers(store.rows()) == list(range(10)) and store.last_batch() == 0
    monkeypatch.setattr(KeyedStore, step, real)
    # killed between the batch and the merge of its level
    monkeypatch.setattr(KeyedStore, "merge", lambda self: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        store.append(keyed(spark, 10, 20), 1)
    assert numbers(store.rows()) == list(range(20))
    monkeypatch.undo()
    store.append(keyed(spark, 10, 20), 1)
    store.append(keyed(spark, 20, 30), 2)
    assert numbers(store.rows()) == list(range(30))
    store.vacuum()
    assert parquet_files(tmp_path) == 2 * len(store._runs()) + 1


def test_newest_row_of_a_key_counts(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path), "k", newest="batch_id", fanout=3)
    for i in range(8):
        store.append(spark.createDataFrame([("a", i, i), (f"b{i % 2}", 10 * i, i)], "k string, n long, batch_id long"), i)
        store.append(spark.createDataFrame([], "k string, n long, batch_id long"), i)
    assert {(r.k, r.n) for r in store.rows().collect()} == {("a", 7), ("b0", 60), ("b1", 70)}


def test_prune_and_empty_batches(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path), "review_hash", fanout=9)
    for i, (a, b) in enumerate([(0, 10), (10, 10), (10, 20), (20, 30)]):
        store.append(keyed(spark, a, b), i)
    before = {run for run, *_ in store._runs()}
    store.prune(keyed(spark, 5, 20))
    assert numbers(store.rows()) == list(range(5, 20)) and store.last_batch() == 3
    assert len(before & {run for run, *_ in store._runs()}) == 1   # what loses nothing stays
    store.prune(keyed(spark, 0, 0))
    assert store.rows() is None
    store.append(keyed(spark, 0, 3))
    assert numbers(store.rows()) == [0, 1, 2] and store.last_batch() == 4


def test_filters_hold_every_key():
    rng = np.random.default_rng(1)
    h = rng.integers(-2**63, 2**63 - 1, 5000)
    size = keyed_store.BITS * len(h)
    bits = np.zeros(size, bool)
    bits[keyed_store._spots(h, size).ravel()] = True
    assert bits[keyed_store._spots(h, size)].all()
    others = rng.integers(-2**63, 2**63 - 1, 20_000)
    assert bits[keyed_store._spots(others, size)].all(axis=1).mean() < 0.015
