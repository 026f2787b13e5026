"""Streams equal their batch twins on all windows, whatever the number of input files."""

import os
import shutil

import pytest

from pyspark.sql import functions as F

from tamis.sources.tables import table
from tamis.streaming import monitor as T

from paths import SF


@pytest.fixture(scope="module")
def cut_events(spark, tmp_path_factory):
    """The events as one file, and dealt out of order over five."""
    out = {}
    e = spark.read.parquet(f"{SF}/events.parquet")
    for n in (1, 5):
        out[n] = str(tmp_path_factory.mktemp(f"events{n}"))
        for k in range(n):
            e.filter(F.pmod(F.hash("event_id"), F.lit(n)) == k).coalesce(1).write.parquet(f"{out[n]}/tmp-{k}")
            part = next(p for p in os.listdir(f"{out[n]}/tmp-{k}") if p.endswith(".parquet"))
            shutil.copy(f"{out[n]}/tmp-{k}/{part}", f"{out[n]}/events-{k}.parquet")
    return out


def _rows(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.mark.parametrize("files", [1, 5])
def test_streams_equal_batches_whatever_the_files(spark, cut_events, files):
    stream = lambda: T.events_stream(spark, cut_events[files], max_files=1)
    batch = T.prepare_events(table(spark, SF, "events"))
    assert _rows(T.run_updates(T.window_quality(stream()), "q", ["window_start", "event_type"])) == _rows(T.window_quality(batch))
    assert _rows(T.run_updates(T.burst_windows(stream()), "b", ["window_start"])) == _rows(T.burst_windows(batch))
    n = batch.count()
    base = batch.groupBy("event_type").agg((F.count("*") / n).alias("p"))
    assert _rows(T.window_drift_stream(stream(), base)) == _rows(T.window_drift(batch, base))
    dedup = T.run_available_now(T.dedup_stream(stream(), ["user_id", "event_type"]).select("user_id", "event_type"), "d")
    assert _rows(dedup) == _rows(batch.select("user_id", "event_type").distinct())
    folder = T.monitor_batches(stream(), {"missing": F.col("value").isNull()})
    metrics = spark.read.parquet(f"{folder}/metrics")
    total = T.monitor_totals(metrics).first()
    assert metrics.count() == files
    assert (total.n, total.accepted) == (n, batch.filter(F.col("value").isNotNull()).count())


def test_monitor_writes_idempotent_batches(spark):
    rules = {"value_missing": F.col("value").isNull()}
    base = T.monitor_batches(T.events_stream(spark, SF), rules)
    m = spark.read.parquet(f"{base}/metrics").first()
    acc = spark.read.parquet(f"{base}/accepted").count()
    q = spark.read.parquet(f"{base}/quarantine").count()
    assert acc + q == m.n and acc == m.accepted


def test_monitor_restart_does_not_duplicate(spark, tmp_path):
    """A restarted stream (same checkpoint) neither reprocesses nor duplicates."""
    from tamis.session import ensure_checkpoint_dir
    import uuid
    out = f"{ensure_checkpoint_dir(spark)}/streams/restart-{uuid.uuid4().hex}"
    rules = {"value_missing": F.col("value").isNull()}
    T.monitor_batches(T.events_stream(spark, SF), rules, out_dir=out)
    first = spark.read.parquet(f"{out}/accepted").count()
    T.monitor_batches(T.events_stream(spark, SF), rules, out_dir=out)
    assert spark.read.parquet(f"{out}/accepted").count() == first
    assert spark.read.parquet(f"{out}/metrics").count() == 1


@pytest.mark.parametrize("files", [1, 5])
def test_dedup_without_state_equals_the_batch(spark, cut_events, files):
    batch = T.prepare_events(table(spark, SF, "events"))
    stream = T.events_stream(spark, cut_events[files], max_files=1)
    folder = T.dedup_to_table(stream, ["user_id", "event_type"], ["event_id"])
    got = T.deduplicated(spark, folder, stream.schema)
    assert _rows(got.select("user_id", "event_type")) == _rows(batch.select("user_id", "event_type").distinct())
    passed = spark.read.parquet(f"{folder}/metrics")
    assert passed.count() == files and passed.agg(F.sum("passed")).first()[0] == got.count()
    # again: nothing new; a batch that is repeated after a crash replaces what it wrote
    T.dedup_to_table(T.events_stream(spark, cut_events[files], max_files=1), ["user_id", "event_type"], ["event_id"], out_dir=folder)
    assert T.deduplicated(spark, folder, stream.schema).count() == got.count()


def test_dedup_survives_a_killed_batch(spark, cut_events, tmp_path, monkeypatch):
    keys, out = ["user_id", "event_type"], str(tmp_path / "out")
    real, calls = T.dedup_keep_first, []

    def fails_once(*args):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("killed")
        return real(*args)
    monkeypatch.setattr(T, "dedup_keep_first", fails_once)
    stream = lambda: T.events_stream(spark, cut_events[5], max_files=1)
    with pytest.raises(Exception):
        T.dedup_to_table(stream(), keys, ["event_id"], out_dir=out)
    T.dedup_to_table(stream(), keys, ["event_id"], out_dir=out)
    got = T.deduplicated(spark, out, stream().schema)
    batch = T.prepare_events(table(spark, SF, "events"))
    assert _rows(got.select(*keys)) == _rows(batch.select(*keys).distinct())


def test_streams_without_a_file_are_empty(spark, tmp_path):
    empty = str(tmp_path / "none")
    os.makedirs(empty)
    stream = lambda: T.events_stream(spark, empty)
    assert T.run_updates(T.window_quality(stream()), "q", ["window_start", "event_type"]).count() == 0
    assert T.run_available_now(T.dedup_stream(stream(), ["user_id"]), "d").count() == 0
    assert T.deduplicated(spark, T.dedup_to_table(stream(), ["user_id"], ["event_id"]), stream().schema).count() == 0
