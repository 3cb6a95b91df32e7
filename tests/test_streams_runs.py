"""Telemetry in blocks and as streams: one long run over many tasks, restarts, replays."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import telemetry as T
from corpusloom.plans import runs
from corpusloom.streaming import telemetry as S


@pytest.fixture(scope="module")
def run(spark):
    """One run of 500 steps, and short ones, one of them without a name."""
    rng, rows = random.Random(4), []
    for name, n in (("long", 500), ("short", 2), (None, 7), ("one", 1)):
        clock = 0.0
        for k in range(1, n + 1):
            clock += rng.choice([0.0, 0.5, 1.0])
            rows.append((name, k, k * 8, clock, rng.random(), None if k % 50 == 1 else k % 3))
    return spark.createDataFrame(rows, "run string, iter long, samples long, clock double, loss double, own long").repartition(4)


def told(df):
    return sorted(((r[0] or "", *[None if x is None else round(x, 9) for x in r[1:]]) for r in df.collect()), key=lambda r: r[:2])


def test_one_run_over_many_blocks(run):
    columns = ("run", "iter", "samples_per_sec", "mean_loss")
    whole = T.rolling(run, "run", "iter", "samples", "clock", 3, "loss", 5).select(*columns)
    for block in (5, 7, 64):
        assert told(T.rolling(run, "run", "iter", "samples", "clock", 3, "loss", 5, block=block).select(*columns)) == told(whole)
    rows = {(r.run, r.iter): r for r in run.collect()}
    for r in whole.collect():
        took = rows[r.run, r.iter].clock - rows[r.run, r.iter - 3].clock
        assert r.samples_per_sec == (24 / took if took else None)
        losses = [rows[r.run, k].loss for k in range(max(1, r.iter - 4), r.iter + 1)]
        assert abs(r.mean_loss - sum(losses) / len(losses)) < 1e-12
    assert whole.filter("run = 'long'").count() == 497 and whole.filter("run IS NULL").count() == 4
    with pytest.raises(ValueError, match="needs blocks"):
        T.rolling(run, "run", "iter", "samples", "clock", 9, block=8)


def test_running_totals_over_many_blocks(run):
    want = {}
    for name in ("long", "short", None, "one"):
        total = None
        for r in sorted(run.filter(F.col("run").eqNullSafe(F.lit(name))).collect(), key=lambda r: r.iter):
            total = r.own if total is None else total + (r.own or 0)
            want[name, r.iter] = total
    for block in (1, 6, 1 << 16):
        got = T.running_total(run, "run", "iter", "own", "total", block)
        assert {(r.run, r.iter): r.total for r in got.collect()} == want and got.columns == [*run.columns, "total"]


def test_positions_with_ties(spark):
    df = spark.createDataFrame([("a", k // 3, -k) for k in range(30)] + [("a", None, 1)], "g string, t long, e long")
    got = {(r.t, r.e): r.pos for r in T.positions(df, "g", "t", 4, ("e",)).collect()}
    assert got == {key: k for k, key in enumerate(sorted(got, key=lambda x: (x[0] is not None, x[0] or 0, x[1])))}


def test_metric_names(spark):
    df = spark.createDataFrame([(1, 1, "b", 2.0), (1, 2, "b", None), (1, 3, "a", 5.0), (None, 4, "a", 1.0), (2, 5, None, 1.0)], "step long, seq long, name string, value double")
    assert T.metric_names(df, "name") == ["a", "b"]
    got = T.merged_by_step(T.wide(df, "name", "value"), "step", "seq", ["a", "b"]).orderBy("step").collect()
    assert [tuple(r) for r in got] == [(1, 5.0, 2.0), (2, None, None)]
    with pytest.raises(ValueError, match="more than 1"):
        T.metric_names(df, "name", 1)


def parts(spark, run, path, cuts):
    """Writes the rows of a run as files in the order of its steps, the first ones now; gives what writes the others."""
    def write(lo, hi):
        run.filter((F.col("iter") > lo) & (F.col("iter") <= hi)).coalesce(1).write.mode("append").parquet(path)

    write(*cuts[0])
    return [lambda c=c: write(*c) for c in cuts[1:]]


def test_stream_goes_on_from_its_checkpoint(spark, run, tmp_path):
    kept = run.filter("run IS NOT NULL")
    more = parts(spark, kept, str(tmp_path / "in"), [(0, 3), (3, 4), (4, 200), (200, 500)])
    for write in [None, *more, None]:
        if write:
            write()
        rows = spark.readStream.schema(run.schema).parquet(str(tmp_path / "in"))
        S.started(S.rolling(rows, "run", ["iter"], "clock", 8, 3), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    want = T.rolling(kept, "run", "iter", "samples", "clock", 3).select("run", "iter", "samples_per_sec")
    assert told(spark.read.parquet(str(tmp_path / "out")).select("run", "iter", "samples_per_sec")) == told(want)


def test_replayed_batch_changes_nothing(spark, tmp_path):
    rng = random.Random(9)
    rows = [(rng.randrange(20) if k % 9 else None, k, rng.choice(["loss", "lr", "t/s"]), None if k % 7 == 0 else float(k)) for k in range(300)]
    schema = "step long, seq long, name string, value double"
    for lo in range(0, 300, 100):
        spark.createDataFrame(rows[lo : lo + 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    S.merged(stream, out, str(tmp_path / "state"), "step", "seq", "name", "value").awaitTermination()
    want = {}
    for step, _, name, value in rows:
        if step is not None and value is not None:
            want[step, name] = value
    table = lambda: {(r.step, r.name): r.value for r in S.current(spark, out, "step", "seq", "name", "value").collect()}
    assert table() == want and len(list((tmp_path / "out").glob("batch_id=*"))) == 3
    # The last commit is lost, as when a driver ends between the sink and the log: the batch comes again.
    last = max((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    last.with_name(f".{last.name}.crc").unlink(missing_ok=True)
    S.merged(stream, out, str(tmp_path / "state"), "step", "seq", "name", "value").awaitTermination()
    assert table() == want and len(list((tmp_path / "out").glob("batch_id=*"))) == 3


def test_streams_equal_the_batch_queries(spark):
    from corpusloom.plans import streams

    sf = "/root/testdata/sf0.001"
    assert sorted(map(tuple, streams.stream_rolling_throughput(spark, sf).collect()), key=str) == sorted(map(tuple, runs.rolling_throughput(spark, sf).collect()), key=str)
