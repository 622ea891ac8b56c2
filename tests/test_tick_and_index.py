"""The tick as a stream, polls, labels of every prediction and the kept index, each against another way to the same result."""

import random
import shutil
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from seisloom import storage
from seisloom.operators import adaptation, alerts, framing, graph, graph_index
from seisloom.operators import vectors as V
from seisloom.streaming import tick


def signal(spark, length):
    rng = np.random.default_rng(2)
    values = [(ch, i, int(v)) for ch in (1, 2, 3) for i, v in enumerate(rng.normal(0, 300, length) * (1 if ch != 2 else 0.01))]
    return spark.createDataFrame(values, "ch long, i long, v int")


def ticked(spark, rows, bounds, folder, again=False):
    """Decisions after the stretches of samples between the bounds, the stream being restarted for each."""
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/samples/*")
    for n, (low, high) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        rows.where((F.col("i") >= low) & (F.col("i") < high)).write.parquet(f"{folder}/samples/part-{n}")
        tick.run(stream, folder, alerts.Cooldown(3_000_000)).awaitTermination()
        if again:  # a batch that is run again gives the same rows
            done = max(int(p.name.split("=")[1]) for p in (folder / "frames").iterdir() if p.name.startswith("batch="))
            frames = framing.frames(rows.where(F.col("i") < high)).join(spark.read.parquet(f"{folder}/frames/batch={done}").select("ch", ((F.col("vec_id") - F.col("ch")) / tick.CHANNELS).cast("long").alias("k")), ["ch", "k"])
            shutil.rmtree(folder / f"decisions/batch={done}")
            tick.tick(spark.createDataFrame(frames.collect(), frames.schema), done, str(folder), alerts.Cooldown(3_000_000))
    return {r["id"]: (r["level"], r["kind"], tuple(round(x, 9) for m in r["micro"] for x in m)) for r in tick.decisions(spark, str(folder)).collect()}


def test_stretches_do_not_matter(spark, tmp_path):
    rows = signal(spark, 1400)
    whole = ticked(spark, rows, [0, 1400], tmp_path / "a")
    assert len(whole) == 3 * 9 and len({x[1] for x in whole.values()}) > 1
    assert ticked(spark, rows, [0, 100, 700, 705, 1400], tmp_path / "b", again=True) == whole  # the first stretch has no frame


def test_slices_and_stretches_do_not_matter(spark, tmp_path, monkeypatch):
    """Frames are predicted slice by slice, and a vector moves once for the graphs of a stretch; both leave predictions as they are, and written() leaves no shuffle file."""
    rng, n = np.random.default_rng(8), 130
    rows = [(int(k // 3) * tick.CHANNELS + int(k % 3), int(k // 3 + 1) * 1_280_000, v.tolist()) for k, v in enumerate(rng.standard_normal((n, 8)) / 3)]
    frames = spark.createDataFrame(rows, "vec_id long, timestamp_us long, vector array<double>")

    def told(name):
        made = tick.predicted(frames.where(F.col("vec_id") >= rows[40][0]), frames, f"{tmp_path}/{name}")
        return {r["centre"]: (round(r["event_probability"], 12), round(r["estimated_magnitude"], 12), r["nodes"]) for r in made.collect()}

    whole = told("whole")
    assert len(whole) == n - 40 and max(r[2] for r in whole.values()) > 100
    monkeypatch.setattr(tick, "SLICE", 17)
    assert told("slices") == whole and len(list(tmp_path.glob("slices/made-*"))) == 6
    monkeypatch.setattr(graph, "STRETCH", 2)
    assert told("stretches") == whole
    left = lambda: {p for p in Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]).rglob("shuffle_*")}
    before = left()
    storage.written(spark.range(10_000).repartition(4, "id"), f"{tmp_path}/ids")
    assert left() <= before


def test_stream_ranks_its_samples_once(spark, tmp_path, monkeypatch):
    """The four stretches come from samples that were ranked once and kept; decisions are those of full_tick."""
    start = datetime(1995, 1, 1)
    rows = [(i, 1, ch + 1, 1, float(1 + (i * 7 + ch * 13) % 50), 1.0, start + timedelta(days=i // 20)) for ch in range(2) for i in range(128 * 6)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    kept, real = [], storage.stored
    monkeypatch.setattr(storage, "stored", lambda df, name="table": kept.append(name) or real(df, name))
    told = {(r["id"], r["level"], r["kind"]) for r in __spark_entry__.queries()["tick_stream"](spark, str(tmp_path)).collect()}
    assert kept == ["samples"] and len(told) == 10
    assert told == {(r["id"], r["level"], r["kind"]) for r in __spark_entry__.queries()["full_tick"](spark, str(tmp_path)).collect()}


@pytest.mark.parametrize("polls, windows", [(0, 0), (3, 0), (4, 1), (10, 4), (20, 9), (50, 24), (100, 49), (500, 249)])
def test_windows_of_polls(spark, polls, windows):
    rows = spark.range(polls).select(F.lit(1).alias("ch"), "id", F.lit(True).alias("ok"), F.lit(64).alias("n"))
    found = framing.polled(rows, "ch", ["id"], F.floor(F.col("id") / 7))
    assert [r["k"] for r in found.where("k IS NOT NULL").orderBy("id").collect()] == list(range(windows))


def test_polls_against_a_loop(spark):
    random.seed(6)
    rows = [(ch, j, random.choice([True, True, True, False, None]), random.choice([0, 1, 64, 100, 128, None])) for ch in range(4) for j in range(400)]
    rows = [r for r in rows if not (r[2] and r[3] is None)]  # a read without a count is not a poll
    expected, state = {}, {ch: (0, 0) for ch in range(4)}
    for ch, j, ok, n in rows:
        held, k = state[ch]
        held += n if ok else 0
        got = bool(ok) and held >= 256
        expected[ch, j] = (k if got else None, held - 128 * got)
        state[ch] = (held - 128 * got, k + got)
    df = spark.createDataFrame(rows, "ch int, j int, ok boolean, n int")
    for width in (1, 13, 1000):
        got = {(r["ch"], r["j"]): (r["k"], r["held"]) for r in framing.polled(df, "ch", ["j"], F.floor(F.col("j") / width)).collect()}
        assert got == expected
    with pytest.raises(Exception, match="more than a step"):
        framing.polled(spark.createDataFrame([(1, 1, True, 129)], "ch int, j int, ok boolean, n int"), "ch", ["j"], F.lit(0)).collect()


def test_labels_against_each_prediction_alone(spark):
    random.seed(1)
    second = 1_000_000
    waves = [(random.choice("ab"), random.randrange(0, 400) * second // 2, random.choice(["P", "S", "Surface", "Unknown", None]), random.choice([0.0, 3.5, 100.0, None])) for _ in range(150)]
    asked = [(k, random.choice("abc"), random.randrange(0, 420) * second // 2, random.choice([0.1, 0.3, 0.31, 0.9])) for k in range(200)] + [(900, "a", -5_000 * second, 0.9), (901, "a", 10**15, 0.9)]
    own = []
    for i, station, us, _ in asked:
        later = sorted(w[1] for w in waves if w[0] == station and w[1] > us)
        own += [(i, w[1], w[2], w[3]) for w in waves if w[0] == station and later and later[0] <= w[1] <= later[0] + 30 * second]
    p = spark.createDataFrame(asked, "id long, station string, us long, probability double")
    expected = adaptation.labelled(p.select("id", "probability"), spark.createDataFrame(own, "id long, us long, wave string, amplitude double"))
    got = adaptation.followed(p, spark.createDataFrame(waves, "station string, us long, wave string, amplitude double"))
    clean = lambda df: sorted((r["id"], bool(r["event"]) if r["event"] is not None else None, r["magnitude"], r["labeled_at"]) for r in df.collect())
    loose = [(i, e or False if at is not None else e, m, at) for i, e, m, at in clean(expected)]  # waves of unknown type are no evidence
    assert clean(got) == loose and {x[1] for x in loose} == {True, False, None}


def recall(got, expected):
    a, b = ({(r["query_id"], r["vec_id"]) for r in x} for x in (got, expected))
    return len(a & b) / len(b)


@pytest.mark.parametrize("clusters", [1, 40])
def test_kept_index(spark, tmp_path, monkeypatch, clusters):
    monkeypatch.setattr(graph_index, "SHARD", 700)
    rng = np.random.default_rng(3)
    rows = rng.standard_normal((3000, 24)) + 3 * rng.standard_normal((clusters, 24))[rng.integers(0, clusters, 3000)]
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    e = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows.astype("float32"))] + [(9000, None)], "vec_id long, embedding array<float>").cache()
    folder, seen = tmp_path / "index", {}
    for part, upto in enumerate((1000, 1800, 3000)):
        new = e.where(f"vec_id >= {[0, 1000, 1800][part]} AND vec_id < {upto}")
        graph_index.append(new if part else new.unionByName(e.where("vec_id = 9000")), str(folder), f"part{part}")
        assert seen.items() <= (now := {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}).items()  # earlier shards are not touched
        seen = now
        all_so_far = e.where(f"vec_id < {upto}")
        asked = all_so_far.where("vec_id % 20 = 0")
        found = graph_index.search(asked, str(folder), 16)
        assert recall(found.collect(), V.nearest(asked, all_so_far, 16).collect()) >= 0.9
    assert graph_index.nodes(spark, str(folder)).count() == 3000 and found.where("rank = 1 AND vec_id = query_id").count() >= 0.97 * 150  # approximate: a node may be out of reach
    graph_index.append(e.where("vec_id >= 1800 AND vec_id < 3000"), str(folder), "part2")  # the same append again replaces it
    assert graph_index.nodes(spark, str(folder)).count() == 3000
    assert graph_index.search(e.where("vec_id < 0"), str(folder), 3).count() == 0
    monkeypatch.setattr(graph_index, "SHARD", 1)  # some shards stay empty
    graph_index.append(e.where("vec_id < 6"), str(tmp_path / "few"), "x")
    assert graph_index.search(e.where("vec_id < 3"), str(tmp_path / "few"), 4).count() == 12
    one = tmp_path / "one"
    graph_index.append(e.where("vec_id = 5"), str(one), "x")
    assert graph_index.search(e.where("vec_id < 3"), str(one), 4).count() == 3


@pytest.mark.parametrize("block, asked, tasks", [(40, 25, 4), (1000, 30, 64), (70, 500, 1)])
def test_nearest_over_many_blocks(spark, monkeypatch, block, asked, tasks):
    for name, value in {"BLOCK": block, "QUERIES": asked, "TASKS": tasks}.items():
        monkeypatch.setattr(V, name, value)
    rng = np.random.default_rng(8)
    rows = rng.integers(-2, 3, (260, 5)).astype("float32")  # many ties
    label = rng.integers(0, 3, 260)
    e = spark.createDataFrame([(i, r.tolist(), int(x)) for i, (r, x) in enumerate(zip(rows, label, strict=True))] + [(999, None, 0)], "vec_id long, embedding array<float>, label int")
    far = 1 - rows.astype(float) @ rows.T.astype(float)
    for options in ({}, {"same": "label"}, {"skip_self": True}, {"earlier": True}):
        expected = set()
        for q in range(0, 260, 4):
            able = [i for i in range(260) if ("same" not in options or label[i] == label[q]) and ("skip_self" not in options or i != q) and ("earlier" not in options or i <= q)]
            expected |= {(q, i, r + 1) for r, i in enumerate(sorted(able, key=lambda i, q=q: (round(far[q, i], 12), i))[:6])}
        got = V.nearest(e.where("vec_id % 4 = 0"), e, 6, **options)
        assert {(r["query_id"], r["vec_id"], r["rank"]) for r in got.collect()} == expected
    assert V.nearest(e.limit(0), e, 3).count() == 0 and V.nearest(e, e.limit(0), 3).count() == 0
