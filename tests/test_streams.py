import datetime as dt

from pyspark.sql import functions as F

from flowspark.operators.features import Feature, causal, flow_features
from flowspark.operators.validate import Contract
from flowspark.streaming import flows

CONTRACT = Contract(endpoints=("src",), ports=("sport",), protocol="proto", timestamp="time", numeric=("v",), optional=())
START = dt.datetime(2024, 1, 1)


def events(spark, tmp_path, seconds, files=1):
    rows = [(k, "ab"[k % 2], START + dt.timedelta(seconds=s), float(k)) for k, s in enumerate(seconds)]
    size = -(-len(rows) // files)
    for f in range(files):
        part = spark.createDataFrame(rows[f * size : (f + 1) * size], "id long, key string, ts timestamp, v double")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return flows.source(spark, str(tmp_path / "in"), part.schema)


def test_stream_features_equal_batch(spark, tmp_path):
    seconds = [k * 7 % 500 // 3 for k in range(300)] + [10_000, 10_000]
    stream = events(spark, tmp_path, seconds)
    got = flows.drain(flows.causal_features(stream, "key", "id", "ts", "v", "0 seconds", 20_000), str(tmp_path / "out"))
    batch = spark.read.parquet(str(tmp_path / "in")).withColumn("t", F.unix_micros("ts"))
    want = causal(batch, [Feature("conn", "count", ("key",), 20_000_000), Feature("amount", "sum", ("key",), 20_000_000, "v"), Feature("micros_since", "since", ("key",), None)]).where("id < 300")
    want = want.select("id", "conn", "amount", "micros_since")
    assert got.count() == 300 and got.exceptAll(want).count() == 0


def test_equal_gap_joins_and_late_rows_are_dropped(spark, tmp_path):
    stream = events(spark, tmp_path, [0, 0, 300, 301, 5000, 5000])
    out = flows.drain(flows.incidents(stream, ["key"], "ts", "300 seconds", "0 seconds", "v", 2.0), str(tmp_path / "out"))
    assert sorted((r.key, r.flows, r.promoted) for r in out.collect()) == [("a", 2, True), ("b", 1, False), ("b", 1, True)]


def test_all_features_on_a_stream_equal_batch(spark, tmp_path):
    """All 43, those of the source and those of the destination, over rows in several files and with peers."""
    import random

    rng, scale = random.Random(4), 1_000_000
    times = sorted(rng.randrange(400) for _ in range(240)) + [90_000, 90_000]
    rows = [(k, START + dt.timedelta(seconds=s), "ab"[k % 2] if s < 1000 else "ab"[k % 2], "xyz"[rng.randrange(3)], rng.randrange(5), rng.choice([53, 80, 443]), rng.choice([6, 17]), float(rng.randrange(900)), float(rng.randrange(9)), rng.randrange(2), rng.randrange(2)) for k, s in enumerate(times)]
    names = "id long, ts timestamp, src string, dst string, sport int, dport int, proto int, bytes double, packets double, syn int, rst int"
    for f in range(3):
        spark.createDataFrame(rows[f * 81 : (f + 1) * 81], names).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in")).withColumn("t", F.unix_micros("ts"))
    for side in ("src", "dst"):
        some = [f for f in flow_features(10, 60, scale) if f.keys[0] == side]
        stream = flows.source(spark, str(tmp_path / "in"), batch.drop("t").schema, 1)
        told = {}
        got = flows.drain(flows.features_on_stream(stream, some, "id", "ts", "1000 seconds"), str(tmp_path / f"out-{side}"), told=told)
        want = causal(batch, some).where("id < 240").select("id", *(f.name for f in some))
        shown = lambda d: sorted(tuple(round(x, 6) for x in r) for r in d.collect())
        assert told["late"] == 0 and shown(got) == shown(want)
    assert len(flow_features()) == 43


def test_late_rows_are_counted(spark, tmp_path):
    for f, seconds in enumerate([[0, 10, 5000], [20, 6000], [30, 40, 9000]]):
        rows = [(10 * f + k, "a", START + dt.timedelta(seconds=s), 1.0) for k, s in enumerate(seconds)]
        spark.createDataFrame(rows, "id long, key string, ts timestamp, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    told = {}
    out = flows.drain(flows.counts(flows.source(spark, str(tmp_path / "in"), schema, 1), "key", "ts", "0 seconds", "100 seconds"), str(tmp_path / "out"), told=told)
    lost = 8 - 1 - sum(r.n for r in out.collect())  # one row is in a window that is still open
    assert 1 <= told["late"] <= lost


def test_bad_rows_go_to_their_own_table(spark, tmp_path):
    rows = [("s", "80", "6", "17/02/2015 08:00:00 PM", "1"), (" ", "80", "6", "17/02/2015 08:00:00 PM", "1"), ("s", "x", "300", "17/02/2015 08:00:00 PM", "nan")]
    df = spark.createDataFrame(rows, "src string, sport string, proto string, time string, v string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    query = flows.split_valid(flows.source(spark, str(tmp_path / "in"), df.schema), CONTRACT, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "cp"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1
    assert sorted(len(r.violations) for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == [1, 3]


NULLS = "id long, ts timestamp, src string, dst string, sport int, dport int, proto int, bytes double, packets double, syn int, rst int"


def null_flows(n=260, seed=6):
    """Rows in order of time, with nulls in every column that may hold one, peers, and one far last row that closes the rest."""
    import random

    rng = random.Random(seed)
    maybe = lambda x: x if rng.random() > 0.2 else None
    times = sorted(rng.randrange(-50, 450) for _ in range(n))
    rows = [(k, START + dt.timedelta(seconds=s), maybe("ab"[k % 2]), maybe("xyz"[rng.randrange(3)]), maybe(rng.randrange(5)), maybe(rng.choice([53, 80])), maybe(rng.choice([6, 17])), maybe(float(rng.randrange(900))), maybe(float(rng.randrange(9))), maybe(rng.randrange(2)), maybe(1)) for k, s in enumerate(times)]
    return rows + [(10_000 + k, START + dt.timedelta(days=1), a, b, 1, 1, 6, 1.0, 1.0, 0, 0) for k, (a, b) in enumerate((x, y) for x in ("a", "b", None) for y in ("x", "y", "z", None))]


def shown(d):
    return sorted(tuple(round(x, 6) for x in r) for r in d.collect())


def test_nulls_and_restarts_equal_batch(spark, tmp_path):
    """A stream that is stopped after each file and goes on from its checkpoint, over rows with nulls."""
    rows = null_flows()
    size = len(rows) // 3 + 1
    for side in ("src", "dst"):
        some = [f for f in flow_features(10, 60, 1_000_000) if f.keys[0] == side]
        folder = tmp_path / side
        for part in range(3):
            spark.createDataFrame(rows[part * size : (part + 1) * size], NULLS).coalesce(1).write.mode("append").parquet(str(folder / "in"))
            stream = flows.features_on_stream(flows.source(spark, str(folder / "in"), spark.read.parquet(str(folder / "in")).schema), some, "id", "ts", "1 second")
            stream.writeStream.option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).format("parquet").start(str(folder / "out")).awaitTermination()
        batch = spark.read.parquet(str(folder / "in")).withColumn("t", F.unix_micros("ts"))
        want = causal(batch, some).where("id < 10000").select("id", *(f.name for f in some))
        assert shown(spark.read.parquet(str(folder / "out"))) == shown(want)


def test_state_keeps_only_what_frames_reach():
    """Stretches that no frame can reach go, the rest is read only where rows fall in it."""
    import pandas as pd

    class Map(dict):
        def __init__(self):
            self.read = 0

        def getValue(self, k):
            self.read += 1
            return self[k]

        containsKey = dict.__contains__
        updateValue = dict.__setitem__
        removeKey = dict.__delitem__

    class Handle:
        def __init__(self):
            self.maps, self.timers = {}, []

        def getMapState(self, name, *_):
            return self.maps.setdefault(name, Map())

        registerTimer = lambda self, t: self.timers.append(t)

    class Now:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    import pyarrow as pa

    some = [Feature("n", "count", ("k",), 10, scale=1_000_000), Feature("d", "distinct", ("k",), 10, "v", scale=1_000_000), Feature("last", "since", ("k", "v"), None)]
    state = flows.CausalState(some, "id", ["v"])
    state.texts, state.id_type, state.arrives = {"v"}, pa.int64(), ["_key", "id", "_ts", "v", "_t"]
    handle = Handle()
    state.init(handle)
    out = []
    for second in range(0, 300, 3):
        row = pd.DataFrame({"_0": ["a"], "id": [second], "_2": [None], "v": [None if second % 2 else "x"], "_4": [second * 1_000_000]})
        assert list(state.handleInputRows(("a",), iter([row]), Now(0))) == []
        out += [r for d in state.handleExpiredTimer(("a",), Now(second * 1000), None) for r in d.itertuples(index=False)]
        assert len(handle.maps["past"]) <= 3 and len(handle.maps["waiting"]) <= 2
    assert [(r.id, r.n, r.d, r.last) for r in out[5:7]] == [(15, 3, 1, 6_000_000), (18, 3, 1, 6_000_000)]
    assert len(out) == 99 and handle.maps["past"].read < 400 and len(handle.maps["last"]) == 3  # the key itself, x and null
    assert [len(list(state.handleExpiredTimer(("a",), Now(10**6), None))) for _ in range(2)] == [1, 0]
    assert not handle.maps["past"] and not handle.maps["waiting"]


def test_incidents_on_a_stream_equal_batch(spark, tmp_path):
    """Sessions of alerts over rows in several files, some of them exactly a gap apart, against those of batch."""
    import random

    from flowspark.operators import incidents as inc

    rng = random.Random(2)
    seconds = sorted(rng.choice([0, 300, 600, 601, 902]) + 3000 * rng.randrange(6) for _ in range(80))
    stream = events(spark, tmp_path, [*seconds, 10**6, 10**6], files=4)
    got = flows.drain(flows.incidents(stream, ["key"], "ts", "300 seconds", "1 day", "v", 40.0), str(tmp_path / "out"))
    batch = spark.read.parquet(str(tmp_path / "in")).where("id < 80").withColumns({"t": F.unix_seconds("ts"), "proto": F.lit(6)})
    want = inc.incidents(batch, inc.Policy(0.0, 0.5, 300, ("key",)), "v")
    pick = lambda d, first, last: sorted((r.key, r[first], r[last], r.flows, r.max_score) for r in d.collect())
    secs = got.withColumns({"first_seen": F.unix_seconds("first_seen"), "last_seen": F.unix_seconds("last_seen")})
    assert pick(secs, "first_seen", "last_seen") == pick(want, "first_seen", "last_seen") and got.count() > 10


def test_a_crowded_key_is_scored_in_pieces(monkeypatch):
    """One batch of one key: its rows wait in pieces and come out in several, each against what its frames reach; results are those of all at once."""
    import types

    import pandas as pd
    import pyarrow as pa

    some = [Feature("n", "count", ("k",), 5, scale=1_000_000), Feature("d", "distinct", ("k",), 5, "v", scale=1_000_000), Feature("last", "since", ("k", "v"), None)]
    at = [(7 * i) % 400 for i in range(1200)]
    arriving = pd.DataFrame({"_0": ["a"] * 1200, "id": range(1200), "_2": [None] * 1200, "v": [f"x{i % 9}" for i in range(1200)], "_4": [s * 1_000_000 for s in at]})

    def run(piece):
        monkeypatch.setattr(flows, "PIECE", piece)
        state = flows.CausalState(some, "id", ["v"])
        state.texts, state.id_type, state.arrives = {"v"}, pa.int64(), ["_key", "id", "_ts", "v", "_t"]

        class Map(dict):
            getValue, containsKey, updateValue, removeKey = dict.__getitem__, dict.__contains__, dict.__setitem__, dict.__delitem__

        maps = {}
        state.init(types.SimpleNamespace(getMapState=lambda name, *_: maps.setdefault(name, Map()), registerTimer=lambda t: None))
        list(state.handleInputRows(("a",), iter([arriving[:700], arriving[700:]]), None))
        parts = []
        for second in (150, 500):
            now = types.SimpleNamespace(getCurrentWatermarkInMs=lambda s=second: s * 1000)
            parts += list(state.handleExpiredTimer(("a",), now, None))
        return parts

    whole, pieces = run(10**6), run(20)
    assert len(whole) == 2 and len(pieces) > 10 and max(map(len, pieces)) < 200
    a, b = (pd.concat(x).sort_values("id").reset_index(drop=True) for x in (whole, pieces))
    assert len(a) == 1200 and a.equals(b)
