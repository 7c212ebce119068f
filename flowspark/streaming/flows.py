"""Flows as streams: validation, sessions, causal features and operations counts."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from ..operators.features import Feature
from ..operators.validate import row_rules, with_violations


def source(spark: SparkSession, path: str, schema: StructType, files_at_once: int | None = None) -> DataFrame:
    """Parquet files as a stream with a fixed schema."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).parquet(path)


def late_rows(query) -> int:
    """Rows that a finished query's operators dropped because the watermark had passed them, as they count them: after
    a partial aggregation, rows of one group and batch are one."""
    return sum(int(o.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for o in json.loads(p.json if hasattr(p, "json") else json.dumps(p)).get("stateOperators", []))


def drain(stream: DataFrame, root: str, mode: str = "append", told: dict | None = None) -> DataFrame:
    """All that the stream gives now, written once to a table under ``root`` (exactly-once file sink).  ``told`` gets the
    number of late rows."""
    at = f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).format("parquet").start(f"{at}/table")
    query.awaitTermination()
    if told is not None:
        told["late"] = late_rows(query)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/table")


def split_valid(stream: DataFrame, contract, good: str, bad: str, checkpoint: str):
    """Start a query that writes valid rows to ``good`` and others, with what they break, to ``bad``."""

    def both(batch: DataFrame, number: int) -> None:
        checked = with_violations(batch, row_rules(contract)).withColumn("batch", F.lit(number))
        # one folder a batch: a batch that runs again replaces its own rows
        checked.where(F.size("violations") == 0).drop("violations", "batch").write.mode("overwrite").parquet(f"{good}/batch={number}")
        checked.where(F.size("violations") > 0).drop("batch").write.mode("overwrite").parquet(f"{bad}/batch={number}")

    return stream.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def incidents(alerts: DataFrame, keys: list[str], time: str, gap: str, late: str, score: str, promote: float) -> DataFrame:
    """Closed sessions of alerts; a gap equal to ``gap`` still joins."""
    s = alerts.withWatermark(time, late).groupBy(*keys, F.session_window(time, gap).alias("w"))
    return s.agg(F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), F.count("*").alias("flows"), F.max(score).alias("max_score")).drop("w").withColumn("promoted", F.col("max_score") >= promote)


def counts(stream: DataFrame, key: str, time: str, late: str, size: str, slide: str | None = None) -> DataFrame:
    """Rows by key in tumbling or sliding windows that the watermark has passed."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def causal_features(stream: DataFrame, key: str, row_id: str, time: str, amount: str, late: str, window_ms: int) -> DataFrame:
    """(id, conn, amount, micros_since): count, sum and recency before each row, by `features_on_stream`."""
    window = window_ms * 1000
    some = [Feature("conn", "count", (key,), window), Feature("amount", "sum", (key,), window, amount), Feature("micros_since", "since", (key,), None)]
    return features_on_stream(stream, some, row_id, time, late).withColumnRenamed(row_id, "id")


def _places(group: np.ndarray, t: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For rows in order of (group, t): the first row of each row's group whose time is ``at`` or later."""
    return _places_in(group, t, group, at)


def _places_in(group: np.ndarray, t: np.ndarray, g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first row of group ``g`` at time ``at`` or later, or where the group ends; rows in order of (group, t)."""
    base = int(t.min())
    span = int(t.max()) - base + 2
    return np.searchsorted(group * span + (t - base), g * span + np.clip(at - base, 0, span - 1))


def _numbers(column: pd.Series) -> np.ndarray:
    """As doubles, null (and NaN, which validated flows do not have) as NaN."""
    return pd.to_numeric(column).to_numpy(np.float64, na_value=np.nan)


def causal_arrays(rows: pd.DataFrame, time: str, features: list[Feature], only: np.ndarray, last: dict | None = None) -> dict[str, np.ndarray]:
    """The features of the rows ``only`` of one first key, as `causal` has them; rows in order of time.  Sums and places come by binary search, so the
    cost is n log n however many rows share a frame.  Nulls add nothing to sums, means and distinct values, and as a second key they are a
    key.  ``last``: by (second key's column, its value), when it was last seen before these rows."""
    out, t = {}, rows[time].to_numpy(np.int64)
    for f in features:
        inner = rows[f.keys[1]] if len(f.keys) > 1 else pd.Series("", index=rows.index)
        group = pd.factorize(inner, use_na_sentinel=False)[0].astype(np.int64)
        order = np.lexsort((t, group))
        g, s = group[order], t[order]
        here = _places(g, s, s)
        begin = np.searchsorted(g, g) if f.window is None else _places(g, s, s - f.window * f.scale)
        n = here - begin
        within = lambda x: (total := np.r_[0, np.cumsum(x)])[here] - total[begin]  # noqa: B023, E731
        if f.what == "count":
            x = n
        elif f.what in ("sum", "avg"):
            value = _numbers(rows[f.column])[order]
            known = ~np.isnan(value)
            x = within(np.where(known, value, 0.0))
            if f.what == "avg":
                x = np.where((k := within(known)) > 0, x / np.maximum(k, 1), 0.0)
        elif f.what == "since":
            before = np.full(len(s), -1)
            if last:
                names = inner.to_numpy()[order]
                before = np.array([last.get((f.keys[1] if len(f.keys) > 1 else "", None if pd.isna(v) else v), -1) for v in names], np.int64)
            seen = np.where(n > 0, s[np.maximum(here - 1, 0)], before)
            x = np.where((n > 0) | (before >= 0), s - seen, -1)
        elif f.what == "share":
            x = np.where(n > 0, within(_numbers(rows[f.column])[order] == f.value) / np.maximum(n, 1), 0.0)
        elif f.what in ("distinct", "diversity"):  # a value covers the frames from after each occurrence to its next, or the frame's length
            value = pd.factorize(rows[f.column])[0][order]
            some = np.flatnonzero(value >= 0)
            by = some[np.lexsort((s[some], value[some], g[some]))]
            same = np.r_[(value[by][1:] == value[by][:-1]) & (g[by][1:] == g[by][:-1]), False][: len(by)]
            after = np.where(same, np.r_[s[by][1:], 0][: len(by)], np.iinfo(np.int64).max // 4)
            end = after if f.window is None else np.minimum(after, s[by] + f.window * f.scale)
            cover = np.zeros(len(s) + 1, np.int64)
            np.add.at(cover, _places_in(g, s, g[by], s[by] + 1), 1)
            np.add.at(cover, _places_in(g, s, g[by], end + 1), -1)
            x = np.cumsum(cover)[:-1]
            if f.what == "diversity":
                x = np.where(n > 0, x / np.maximum(n, 1), 0.0)
        else:
            raise ValueError(f"no such feature kind: {f.what}")
        back = np.empty(len(s), x.dtype)
        back[order] = x
        out[f.name] = back[only]
    return out


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Rows of one key that are scored together, or written to state as one piece, if the window's own rows are not more.
PIECE = 20_000


class CausalState(StatefulProcessor):
    """State of one first key: ``waiting`` and ``past``, pieces of rows (a map from a piece's first and last time and a number to its rows as one
    Arrow table), and ``last``, when each second key was last seen.

    A batch writes pieces of its own and reads none: the few rows of a quiet key are one, those of a crowded one are cut by stretches of the longest window.
    Timers fire when the watermark has passed the first waiting row.  The rows that it has passed are scored in the order of time, piece by
    piece, peers together, against the rows that their frames reach; so no task holds more of a key than about a window's rows.
    What later frames reach becomes the past; of idle keys it is dropped by a timer of its own.
    """

    def __init__(self, features: list[Feature], row_id: str, columns: list[str]):
        self.features, self.row_id, self.columns = features, row_id, columns
        self.longest = max((f.window * f.scale for f in features if f.window is not None), default=0)
        self.stretch = max(self.longest, 1_000_000)
        self.seconds = sorted({f.keys[1] for f in features if f.what == "since" and len(f.keys) > 1})
        self.recency = any(f.what == "since" for f in features)

    def init(self, handle) -> None:
        self.handle = handle
        piece = "first bigint, last bigint, number bigint"
        self.waiting = handle.getMapState("waiting", piece, "rows binary")
        self.past = handle.getMapState("past", piece, "rows binary")
        self.last = handle.getMapState("last", "column string, value string", "t bigint")

    @staticmethod
    def _read(state, piece: tuple) -> pa.Table:
        return pa.ipc.open_stream(state.getValue(piece)[0]).read_all()

    @staticmethod
    def _write(state, rows: pa.Table) -> None:
        t = rows["_t"].to_numpy()
        first, last, number = int(t.min()), int(t.max()), 0
        while state.containsKey((first, last, number)):
            number += 1
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as writer:
            writer.write_table(rows.combine_chunks())
        state.updateValue((first, last, number), (sink.getvalue().to_pybytes(),))

    def _add(self, state, rows: pa.Table) -> None:
        if rows.num_rows <= PIECE:
            self._write(state, rows)
            return
        at = rows["_t"].to_numpy() // self.stretch
        for stretch in np.unique(at).tolist():
            self._write(state, rows.filter(pa.array(at == stretch)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kinds = self.schema()
        held, first = [], None
        for p in rows:
            # by place: what comes in renames columns that are no Python names
            held.append(pa.Table.from_pandas(p.set_axis(self.arrives, axis=1)[kinds.names], schema=kinds, preserve_index=False))
            if held[-1].num_rows:
                least = int(held[-1]["_t"].to_numpy().min())
                first = least if first is None else min(first, least)
            if sum(x.num_rows for x in held) > 10 * PIECE:
                self._add(self.waiting, pa.concat_tables(held))
                held = []
        if sum(x.num_rows for x in held):
            self._add(self.waiting, pa.concat_tables(held))
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        return iter([])

    def schema(self) -> pa.Schema:
        """Types that do not depend on what a batch happens to hold: texts stay texts, all else is a number."""
        kind = lambda c: pa.string() if c in self.texts else pa.float64()
        return pa.schema([("_t", pa.int64()), (self.row_id, self.id_type), *((c, kind(c)) for c in self.columns)])

    def _passed(self, mark: int, near: int) -> Iterator[tuple[pa.Table, int]]:
        """The waiting rows before ``mark`` in chunks of whole times, in order, each with the time from which rows may follow; they leave
        the state.  A chunk has about `PIECE` rows, or ``near`` if that is more."""
        pieces = sorted(k for k in self.waiting.keys() if k[0] < mark)
        held: list[pa.Table] = []
        for i, piece in enumerate(pieces):
            held.append(self._read(self.waiting, piece))
            self.waiting.removeKey(piece)
            then = min(pieces[i + 1][0], mark) if i + 1 < len(pieces) else mark
            if i + 1 < len(pieces) and sum(x.num_rows for x in held) < max(PIECE, near):
                continue
            rows = pa.concat_tables(held)
            ready = rows["_t"].to_numpy() < then
            rest = rows.filter(pa.array(~ready))
            held = [rest] if rest.num_rows else []
            if ready.any():
                yield rows.filter(pa.array(ready)), then
        if held:
            self._add(self.waiting, pa.concat_tables(held))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        waits = [k[0] for k in self.waiting.keys()]
        old = [tuple(k) for k in self.past.keys()]
        if any(first < mark for first in waits):
            reached = pa.concat_tables([self.schema().empty_table(), *(self._read(self.past, k) for k in old)])
            for ready, then in self._passed(mark, reached.num_rows):
                yield self._scored(ready, reached)
                # rows to come are at ``then`` or later
                reached = pa.concat_tables([reached, ready])
                reached = reached.filter(pa.array(reached["_t"].to_numpy() >= then - self.longest)) if self.longest else reached.slice(0, 0)
            for k in old:
                self.past.removeKey(k)
            if reached.num_rows:
                self._add(self.past, reached)
            waits, old = [k[0] for k in self.waiting.keys()], [tuple(k) for k in self.past.keys()]
        for k in [k for k in old if k[1] < mark - self.longest]:
            self.past.removeKey(k)
            old.remove(k)
        if old:
            self.handle.registerTimer((max(k[1] for k in old) + self.longest) // 1000 + 1)
        if waits:
            self.handle.registerTimer(min(waits) // 1000 + 1)

    def _scored(self, ready: pa.Table, reached: pa.Table) -> pd.DataFrame:
        """The features of ``ready``, whose frames hold some of ``reached``."""
        first = int(ready["_t"].to_numpy().min())
        old = reached.filter(pa.array(reached["_t"].to_numpy() >= first - self.longest))
        rows = pa.concat_tables([old, ready]).to_pandas()
        new = np.r_[np.zeros(len(rows) - ready.num_rows, bool), np.ones(ready.num_rows, bool)]
        order = np.argsort(rows["_t"].to_numpy(), kind="stable")
        rows, new = rows.iloc[order].reset_index(drop=True), new[order]
        last = self._seen(ready) if self.recency else {}
        made = causal_arrays(rows, "_t", self.features, new, last)
        if self.recency:
            self._see(ready, last)
        return pd.DataFrame({self.row_id: rows[self.row_id].to_numpy()[new], **made})

    @staticmethod
    def _name(value) -> str:
        return "" if value is None else f"v{value}"

    def _seen(self, ready: pa.Table) -> dict:
        """When the second keys of these rows, and the key itself, were last seen."""
        out = {}
        for column, values in (("", [""]), *((c, ready[c].unique().to_pylist()) for c in self.seconds)):
            for v in values:
                if self.last.containsKey((column, self._name(v))):
                    out[column, v] = self.last.getValue((column, self._name(v)))[0]
        return out

    def _see(self, ready: pa.Table, last: dict) -> None:
        t = ready["_t"]
        for column in ("", *self.seconds):
            values = pa.array([""] * ready.num_rows) if not column else ready[column]
            top = pa.table({"v": values, "t": t}).group_by("v").aggregate([("t", "max")])
            for v, at in zip(top["v"].to_pylist(), top["t_max"].to_pylist(), strict=True):
                if at > last.get((column, v), -1):
                    self.last.updateValue((column, self._name(v)), (at,))

    def close(self) -> None:
        pass


def features_on_stream(stream: DataFrame, features: list[Feature], row_id: str, time: str, late: str) -> DataFrame:
    """(row_id, one column a feature), as `causal` gives them in batch, for features of one first key over a time in whole
    microseconds (`Feature.scale` turns windows into them).  A row waits until the watermark has passed its time; state is `CausalState`,
    kept in RocksDB.  What a feature with an unbounded sum would need is refused.

    Defined cases: null amounts and values add nothing, a null second key is a key, as in batch; a null time is refused by the watermark and
    never comes out; times before 1970 are fine but as long-past ones come out at once; row ids are whole numbers or texts.
    """
    if len({f.keys[0] for f in features}) != 1:
        raise ValueError("features of one stream operator share their first key")
    if any(f.window is None and f.what != "since" for f in features):
        raise ValueError("only recency may look back without an end")
    spark = stream.sparkSession
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # what maps and timers need
    key = features[0].keys[0]
    columns = sorted({c for f in features for c in (f.column, *f.keys[1:]) if c})
    summed = {f.column for f in features if f.what in ("sum", "avg", "share")}
    inner = {k for f in features for k in f.keys[1:]}
    kinds = dict(stream.dtypes)
    id_kind = "string" if kinds[row_id] == "string" else "bigint"
    state = CausalState(features, row_id, columns)
    # keys are compared as texts, so that whole numbers of any size stay apart
    state.texts = {c for c in columns if c in inner or kinds[c] == "string" or c not in summed}
    if state.texts & summed:
        state.texts -= summed - inner
    if inner & summed:
        raise ValueError("a second key cannot be summed as well")
    state.id_type = pa.string() if id_kind == "string" else pa.int64()
    made = {"count": "bigint", "distinct": "bigint", "since": "bigint"}
    shape = ", ".join([f"`{row_id}` {id_kind}", *(f"`{f.name}` {made.get(f.what, 'double')}" for f in features)])
    typed = [F.col(c).cast("string" if c in state.texts else "double").alias(c) for c in columns]
    rows = stream.where(F.col(time).isNotNull()).select(F.col(key).alias("_key"), F.col(row_id).cast(id_kind).alias(row_id), F.col(time).cast("timestamp").alias("_ts"), *typed).withColumn("_t", F.unix_micros("_ts"))
    state.arrives = rows.columns
    return rows.withWatermark("_ts", late).groupBy("_key").transformWithStateInPandas(state, shape, "append", "EventTime")
