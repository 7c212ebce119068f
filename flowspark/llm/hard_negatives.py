"""Hard negatives for every anchor and each of its positives, exactly.

Vectors are scaled and floored to whole numbers, a score is their inner product.  Higher scores come first, ties by the smaller id.
An anchor's positives are its first ``n_positives`` other rows of its label; a negative is a row of another label whose score
lies in a window that the positive's score sets (``least`` to ``most`` percent of it), and the first ``n_negatives`` are mined.

Anchors go in blocks of at most ``BLOCK``, neighbours in the order of their signs together, and each block has a minimal spanning tree.
For a child c of p and a row x, <c, x> = <p, x> + <c - p, x>, and the last term is at most |c - p| |x| either way.  So bounds
of all rows' scores at p, plus and minus the edge's length times each row's norm, bound them at c.  Only rows whose bounds reach
what still counts at c are scored there (and then have exact bounds for c's children): for positives, scores from the last of the
best so far upwards; for negatives, any of the anchor's windows, each narrowed from below by the last of its best so far.

Every row meets every block, in batches: a stated query set against all rows.  Blocks are broadcast in rounds of at most ``ROUND_BYTES``,
whatever the number of anchors; a task keeps for each anchor of the round the best few of its rows, and the tasks' bests are put together by a
rank within (anchor, positive), where a group has a few rows a task.  No pair is written, nothing is sampled.

Defined cases: rows with a null id, label or vector, or a null or non-finite component take no part; an id names one row: equal rows count once,
of different rows of one id the one that sorts first by label and vector; a vector that is shorter than others counts as filled up with zeros; an anchor
without another row of its label, or a window that nothing meets, gives no rows; scores that do not fit a long are an error; an
empty table gives none; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BLOCK = 512
ROUND_BYTES = 32_000_000
#: Rows that are scored at once.
ROWS = 2048
#: Signs that make up the order of anchors.
SIGNS = 16
FITS_DOUBLE, FITS_LONG = 2.0**53, 2.0**63


def prepared(rows: DataFrame, id_col: Column, label: Column, vector: Column, scale: float) -> DataFrame:
    """(id, label, x) of the rows that take part."""
    finite = F.forall(vector, lambda v: F.coalesce(~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")), F.lit(False)))
    whole = F.transform(vector, lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("long"))
    out = rows.where(id_col.isNotNull() & label.isNotNull() & vector.isNotNull() & finite).select(id_col.cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("x"))
    out = materialize(out, "negatives-rows")
    if not out.groupBy("id").count().where("count > 1").isEmpty():
        out = materialize(out.groupBy("id").agg(F.min(F.struct("label", "x")).alias("r")).select("id", "r.*"), "negatives-rows")
    return out


def _matrix(column: pa.ListArray, width: int | None = None) -> np.ndarray:
    """The vectors of a list column, one a row, filled up with zeros to the longest or to ``width``."""
    sizes = np.diff(column.offsets.to_numpy(zero_copy_only=False))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    width = max(width or 0, int(sizes.max(initial=0)))
    if sizes.size and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows (the one nearest to the mean first, parents before children), each one's parent as a place in that
    order (-1 for the first) and its distance from it: Prim's minimal tree."""
    points = x.astype(np.float64)
    square = (points * points).sum(1)
    root = int(np.argmin(((points - points.mean(0)) ** 2).sum(1)))
    n = len(x)
    order, place, parents, lengths = [], np.full(n, -1), [], []
    near, by, left = np.full(n, np.inf), np.full(n, -1), np.ones(n, bool)
    now = root
    for _ in range(n):
        place[now] = len(order)
        order.append(now)
        left[now] = False
        parents.append(place[by[now]] if by[now] >= 0 else -1)
        lengths.append(float(np.sqrt(((points[now] - points[by[now]]) ** 2).sum())) if by[now] >= 0 else 0.0)
        apart = np.maximum(square + square[now] - 2 * (points @ points[now]), 0)
        closer = left & (apart < near)
        near[closer], by[closer] = apart[closer], now
        now = int(np.argmin(np.where(left, near, np.inf)))
    return np.array(order), np.array(parents), np.array(lengths)


def blocks(anchors: DataFrame, n: int) -> DataFrame:
    """(block, ids, labels, width, x, parents, lengths): the anchors (id, label, x) in blocks, in the order of their trees."""
    schema = "block long, ids binary, labels binary, width int, x binary, parents binary, lengths binary"
    names = [c.split()[0] for c in schema.split(", ")]
    sign = F.aggregate(F.transform(F.slice("x", 1, SIGNS), lambda v, i: F.when(v > 0, F.pow(F.lit(2), SIGNS - i)).otherwise(0.0)), F.lit(0.0), lambda a, b: a + b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packed(some: pa.Table) -> pa.RecordBatch:
            ids, labels = (some.column(c).to_numpy() for c in ("id", "label"))
            x = _matrix(some.column("x").combine_chunks())
            order, parents, lengths = spanning_tree(x)
            row = (int(ids.min()), ids[order].tobytes(), labels[order].tobytes(), x.shape[1], x[order].tobytes(), parents.astype(np.int64).tobytes(), lengths.tobytes())
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= BLOCK:
                whole = pa.Table.from_batches(held)
                yield packed(whole.slice(0, BLOCK).combine_chunks())
                held = whole.slice(BLOCK).to_batches()
        if sum(b.num_rows for b in held):
            yield packed(pa.Table.from_batches(held).combine_chunks())

    dealt = anchors.withColumn("sign", sign).repartitionByRange(max(1, n // (4 * BLOCK)), "sign", "id").sortWithinPartitions("sign", "id")
    return dealt.select("id", "label", "x").mapInArrow(run, schema)


class Block:
    """A block's anchors, and the bounds of a batch's scores as they go down its tree."""

    def __init__(self, row):
        self.ids, self.labels, self.parents = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels", "parents"))
        self.x = np.frombuffer(row["x"], np.int64).reshape(len(self.ids), row["width"])
        self.lengths = np.frombuffer(row["lengths"], np.float64)
        self.largest = float(np.abs(self.x.astype(np.float64)).max(initial=0))

    def scores(self, x: np.ndarray, wanted):
        """For each anchor k in turn, (k, rows, their exact scores): the rows of ``x`` that ``wanted(k, low, high)`` marks, given bounds of all
        rows' scores."""
        width = max(x.shape[1], self.x.shape[1])
        wide = lambda m: m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))
        x, anchors = wide(x), wide(self.x)
        bound = self.largest * float(np.abs(x.astype(np.float64)).max(initial=0)) * max(1, width)
        if bound >= FITS_LONG:
            raise OverflowError("scores do not fit a long")
        points = x.astype(np.float64)
        if bound < FITS_DOUBLE:  # sums of whole numbers are exact in doubles
            exact = lambda rows, k, a=anchors.astype(np.float64): (points if rows is None else points[rows]) @ a[k]
        else:
            exact = lambda rows, k: (x if rows is None else x[rows]) @ anchors[k]
        # a little more than the norms, for what rounding takes off
        norms = np.sqrt((points * points).sum(1)) * (1 + 1e-9) + 1e-6
        low, high = (np.empty((len(self.ids), len(x))) for _ in range(2))
        for k, parent in enumerate(self.parents):
            if parent < 0:
                low[k] = high[k] = exact(None, k)
                slack = np.abs(low[k]) * 1e-15 if bound >= FITS_DOUBLE else 0.0
                low[k] -= slack
                high[k] += slack
                rows = np.flatnonzero(wanted(k, low[k], high[k]))
            else:
                reach = norms * (self.lengths[k] * (1 + 1e-9))
                np.subtract(low[parent], reach, out=low[k])
                np.add(high[parent], reach, out=high[k])
                rows = np.flatnonzero(wanted(k, low[k], high[k]))
            if rows.size:
                found = exact(rows, k).astype(np.int64)
                low[k, rows] = high[k, rows] = found
                if bound >= FITS_DOUBLE:
                    low[k, rows] = np.nextafter(low[k, rows], -np.inf)
                    high[k, rows] = np.nextafter(high[k, rows], np.inf)
                yield k, rows, found


class Best:
    """The first ``size`` (score, id): higher scores first, then smaller ids."""

    __slots__ = ("ids", "scores", "size")

    def __init__(self, size: int):
        self.size, self.scores, self.ids = size, np.empty(0, np.int64), np.empty(0, np.int64)

    def least(self) -> float:
        """Lower scores do not count any more."""
        return self.scores[-1] if len(self.scores) == self.size else -np.inf

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.r_[self.scores, scores], np.r_[self.ids, ids]
        first = np.lexsort((ids, -scores))[: self.size]
        self.scores, self.ids = scores[first], ids[first]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            yield batch.column("id").to_numpy(), batch.column("label").to_numpy(), _matrix(batch.column("x"))


FOUND = "anchor long, positive long, positive_score long, other long, score long"


def _rows(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in FOUND.split(", ")])


def _first(found: DataFrame, n: int) -> DataFrame:
    """The first ``n`` of each (anchor, positive), with their rank; a group has at most ``n`` rows a task."""
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def positives(rows: DataFrame, shipped, n: int) -> DataFrame:
    """(anchor, other, score, rank) of the anchors in the broadcast blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Block(b) for b in shipped.value]
        best = [[Best(n) for _ in t.ids] for t in trees]
        for ids, labels, x in _batches(batches):
            for t, tops in zip(trees, best, strict=True):
                for k, some, scores in t.scores(x, lambda k, low, high, t=t, tops=tops: (labels == t.labels[k]) & (high >= tops[k].least()) & (ids != t.ids[k])):
                    tops[k].add(scores, ids[some])
        yield _rows([(int(a), None, None, int(i), int(s)) for t, tops in zip(trees, best, strict=True) for a, b in zip(t.ids, tops, strict=True) for i, s in zip(b.ids, b.scores, strict=True)])

    return _first(rows.mapInArrow(run, FOUND), n).select("anchor", "other", "score", "rank")


def negatives(rows: DataFrame, shipped, n: int, least: int, most: int) -> DataFrame:
    """(anchor, positive, positive_score, other, score, rank); the broadcast blocks have ``positives``: by anchor, (id, score) in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Block(b) for b in shipped.value]
        sides = []  # by block and anchor: (positive, score, lowest, highest, best)
        for b in shipped.value:
            # least * p <= 100 * s <= most * p, in whole numbers
            sides.append([[(i, p, -((-least * p) // 100), (most * p) // 100, Best(n)) for i, p in b["positives"].get(a, ()) if least * p <= most * p] for a in np.frombuffer(b["ids"], np.int64).tolist()])
        for ids, labels, x in _batches(batches):
            for t, side in zip(trees, sides, strict=True):

                def wanted(k: int, low: np.ndarray, high: np.ndarray, side=side, t=t) -> np.ndarray:
                    out = np.zeros(len(low), bool)
                    for *_, lowest, highest, best in side[k]:
                        out |= (high >= max(lowest, best.least())) & (low <= highest)
                    return out & (labels != t.labels[k])

                for k, some, scores in t.scores(x, wanted):
                    for *_, lowest, highest, best in side[k]:
                        fits = (scores >= max(lowest, best.least())) & (scores <= highest)
                        if fits.any():
                            best.add(scores[fits], ids[some[fits]])
        yield _rows([(int(a), i, p, int(o), int(s)) for t, side in zip(trees, sides, strict=True) for a, mine in zip(t.ids, side, strict=True) for i, p, _, _, best in mine for o, s in zip(best.ids, best.scores, strict=True)])

    return _first(rows.mapInArrow(run, FOUND), n)


def hard_negatives(rows: DataFrame, is_anchor: Column, id_col: Column, label: Column, vector: Column, scale: float = 256.0, n_positives: int = 5, n_negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``is_anchor`` is a column over ``id`` and ``label``."""
    spark = rows.sparkSession
    rows = prepared(rows, id_col, label, vector, scale)
    anchors = rows.where(is_anchor)
    made = materialize(blocks(anchors, anchors.count()), "negatives-blocks")
    held = made.agg(F.sum(F.octet_length("x"))).first()[0] or 0
    rounds = 1 + held // ROUND_BYTES
    parts = []
    for k in range(rounds):
        mine = [r.asDict() for r in made.where(F.pmod(F.xxhash64("block"), F.lit(rounds)) == k).collect()]  # about ROUND_BYTES
        if not mine and parts:
            continue
        shipped = spark.sparkContext.broadcast(mine)
        good = materialize(positives(rows, shipped, n_positives), "negatives-positives")
        shipped.unpersist()
        by_anchor: dict[int, list] = {}
        for r in good.orderBy("anchor", "rank").collect():  # a few a anchor of this round
            by_anchor.setdefault(r.anchor, []).append((r.other, r.score))
        for b in mine:
            b["positives"] = {a: by_anchor[a] for a in np.frombuffer(b["ids"], np.int64).tolist() if a in by_anchor}
        shipped = spark.sparkContext.broadcast(mine)
        parts.append(materialize(negatives(rows, shipped, n_negatives, least, most), "negatives-mined"))
        shipped.unpersist()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
