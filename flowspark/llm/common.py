"""Shared helpers: scratch tables, word hashing on Arrow text, connected components."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
CHUNK_BYTES = 2_000_000
#: Words of more bytes are named by BLAKE2b, shorter ones eight bytes at a time.
LONG_WORD = 128
#: Odd multipliers of the two 64-bit lanes of a word's name, and of their windows.
LANES = ((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F))


#: The folder of this process where the session names none, as in tests.
_own: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir``, or a temporary one in a session of one
    machine, as in tests.  A cluster must name its folder: no machine's own folder is seen by the others."""
    root = spark.conf.get("spark.checkpoint.dir", None) or _own.get("dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        root = _own["dir"] = tempfile.mkdtemp(prefix="flowspark-")
    return f"{root.rstrip('/')}/flowspark"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: this cuts the lineage."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, new: tuple[str, ...] | list[str]):
    """``df`` with its columns named c0, c1, ... by place, a function from a column's name to its number, and (number, name) of
    the columns that stay beside results named ``new``.  An operator's own columns can then clash with none of
    the caller's, whatever these are called: dots, quotes and names of intermediate columns included."""
    names = df.columns
    at = {name: f"c{i}" for i, name in enumerate(names)}

    def column(name: str) -> str:
        if name not in at:
            raise ValueError(f"no column {name!r} among {names}")
        return at[name]

    return df.toDF(*(f"c{i}" for i in range(len(names)))), column, [(f"c{i}", name) for i, name in enumerate(names) if name not in new]


def restored(df: DataFrame, kept: list[tuple[str, str]], new: tuple[str, ...] | list[str]) -> DataFrame:
    """The columns that stay under their own names again, then ``new``."""
    return df.select(*(number for number, _ in kept), *new).toDF(*(name for _, name in kept), *new)


def if_small(df: DataFrame, rows: int, limit: int = 500_000) -> DataFrame:
    """Broadcast ``df`` only when its known row count is under ``limit``; otherwise leave a shuffle join."""
    return F.broadcast(df) if rows <= limit else df


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift-multiply), vectorised."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Words:
    """Words of the texts of an Arrow string array, as hashes.

    ``hash``: one 64-bit hash a word (`lane` gives a second, independent one); ``start``/``end``: byte offsets within ``data``;
    ``first``: index of each document's first word (length documents + 1);
    ``offsets``: byte offsets of the documents.  Words are maximal runs of bytes that
    are not ASCII white space (0x20, 0x09-0x0D), or of ``is_word`` bytes if given.
    """

    def __init__(self, texts: pa.Array, lower: bool, is_word: np.ndarray | None = None):
        data, offsets = text_bytes(texts)
        if lower:
            data = LOWER[data]
        word = (WORD_BYTES if is_word is None else is_word)[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        before = np.empty_like(word)
        before[:1] = False
        before[1:] = word[:-1]
        self.start = np.flatnonzero(word & (~before | edge[:-1]))
        after = np.empty_like(word)
        after[-1:] = False
        after[:-1] = word[1:]
        self.end = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.data, self.offsets = data, offsets
        self.first = np.searchsorted(self.start, offsets)
        self.hash = self.lane(0)

    def lane(self, k: int) -> np.ndarray:
        """The ``k``-th 64 bits of every word's name, a chain over its bytes, eight at a time."""
        step = U64(LANES[k][0])
        size = self.end - self.start
        eight = np.ndarray(len(self.data) + 1, "<u8", np.r_[self.data, np.zeros(8, np.uint8)].tobytes(), strides=(1,))
        out = mix((size.astype(U64) + U64(k + 1)) * step)
        some, at = np.flatnonzero(size <= LONG_WORD), 0
        while some.size:
            left = np.minimum(size[some] - at, 8).astype(U64)
            block = eight[self.start[some] + at] & (~U64(0) >> (U64(64) - U64(8) * left))
            out[some] = mix(out[some] ^ block * step)
            at += 8
            some = some[size[some] > at]
        for i in np.flatnonzero(size > LONG_WORD):
            name = hashlib.blake2b(self.data[self.start[i] : self.end[i]].tobytes(), digest_size=16).digest()
            out[i] = int.from_bytes(name[8 * k : 8 * k + 8], "little")
        return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD_BYTES = np.ones(256, dtype=bool)
WORD_BYTES[[32, 9, 10, 11, 12, 13]] = False


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document offsets of a string array; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, dtype=np.uint8)[lo:hi] if data is not None and hi > lo else np.zeros(0, np.uint8)
    return raw, offsets - lo


def chunks(batch: pa.RecordBatch, column: str, size: int = CHUNK_BYTES):
    """Slices of ``batch`` whose texts hold about ``size`` bytes (one document at least)."""
    n = batch.num_rows
    if not n:
        return
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield batch.slice(at, to - at)
        at = to


def window_hashes(words: Words, size: int, salt: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words inside one document, and the index of its first word."""
    h = words.lane(lane) if lane else words.hash
    n = len(h)
    if n < size:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    total = np.full(n - size + 1, salt, dtype=U64)
    factor = 1
    for k in range(size):
        factor = (factor * LANES[lane][1] + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF
        total += h[k : n - size + 1 + k] * U64(factor | 1)
    doc_end = np.repeat(words.first[1:], np.diff(words.first))
    at = np.flatnonzero(np.arange(n - size + 1) + size <= doc_end[: n - size + 1])
    return mix(total[at]), at


#: Edges of one node that a task of a star step may meet.
HUB_EDGES = 500


def _state(edges: DataFrame) -> tuple[int, int]:
    """Nodes that keep ``edges`` (from u down to v) from being stars around roots, and the number of hubs."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    per = ends.groupBy("x").agg(F.count("*").alias("n"), F.sum("up").alias("ups"))
    loose, hubs = per.agg(F.count_if((F.col("ups") > 0) & (F.col("n") > 1)), F.count_if(F.col("n") > HUB_EDGES)).first()
    return loose, hubs


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node of an undirected graph.

    ``edges``: columns ``a``, ``b`` (long).  Returns ``node``, ``component`` for every node
    of an edge.  Alternates the large-star and small-star steps until every node has one edge, to a root; the
    edges of a hub, and of hubs only, meet its minimum in as many pieces as its degree asks
    for.  Every round is written to the shared folder, so a lost executor costs one
    round.  Empty input gives no rows.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")
    for _ in range(rounds):
        loose, hubs = _state(now)
        if not loose:
            break
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        if hubs:
            pieces = (F.col("n") / HUB_EDGES).cast("long")
            cut = least.where(F.col("n") > HUB_EDGES).select("u", pieces.alias("pieces"))
            dealt = both.join(if_small(cut, hubs), "u", "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("v"), F.col("pieces") + 1), F.lit(0))).drop("pieces")
            spread = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("n") > HUB_EDGES, pieces).otherwise(0)))
            large = dealt.join(least.select("u", "m", spread.alias("piece")), ["u", "piece"])
        else:
            large = both.join(least, "u")
        large = large.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small_m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_m, "u")
        now = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_m.select("u", F.col("m").alias("v")))
        now = materialize(now.where("u <> v").distinct(), "cc")
    else:
        raise RuntimeError("connected components did not settle")
    return now.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("component")), F.struct(F.col("v").alias("node"), F.col("v").alias("component")))).alias("x")).select("x.*").distinct()
