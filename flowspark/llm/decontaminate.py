"""Benchmark decontamination: one Aho-Corasick scan of each text for windows of benchmark items.

Texts are normalised (A-Z to lower case, words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``); a pattern is a window
of 13 consecutive item words (a shorter item is one pattern), as numbers of the benchmark's vocabulary.
One automaton holds the patterns of all items and reads each text's words once; a match marks
its words, and marked runs are mapped back to code points of the original text.

An automaton has at most 13 nodes a benchmark word, about 60 bytes each, and is shipped only under a
checked size: a benchmark of over ``BLOCK_WORDS`` words is dealt into blocks (a long item in parts that overlap
by 12 words), and the texts are scanned once for each block, one block after the other, so that neither the driver nor a
worker ever holds more than one.  Each scan writes what it found by digest of the text; the marks of a text are
then put together.

Defined cases: null or wordless texts have no words and are never contaminated; items without words
match nothing; repeated items all count; a null item_id is left out of the items; an empty
benchmark leaves all clean; columns of the documents that are named like a result are replaced, all others stay, whatever their
names.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, numbered

WINDOW = 13
BLOCK_WORDS = 200_000
PART_WORDS = 5_000
#: A-Z to lower case, other bytes outside words to a space.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ADDED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("contaminated", T.BooleanType()),
    ]
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(NORMAL).split()


class Machine:
    """The patterns of some (item, text) and the search for them."""

    def __init__(self, items: list[tuple[str | None, str]]):
        self.number: dict[bytes, int] = {}
        found: dict[tuple, set] = {}
        for item, text in items:
            w = tuple(self.number.setdefault(x, len(self.number) + 1) for x in words_of(text))
            for k in range(max(1, len(w) - WINDOW + 1) if w else 0):
                found.setdefault(w[k : k + WINDOW], set()).add(item)
        self.patterns = len(found)
        if found:
            self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            same: dict = {}
            for pattern, names in found.items():
                value = (len(pattern), frozenset(names))
                self.machine.add_word(pattern, same.setdefault(value, value))
            self.machine.make_automaton()

    def find(self, words: list[bytes]) -> tuple[set, list[tuple[int, int]]]:
        """Items with a window in the text, and the runs of words that windows cover."""
        items: set = set()
        runs: list[tuple[int, int]] = []
        if self.patterns and words:
            for end, (n, names) in self.machine.iter(tuple([self.number.get(w, 0) for w in words])):
                items |= names
                if runs and end + 1 - n <= runs[-1][1]:
                    runs[-1] = (min(runs[-1][0], end + 1 - n), end + 1)
                else:
                    runs.append((end + 1 - n, end + 1))
        return items, runs


#: The automaton that this Python worker has built last, by the name of its block: the tasks of a scan share it.
_last: dict[str, Machine] = {}


def built(name: str, shipped) -> Machine:
    if name not in _last:
        _last.clear()
        _last[name] = Machine(shipped.value)
    return _last[name]


def finish(text: str | None, words: list[bytes], items: set, runs: list[tuple[int, int]]) -> tuple[int, int, list[str], list[dict], bool]:
    if not runs:
        return len(words), 0, [], [], False
    cover = np.zeros(len(words) + 1, np.int64)
    begin, stop = np.array(runs).T
    np.add.at(cover, begin, 1)
    np.add.at(cover, stop, -1)
    hit = np.cumsum(cover)[:-1] > 0
    raw = (text or "").encode("utf-8", "surrogatepass")
    places = [m.span() for m in WORD.finditer(raw)]
    edges = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
    point = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # code points up to each byte
    spans = [{"start": int(point[places[a][0]]) - 1, "end": int(point[places[b - 1][1] - 1])} for a, b in zip(edges[::2], edges[1::2], strict=True)]
    n_hit = int(hit.sum())
    return len(words), n_hit, sorted(items - {None}), spans, 20 * n_hit >= len(words)


def parts(benchmark: DataFrame) -> DataFrame:
    """(id, part, text, n): items in parts of at most ``PART_WORDS`` words that share 12 with the next."""
    step = PART_WORDS - WINDOW + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                w = words_of(text)
                for k in range(0, max(1, len(w) - WINDOW + 1) if w else 0, step):
                    some = w[k : k + PART_WORDS]
                    rows.append((item, k, b" ".join(some).decode("utf-8", "replace"), len(some)))
            yield pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate((("id", pa.string()), ("part", pa.int64()), ("text", pa.string()), ("n", pa.int64())))})

    return benchmark.mapInArrow(run, "id string, part long, text string, n long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_hit, items, spans (code points, end exclusive) and contaminated."""
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).cast("string").alias("text"))
    items = materialize(parts(items.where(F.col("text").isNotNull())), "benchmark-parts")
    blocks = 1 + (items.agg(F.sum("n")).first()[0] or 0) // BLOCK_WORDS
    context = docs.sparkSession.sparkContext
    work, column, named = numbered(docs, ADDED.names)
    names, text = [k for k, _ in named], F.col(column(text_col)).cast("string")
    work = work.select(*names, text.alias("text"))

    def shipped(b: int):
        return uuid.uuid4().hex, context.broadcast([tuple(x) for x in items.where(F.pmod(F.xxhash64("id", "part"), F.lit(blocks)) == b).select("id", "text").collect()])

    def added(batch: pa.RecordBatch, texts: list, found: list) -> pa.RecordBatch:
        rows = [finish(t, *f) for t, f in zip(texts, found, strict=True)]
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.bool_())
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*names, *ADDED.names])

    schema = T.StructType([*work.select(*names).schema.fields, *ADDED.fields])
    shown = lambda out: out.toDF(*(name for _, name in named), *ADDED.names)
    if blocks == 1:
        one = shipped(0)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = built(*one)
            for batch in batches:
                texts = batch.column("text").to_pylist()
                words = [words_of(t) for t in texts]
                yield added(batch, texts, [(w, *machine.find(w)) for w in words])

        return shown(work.mapInArrow(scan, schema))

    matches = None
    for b in range(blocks):
        block = shipped(b)

        def scan_block(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            machine = built(*block)
            for batch in batches:
                rows = [(d, *machine.find(words_of(t))) for d, t in zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist(), strict=True)]
                rows = [(d, sorted(i, key=str), [x for r in runs for x in r]) for d, i, runs in rows if runs]
                yield pa.RecordBatch.from_pydict({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate((("digest", pa.binary()), ("found", pa.list_(pa.string())), ("runs", pa.list_(pa.int64()))))})

        texts = work.select(F.unhex(F.sha2("text", 256)).alias("digest"), "text")
        some = materialize(texts.mapInArrow(scan_block, "digest binary, found array<string>, runs array<long>").dropDuplicates(["digest"]), "benchmark-matches")
        matches = some if matches is None else matches.unionByName(some)
        block[1].unpersist()
    whole = materialize(matches.groupBy("digest").agg(F.flatten(F.collect_list("found")).alias("found"), F.flatten(F.collect_list("runs")).alias("runs")), "benchmark-marks")
    both = work.withColumn("digest", F.unhex(F.sha2("text", 256))).join(whole, "digest", "left").drop("digest")

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, items_, runs = (batch.column(c).to_pylist() for c in ("text", "found", "runs"))
            yield added(batch, texts, [(words_of(t), set(i or ()), list(zip(r[::2], r[1::2], strict=True)) if r else []) for t, i, r in zip(texts, items_, runs, strict=True)])

    return shown(both.mapInArrow(put_together, schema))
