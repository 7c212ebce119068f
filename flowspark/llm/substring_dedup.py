"""Substring dedup by recompression: passages that already start in an earlier document go.

Every document is rewritten in two rounds.  A round names pairs: the current symbols are dealt
into a left and a right half by one bit of their name, and each left symbol followed by a right
one becomes a new symbol.  Names are digests of what they stand for, so all tasks name alike
without a shared dictionary, and a symbol depends only on few words around it: after two rounds
one covers 4 words at most and is settled by the 3 words on either side.  Equal runs of
``WINDOW`` = 13 words therefore get one symbol over their middle word wherever they stand
(runs of one repeated word are never paired; inside such a run all symbols share one name, so a
run costs one name however long it is).  The rounds after that are exchanges between tasks:

* *reveal*: the distinct high-level symbols of each document, named with their settling words,
  are dealt by hash range; symbols of two documents or more are sent back;
* *verify*: only windows whose middle word lies under such a symbol are dealt by their own 128-bit
  digest; the smallest id that has the window is compared with each group's own smallest.

What travels is packed per (range, chunk of documents), so a passage in a third of all documents
is spread over as many rows as there are chunks, never a row for each occurrence in one place.

Defined cases: null, empty and short texts (under 13 words) keep all; rows sharing an id count as
one document (a window is removed only for a *smaller* id), a null id sorts after all others;
an empty table gives no rows; columns named ``n_words`` or ``n_removed`` are replaced, all others stay as they are, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import U64, Words, chunks, materialize, mix, numbered, window_hashes
from .jaccard_join import packed, unpacked

WINDOW, MARGIN, MIDDLE = 13, 3, 6
#: Entries that one range task holds; documents and bytes that one group task holds, on average.
RANGE_ENTRIES = 1_500_000
GROUP_DOCS, GROUP_BYTES = 700, 2_500_000
#: Bytes of text that a group task looks at at once.
GROUP_CHUNK = 500_000
LAST = np.iinfo(np.int64).max
#: A window's name: two digests of 64 bits over two independent names of each word.
NAME = np.dtype([("a", "<u8"), ("b", "<u8")])
DEALT = pa.schema([("r", pa.int64()), ("g", pa.int64()), ("h", pa.binary()), ("ids", pa.binary()), ("at", pa.binary())])


def distinct(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 128-bit names in order, and the place of each given one among them."""
    order = np.lexsort((names["b"], names["a"]))
    a, b = names["a"][order], names["b"][order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    number = np.empty(len(a), np.int64)
    number[order] = np.cumsum(new) - 1
    return names[order][new], number


def recompress(words: Words, rounds: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after ``rounds`` of pairing: name, first word, end word."""
    name, start = words.hash, np.arange(len(words.hash))
    end = start + 1
    doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    for k in range(rounds):
        left = (mix(name + U64(k + 1)) & U64(1)).astype(bool)
        pair = np.zeros(len(name), bool)
        pair[:-1] = left[:-1] & ~left[1:] & (doc[start[:-1]] == doc[start[1:]])
        second = np.zeros(len(name), bool)
        second[1:] = pair[:-1]
        at = np.flatnonzero(pair)
        name, end = name.copy(), end.copy()
        name[at] = mix(name[at] * U64(0xA24BAED4963EE407) + name[at + 1] * U64(0x9FB21C651E98DF25) + U64(k))
        end[at] = end[at + 1]
        name, start, end = name[~second], start[~second], end[~second]
    return name, start, end


def settled_names(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols with their settling words: name, first word, document, and whether those words exist."""
    name, start, end = recompress(words)
    doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))[start]
    lo, hi = start - MARGIN, end + MARGIN
    whole = (lo >= words.first[doc]) & (hi <= words.first[doc + 1])
    lo, hi = np.where(whole, lo, start), np.where(whole, hi, end)
    around, factor = (hi - lo).astype(U64), 1
    for k in range(int((hi - lo).max(initial=0))):
        factor = (factor * 0xE7037ED1A0B428DB + 0x8EBC6AF09C88C6E3) & 0xFFFFFFFFFFFFFFFF
        here = np.flatnonzero(lo + k < hi)
        around[here] += words.hash[lo[here] + k] * U64(factor | 1)
    return mix(around ^ name), start, doc, whole


def _symbols(docs: DataFrame, ranges: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                name, _, doc, whole = settled_names(Words(part.column("text"), lower=False))
                name, doc = name[whole], doc[whole]
                order = np.lexsort((name, doc))
                name, doc = name[order], doc[order]
                once = np.r_[True, (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])] if len(name) else np.zeros(0, bool)
                name, doc = name[once], doc[once]
                keys = part.column("key").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_pydict(packed((name % U64(ranges)).astype(np.int64), keys, doc, {"rest": (name >> U64(32)).astype(np.uint32)}))

    return docs.select("key", "text").mapInArrow(run, "r long, keys binary, counts binary, rest binary")


def _revealed(rows: pd.DataFrame, groups: int) -> dict:
    """Of one range: (group, document, rest) of symbols that two documents have."""
    keys, rest = unpacked(rows, rest=np.uint32)
    order = np.argsort(rest, kind="stable")
    t = rest[order]
    same = t[1:] == t[:-1]
    some = order[np.r_[False, same] | np.r_[same, False]]
    t, k = rest[some], keys[some]
    order = np.lexsort((k, t))
    t, k = t[order], k[order]
    heads = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.zeros(0, np.int64)
    length = np.diff(np.r_[heads, len(t)])
    two = np.repeat(k[heads] != k[heads + length - 1], length) if len(t) else np.zeros(0, bool)
    t, k = t[two], k[two]
    ids, doc = np.unique(k, return_inverse=True)
    return packed(ids[doc] % groups, ids, doc, {"rest": t})


class Group:
    """The documents of one group with the windows that revealed symbols point at."""

    def __init__(self, docs: pa.Table, notes: pd.DataFrame, ranges: int):
        self.docs, self.ord = docs, docs["ord"].to_numpy()
        names = docs["key"].to_numpy()
        flags = notes[notes["kind"] == 0]
        if len(flags):
            keys, rest = unpacked(flags, rest=np.uint32)
            r = np.concatenate([np.full(len(x) // 4, v, np.int64) for v, x in zip(flags["r"], flags["rest"], strict=True)])
            order = np.argsort(keys, kind="stable")
            keys, marks = keys[order], ((r.astype(U64) << U64(32)) | rest.astype(U64))[order]
        else:
            keys, marks = np.zeros(0, np.int64), np.zeros(0, U64)
        batch = pa.RecordBatch.from_pydict({"text": docs["text"].cast(pa.large_string()).combine_chunks()})
        self.parts: list[tuple[int, Words, np.ndarray, np.ndarray, np.ndarray]] = []
        done = 0
        for part in chunks(batch, "text", GROUP_CHUNK):
            words = Words(part.column("text"), lower=False)
            name, start, doc, whole = settled_names(words)
            mark = ((name % U64(ranges)) << U64(32)) | (name >> U64(32))
            hit = np.zeros(len(name), bool)
            cut = np.searchsorted(doc, np.arange(part.num_rows + 1))
            own = names[done : done + part.num_rows]
            for i, (lo, hi) in enumerate(zip(keys.searchsorted(own, "left"), keys.searchsorted(own, "right"), strict=True)):
                if hi > lo:
                    hit[cut[i] : cut[i + 1]] = np.isin(mark[cut[i] : cut[i + 1]], marks[lo:hi])
            h, at = window_hashes(words, WINDOW, 0)
            use = np.flatnonzero((hit & whole)[np.searchsorted(start, at + MIDDLE, "right") - 1]) if len(at) else np.zeros(0, np.int64)
            both = np.zeros(len(use), NAME)
            both["a"], both["b"] = h[use], window_hashes(words, WINDOW, 0, lane=1)[0][use] if len(use) else 0
            self.parts.append((done, words, both, at[use], done + np.searchsorted(words.first, at[use], "right") - 1))
            done += part.num_rows
        h = np.concatenate([np.zeros(0, NAME), *(p[2] for p in self.parts)])
        owner = self.ord[np.concatenate([np.zeros(0, np.int64), *(p[4] for p in self.parts)])]
        #: the distinct windows, each with the smallest id of this group that has it
        self.window, self.number = distinct(h)
        self.least = np.full(len(self.window), LAST)
        np.minimum.at(self.least, self.number, owner)

    def dealt(self, g: int, ranges: int) -> pa.Table:
        r = (self.window["a"] % U64(ranges)).astype(np.int64)
        rows = {"r": [], "g": [], "h": [], "ids": [], "at": []}
        for x in np.unique(r):
            ids, at = np.unique(self.least[r == x], return_inverse=True)
            rows["r"].append(int(x))
            rows["g"].append(g)
            rows["h"].append(self.window[r == x].tobytes())
            rows["ids"].append(ids.tobytes())
            rows["at"].append(at.astype(np.uint16 if len(ids) < 65536 else np.uint32).tobytes())
        return pa.table(rows, schema=DEALT)

    def cleaned(self, notes: pd.DataFrame, ranges: int) -> pa.Table:
        r = (self.window["a"] % U64(ranges)).astype(np.int64)
        earlier = np.zeros(len(self.window), bool)
        for _, x in notes[notes["kind"] == 1].iterrows():
            own = np.flatnonzero(r == x["r"])
            earlier[own] = np.unpackbits(np.frombuffer(x["rest"], np.uint8), count=len(own)).astype(bool)
        texts, n_words, n_removed = [], [], []
        number = np.split(self.number, np.cumsum([len(p[2]) for p in self.parts])[:-1])
        for (done, words, _, at, doc), i in zip(self.parts, number, strict=True):
            gone = earlier[i] | (self.ord[doc] > self.least[i])
            cover = np.zeros(len(words.hash) + 1, np.int32)
            np.add.at(cover, at[gone], 1)
            np.add.at(cover, at[gone] + WINDOW, -1)
            removed = np.cumsum(cover)[:-1] > 0
            count = np.r_[0, np.cumsum(removed)]
            for k in range(len(words.first) - 1):
                lo, hi = words.first[k], words.first[k + 1]
                n_words.append(int(hi - lo))
                n_removed.append(int(count[hi] - count[lo]))
                if not n_removed[-1]:
                    texts.append(self.docs["text"][done + k].as_py())
                    continue
                # from the start of each removed word to that of the word after it
                begin, stop = int(words.offsets[k]), int(words.offsets[k + 1])
                edge = np.r_[words.start[lo + 1 : hi], stop]
                change = np.zeros(stop - begin + 1, np.int32)
                np.add.at(change, words.start[lo:hi][removed[lo:hi]] - begin, 1)
                np.add.at(change, edge[removed[lo:hi]] - begin, -1)
                keep = np.cumsum(change)[:-1] == 0
                texts.append(words.data[begin:stop][keep].tobytes().decode("utf-8", "replace"))
        out = self.docs.drop_columns(["g", "ord", "key", "text"])
        out = out.append_column("text", pa.array(texts, pa.string()))
        return out.append_column("n_words", pa.array(n_words, pa.int64())).append_column("n_removed", pa.array(n_removed, pa.int64()))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` less its repeated passages, and ``n_words``, ``n_removed``."""
    work, column, kept = numbered(docs, ("n_words", "n_removed"))
    text, others = column(text_col), [k for k, name in kept if name != text_col]
    base = work.select(F.coalesce(F.col(column(id_col)).cast("long"), F.lit(LAST)).alias("ord"), F.col(text).cast("string").alias("text"), *others)
    total = base.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    ranges = max(16, int(total["bytes"] / 6 * 0.56) // RANGE_ENTRIES)
    groups = max(8, total["n"] // GROUP_DOCS, total["bytes"] // GROUP_BYTES)
    # rows are dealt by id and text, so that neither null ids nor ids in steps meet in one group
    base = base.withColumn("key", F.xxhash64("ord", "text")).withColumn("g", F.pmod("key", F.lit(groups)))

    def revealed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = pa.table(_revealed(rows, groups)).to_pandas().rename(columns={"r": "g"})
        return out.assign(r=key[0], kind=0)[["g", "kind", "r", "keys", "counts", "rest"]]

    note = "g long, kind int, r long, keys binary, counts binary, rest binary"
    flags = materialize(_symbols(base, ranges).groupBy("r").applyInPandas(revealed, note), "substring-revealed")

    def dealt(key: tuple, part: pa.Table, notes: pa.Table) -> pa.Table:
        if not len(part) or not len(notes):
            return DEALT.empty_table()
        return Group(part, notes.to_pandas(), ranges).dealt(key[0].as_py(), ranges)

    def verified(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([np.frombuffer(x, NAME) for x in rows["h"]])
        own = np.concatenate([np.frombuffer(i, np.int64)[np.frombuffer(a, np.uint16 if len(i) < 8 * 65536 else np.uint32)] for i, a in zip(rows["ids"], rows["at"], strict=True)])
        names, at = distinct(h)
        least = np.full(len(names), LAST)
        np.minimum.at(least, at, own)
        bits = np.split(least[at] < own, np.cumsum([len(x) // NAME.itemsize for x in rows["h"]])[:-1])
        return pd.DataFrame({"g": rows["g"], "kind": 1, "r": key[0], "keys": b"", "counts": b"", "rest": [np.packbits(x).tobytes() for x in bits]})

    windows = base.select("g", "ord", "key", "text").groupBy("g").cogroup(flags.groupBy("g")).applyInArrow(dealt, "r long, g long, h binary, ids binary, at binary")
    found = materialize(windows.groupBy("r").applyInPandas(verified, note), "substring-verified")

    types = base.select(*others).schema
    result = T.StructType([*types, *(T.StructField(k, t) for k, t in (("text", T.StringType()), ("n_words", T.LongType()), ("n_removed", T.LongType())))])
    empty = to_arrow_schema(result)

    def cleaned(key: tuple, part: pa.Table, notes: pa.Table) -> pa.Table:
        return Group(part, notes.to_pandas(), ranges).cleaned(notes.to_pandas(), ranges) if len(part) else empty.empty_table()

    out = base.groupBy("g").cogroup(flags.unionByName(found).groupBy("g")).applyInArrow(cleaned, result)
    return out.select(*("text" if k == text else k for k, _ in kept), "n_words", "n_removed").toDF(*(name for _, name in kept), "n_words", "n_removed")
