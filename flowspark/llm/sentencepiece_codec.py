"""SentencePiece (BPE model) encoding and decoding by suffix-array matching.

A batch of texts is normalised by the model, joined, and cut where a word mark follows another character
(no piece crosses such a place, which `Pieces` checks).  Equal units of the batch stand for each
other; those not met before are joined into one text.  Its suffix array is binary-searched for every
piece at once, which gives each piece its range of occurrences.  Occurrences are edges (start,
length, piece), dealt by position into a table.  Relaxing the edges then settles all units in
step: each round joins, in every unit, the adjacent pair whose edge scores best (the leftmost of
equals), until no edge is left, which is the model's own order of merges.  A unit of over
``LONG`` letters takes its edges from a heap in that same order, so its time is n log n.  What no
piece covers falls back to bytes.

Memory is bounded by ``UNIT_CHARS`` of distinct text at a time (or one unit, if longer; long units are cut
where no piece holds the two letters next to each other) and a bounded store of settled
units; each task works on Arrow batches, and nothing is shuffled.

Defined cases: null and empty texts have no ids and decode to the empty text (null ids stay null);
texts of any length are whole; repeated rows are settled once a batch; columns named like a
result are replaced, all others stay, whatever their names; U+2581 decodes as a space, as in the library.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, numbered, text_bytes

MARK = "▁"
UNIT_CHARS = 1_000_000
STORE_UNITS = 500_000
BATCH_CHARS = 8_000_000
LONG = 48
#: Widths of the tables in which units of up to so many letters settle together.
WIDTHS = (3, 5, 7, 9, 12, 16, 24, LONG)


class Pieces:
    """The normal pieces of a model as code points, best score first, and the byte pieces."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        every = range(m.vocab_size())
        normal = [i for i in every if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        normal.sort(key=lambda i: (-m.get_score(i), i))
        self.ids = np.array(normal, np.int32)
        texts = [m.id_to_piece(i) for i in normal]
        if any(MARK in t.lstrip(MARK) for t in texts):
            raise ValueError("a piece of this model crosses words")
        self.length = np.array([len(t) for t in texts])
        self.depth = int(self.length.max())
        self.codes = np.zeros((len(texts), self.depth), np.uint32)
        for k, t in enumerate(texts):
            self.codes[k, : len(t)] = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        score = np.array([m.get_score(i) for i in normal])
        #: place in the order of scores; equal scores have one place
        self.level = np.unique(-score, return_inverse=True)[1].astype(np.int32)
        both = (self.codes[:, 1:] != 0).nonzero()
        self.pairs = np.unique(self.codes[both].astype(np.int64) << 32 | self.codes[both[0], both[1] + 1])
        self.bytes = np.array([m.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        shown = [b"" if m.is_control(i) else bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace(MARK, " ").encode() for i in every]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_size = np.array([len(x) for x in shown])
        self.shown_at = np.cumsum(self.shown_size) - self.shown_size
        self.is_byte = np.array([m.is_byte(i) for i in every])


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Order of the suffixes by their first ``depth`` symbols (small non-negative codes, 0 pads), the first key
    of each suffix in that order, and the symbols and bits a symbol that the key holds."""
    bits = int(text.max(initial=1)).bit_length()
    held = min(depth, 62 // bits)
    padded = np.concatenate([text, np.zeros(held, text.dtype)]).astype(np.int64)
    key = np.zeros(len(text), np.int64)
    for j in range(held):
        key = key << bits | padded[j : j + len(text)]
    first, known = key, held
    while True:
        order = np.argsort(key)
        if known >= depth:
            return order, first[order], held, bits
        ranks = np.empty(len(key), np.int64)
        ranks[order] = np.cumsum(np.r_[1, key[order[1:]] != key[order[:-1]]])
        after = np.zeros(len(key), np.int64)
        after[:-known] = ranks[known:]
        key, known = ranks * (len(key) + 1) + after, known * 2


def occurrences(text: np.ndarray, pieces: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array, and the range of each piece in it: a binary search of all pieces by their first key, then
    of the pieces that are longer than a key, within those ranges and in step."""
    depth = pieces.shape[1]
    order, first, held, bits = suffix_array(text, depth)
    lead = np.zeros(len(pieces), np.int64)
    for j in range(held):
        lead = lead << bits | (pieces[:, j] if j < depth else 0)
    room = np.int64(1) << (bits * np.maximum(0, held - length)).astype(np.int64)
    lo, hi = np.searchsorted(first, lead), np.searchsorted(first, lead + room)
    long = np.flatnonzero((length > held) & (lo < hi))
    if long.size:
        padded = np.concatenate([text, np.zeros(depth, text.dtype)])
        windows = np.lib.stride_tricks.sliding_window_view(padded, depth)
        inside = np.arange(depth) < length[long, None]
        ends = []
        for side in (0, 1):
            a, b = lo[long], hi[long]
            while (open_ := np.flatnonzero(a < b)).size:
                mid = (a[open_] + b[open_]) // 2
                differ = (windows[order[mid]].astype(np.int64) - pieces[long[open_]]) * inside[open_]
                at = np.argmax(differ != 0, axis=1)
                sign = differ[np.arange(len(open_)), at]
                below = sign < 0 if side == 0 else sign <= 0
                a[open_[below]], b[open_[~below]] = mid[below] + 1, mid[~below]
            ends.append(a)
        lo[long], hi[long] = ends
    return order, lo, hi


class Edges:
    """Occurrences of pieces by position: ``at(start, size)`` is the place of a piece, or ``none``."""

    def __init__(self, text: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: np.ndarray, level: np.ndarray, depth: int):
        self.depth, self.none, n = depth, len(length), hi - lo
        small = np.uint16 if self.none < 65535 else np.uint32
        self.table = np.full(len(text) * depth, self.none, small)
        at = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        self.table[order[at] * depth + np.repeat(length - 1, n)] = np.repeat(np.arange(self.none, dtype=small), n)
        #: order of merging by place; the last is for no edge
        self.level = np.append(level, np.iinfo(np.int32).max).astype(np.int32)

    def at(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return self.table[start * self.depth + np.minimum(size, self.depth) - 1]

    def pair(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return self.level[np.where(size <= self.depth, self.at(start, size), self.none)]


def relax(edges: Edges, base: np.ndarray, letters: np.ndarray, width: int, sizes: np.ndarray) -> None:
    """Settle units of up to ``width`` letters in step; ``sizes`` gets the letters of each symbol at its start."""
    never = edges.level[-1]
    row = np.arange(width + 1, dtype=np.int64)[:, None]
    size = np.zeros((width + 2, len(base)), np.int64)
    size[: width + 1] = row < letters
    before = np.zeros_like(size)  # letters of the symbol that ends there
    before[1 : width + 1] = size[:width]
    value = np.full((width, len(base)), never, np.int32)
    for i in range(width - 1):
        some = np.flatnonzero(i + 1 < letters)
        value[i, some] = edges.pair(base[some] + i, np.full(len(some), 2))
    while len(base):
        i, c = value.argmin(axis=0), np.arange(len(base))
        open_ = value[i, c] != never
        if not open_.all():
            over = np.flatnonzero(~open_)
            for k in range(width):
                sizes[(base[over] + k)[size[k, over] > 0]] = size[k, over][size[k, over] > 0]
            size, before, value = size[:, open_], before[:, open_], value[:, open_]
            base, i, c = base[open_], i[open_], np.arange(int(open_.sum()))
            if not len(base):
                return
        left = size[i, c]
        right = size[i + left, c]
        both = left + right
        size[i, c], size[i + left, c], value[i + left, c] = both, 0, never
        before[i + both, c] = both
        after = size[i + both, c]
        value[i, c] = np.where(after > 0, edges.pair(base + i, both + after), never)
        prior = before[i, c]
        some = np.flatnonzero(prior)
        start = i[some] - prior[some]
        value[start, c[some]] = edges.pair(base[some] + start, prior[some] + both[some])


def relax_long(edges: Edges, base: int, letters: int, sizes: np.ndarray) -> None:
    """Settle one long unit, best edge first, from a heap."""
    depth, none, table, level = edges.depth, edges.none, edges.table, edges.level.tolist()
    size, before = [1] * letters + [0], [0] + [1] * letters
    heap = [(int(v), i, 2) for i, v in enumerate(edges.pair(base + np.arange(letters - 1), np.full(letters - 1, 2))) if v != level[-1]]
    heapq.heapify(heap)
    while heap:
        _, i, both = heapq.heappop(heap)
        left = size[i]
        if not left or left == both or left + size[i + left] != both:
            continue  # one of the two has been joined to another since
        size[i], size[i + left], before[i + both] = both, 0, both
        for start, n in ((i, both + size[i + both] if size[i + both] else 0), (i - before[i], before[i] + both if before[i] else 0)):
            if 0 < n <= depth and (place := table[(base + start) * depth + n - 1]) != none:
                heapq.heappush(heap, (level[place], start, n))
    sizes[base : base + letters] = size[:-1]


def settle(units: list[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all units, joined, and the number of each unit."""
    raw = np.frombuffer("\0".join([*units, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    here = np.bincount(raw, minlength=1) if raw.max() < 1 << 21 else None
    letters = np.flatnonzero(here).astype(np.uint32)
    code = np.zeros(int(raw.max()) + 1, np.int64)
    code[letters] = np.arange(1, len(letters) + 1)
    text = code[raw]
    count = np.array([len(u) for u in units])
    first = np.cumsum(count + 1) - count - 1
    text[first + count] = 0
    cut = np.zeros(len(text), bool)  # a letter that no piece holds next to the one before it
    for k in np.flatnonzero(count > LONG):
        a, b = first[k], first[k] + count[k]
        pair = raw[a : b - 1].astype(np.int64) << 32 | raw[a + 1 : b]
        cut[a + 1 : b] = pieces.pairs[np.minimum(np.searchsorted(pieces.pairs, pair), len(pieces.pairs) - 1)] != pair
    cut[first] = True
    base = np.flatnonzero(cut)
    size = np.diff(np.r_[base, len(text)])
    size[np.searchsorted(base, first + count) - 1] -= 1  # the separator
    place = np.where(pieces.codes < len(code), code[np.minimum(pieces.codes, len(code) - 1)], 0)
    inside = np.arange(pieces.depth) < pieces.length[:, None]
    use = np.flatnonzero(((place > 0) | ~inside).all(axis=1))
    order, lo, hi = occurrences(text, np.where(inside[use], place[use], 0), pieces.length[use])
    edges = Edges(text, order, lo, hi, pieces.length[use], pieces.level[use], pieces.depth)
    sizes = np.zeros(len(text), np.int64)
    low = 0
    for width in WIDTHS:
        some = np.flatnonzero((size > low) & (size <= width))
        if some.size:
            relax(edges, base[some], size[some], width, sizes)
        low = width
    for k in np.flatnonzero(size > LONG):
        relax_long(edges, int(base[k]), int(size[k]), sizes)
    start = np.flatnonzero(sizes)
    found = edges.at(start, sizes[start])
    ids = np.append(pieces.ids[use], -1)[found]
    per = np.ones(len(ids), np.int64)
    lost = np.flatnonzero(ids < 0)
    spelled = [np.frombuffer(chr(raw[start[k]]).encode("utf-8", "surrogatepass"), np.uint8) for k in lost]
    per[lost] = [len(b) for b in spelled]
    flat = np.repeat(ids, per)
    if len(lost):
        flat[flat < 0] = pieces.bytes[np.concatenate(spelled)]
    return flat, np.bincount(np.searchsorted(first, start, "right") - 1, weights=per, minlength=len(units)).astype(np.int64)


def cut_units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The units of all texts in order, and where each text's begin (one more than texts)."""
    data, offsets = text_bytes(texts)
    mark = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)) if len(data) > 2 else np.zeros(0, np.int64)
    follows = np.r_[False, mark[1:] - mark[:-1] == 3] if len(mark) else np.zeros(0, bool)
    cut = np.zeros(len(data) + 1, bool)
    cut[mark[~follows]] = True
    cut[offsets] = True
    cut[-1] = False
    start = np.flatnonzero(cut)
    ends = np.r_[start, len(data)].astype(np.int64)
    units = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))
    return units, np.searchsorted(start, offsets)


class Encoder:
    """Ids of texts; units settled before are kept, up to a bound."""

    def __init__(self, model_file: str):
        self.pieces = Pieces(model_file)
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, joined, and where each text's begin (one more than texts)."""
        if len(self.number) > STORE_UNITS:
            self._forget()
        normal = pa.array([self.pieces.model.normalize(t) if t else "" for t in texts], pa.large_string())
        units, bounds = cut_units(normal)
        named = units.dictionary_encode()
        distinct, number = named.dictionary.to_pylist(), self.number
        new = [u for u in distinct if u not in number]
        flats, ats, k, base = [self.flat], [self.at], 0, self.at[-1]
        while k < len(new):
            to, chars = k, 0
            while to < len(new) and (to == k or chars + len(new[to]) < UNIT_CHARS):
                chars += len(new[to]) + 1
                to += 1
            flat, count = settle(new[k:to], self.pieces)
            flats.append(flat)
            ats.append(base + np.cumsum(count))
            base = ats[-1][-1]
            for u in new[k:to]:
                number[u] = len(number)
            k = to
        if len(flats) > 1:
            self.flat, self.at = np.concatenate(flats), np.concatenate(ats)
        flat, at = self.flat, self.at
        chosen = np.array([number[u] for u in distinct], np.int64)[named.indices.to_numpy()] if len(distinct) else np.zeros(0, np.int64)
        begin = at[chosen]
        count = at[chosen + 1] - begin
        ends = np.r_[0, np.cumsum(count)]
        ids = flat[np.repeat(begin - ends[:-1], count) + np.arange(ends[-1])]
        return ids, ends[bounds]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The texts that ``ids`` between ``bounds`` spell."""
        p = self.pieces
        n = p.shown_size[ids]
        ends = np.r_[0, np.cumsum(n)]
        data = p.shown[np.repeat(p.shown_at[ids] - ends[:-1], n) + np.arange(ends[-1])]
        at = ends[bounds]
        lead = np.zeros(len(at) - 1, np.int64)
        some = np.flatnonzero(at[1:] > at[:-1])
        lead[some] = data[at[some]] == 32
        if lead.any():
            stay = np.ones(len(data), bool)
            stay[at[:-1][lead > 0]] = False
            data, at = data[stay], at - np.r_[0, np.cumsum(lead)]
        spelled = np.r_[0, np.cumsum(p.is_byte[ids])][bounds]
        odd = np.flatnonzero(spelled[1:] > spelled[:-1])  # only bytes can spell what is no text
        whole = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        if not len(odd):
            return whole.cast(pa.string())
        raw = whole.view(pa.large_binary())
        texts, last = [], 0
        for k in odd.tolist():
            texts += [whole.slice(last, k - last).cast(pa.string()), pa.array([raw[k].as_py().decode("utf-8", "replace")], pa.string())]
            last = k + 1
        return pa.concat_arrays([*texts, whole.slice(last).cast(pa.string())])


def encode(docs: DataFrame, model_file: str, text_col: str = "text", out_col: str = "token_ids", decoded_col: str | None = None) -> DataFrame:
    """``docs`` with the ids of ``text_col``, an array of integers, and in ``decoded_col`` what they spell, if named."""
    new = [out_col, *([decoded_col] if decoded_col else [])]
    work, column, kept = numbered(docs, new)
    # a text column that a result replaces is read all the same
    text, shown = column(text_col), [k for k, _ in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model_file)
        for batch in batches:
            for part in chunks(batch, text, BATCH_CHARS):
                ids, bounds = encoder(part.column(text).to_pylist())
                made = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))]
                if decoded_col:
                    made.append(encoder.decode(ids, bounds))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in shown), *made], names=names)

    added = [T.StructField(out_col, T.ArrayType(T.IntegerType())), *([T.StructField(decoded_col, T.StringType())] if decoded_col else [])]
    schema = T.StructType([*work.select(*shown).schema.fields, *(T.StructField(f"made{i}", f.dataType) for i, f in enumerate(added))])
    names = schema.names
    return work.select(*dict.fromkeys([*shown, text])).mapInArrow(run, schema).toDF(*(name for _, name in kept), *new)


def decode(docs: DataFrame, model_file: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """``docs`` with the text that ``ids_col`` spells (null ids: null)."""
    work, column, kept = numbered(docs, [out_col])
    ids_at, shown = column(ids_col), [k for k, _ in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Encoder(model_file)
        for batch in batches:
            for part in (batch.slice(k, 500) for k in range(0, batch.num_rows, 500)):
                lists = part.column(ids_at)
                size = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
                texts = decoder.decode(lists.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(size)])
                if lists.null_count:
                    texts = pa.array([t if ok else None for t, ok in zip(texts.to_pylist(), lists.is_valid().to_pylist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in shown), texts], names=[*shown, "made"])

    schema = T.StructType([*work.select(*shown).schema.fields, T.StructField("made", T.StringType())])
    return work.select(*dict.fromkeys([*shown, ids_at])).mapInArrow(run, schema).toDF(*(name for _, name in kept), out_col)
