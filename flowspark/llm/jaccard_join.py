"""N-gram Jaccard join: exact similarity classes of documents under the Jaccard metric.

Documents are sets of word shingles; two link when ``1 - J <= epsilon``.  The join is a
metric-space join in three levels, each one exact:

1. *Singleton pivots.*  Almost all pairs of documents are at distance 1, so whole documents
   are useless as first pivots.  The pivots of this level are the sets ``{s}`` of one shingle.
   A document's nearest pivots are its own shingles, the rarest first; the triangle
   inequality bounds the window: if ``d(A, B) <= epsilon``, B holds a shingle among the
   first ``|A| - ceil((1 - epsilon) |A|) + 1`` of A in any order both share.  A document
   is therefore replicated to the regions of that many rarest shingles, and regions with a
   single class of documents vanish.  Rarity is counted over all documents.
2. *Regions.*  A region is further cut by size: of a linked pair the smaller set must hold the pivot so
   early that the rest of both sets can still make the overlap; a set that no such anchor
   reaches leaves the region.  Overlapping regions are merged (connected components), so each class
   of equal sets travels once.
3. *Document pivots.*  Inside a region, pivots are documents: each gets exact distances to
   the others, ``|d(x, p) - d(y, p)| > epsilon`` rules pairs out, and pairs already in one
   component need no test.  A region above ``REGION_CAP`` classes is joined recursively: its members meet
   its pivots in blocks, which links most of a dense region at once; members outside the largest
   component stay in the Voronoi cell of their nearest pivot, every member is replicated to the
   cells within 2 epsilon of its nearest pivot and epsilon of the cell's radius, and each cell is
   joined the same way with pivots of its own.  A cell of few outside members meets all its members
   as a query set, in blocks.  Only where windows rule nothing out any more are the pairs that are
   left compared, in blocks.

Defined cases: a null or wordless text has an empty set, is linked with nothing and is its own
component; equal rows link; rows with a null ``doc_id`` take part, and ``component_id`` is the
smallest non-null id of the component (null if it has none); an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Words, chunks, connected_components, if_small, materialize, mix, window_hashes

#: Tokens that one region task of level 1 holds, and classes that one task of level 3 holds.
RANGE_TOKENS = 1_000_000
#: Bits that name a shingle within its range.
REST_BITS = 32
REGION_CAP = 512
PIVOTS = 8
#: Sets that meet each other without bounds of their own.
FEW = 32
#: Times that a region is dealt into cells of cells.
LEVELS = 4


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text (fewer words: the whole sequence as one)."""
    words = Words(texts, lower=True)
    h, at = window_hashes(words, size, size)
    cut = np.searchsorted(at, words.first)
    out = []
    for i in range(len(texts)):
        if cut[i + 1] > cut[i]:
            out.append(np.unique(h[cut[i] : cut[i + 1]]))
        elif (k := words.first[i + 1] - words.first[i]) > 0:
            out.append(mix(np.array([int.from_bytes(words.hash[words.first[i] : words.first[i + 1]].tobytes(), "little") % (2**64 - 59) ^ int(k)], dtype=U64)))
        else:
            out.append(np.zeros(0, U64))
    return out


def set_key(s: np.ndarray, salt: int = 0) -> int:
    """64-bit name of a set, as a signed long; sets with one name are one class."""
    return _name(s, 0x51ED270B + 2 * salt)


def set_check(s: np.ndarray) -> int:
    """A second name, by which `_named` finds out whether two sets share the first."""
    return _name(s, 0x2545F4914F6CDD1D)


def _name(s: np.ndarray, salt: int) -> int:
    if not len(s):
        return 0
    m = mix(s + U64(salt))
    a, b = int(np.sum(m, dtype=U64)), int(np.bitwise_xor.reduce(m * U64(0x9FB21C651E98DF25)))
    return int(mix(np.array([(a * 31 + b * 0x9E3779B97F4A7C15 + len(s) + salt) & (2**64 - 1)], dtype=U64)).view(np.int64)[0])


def text_digest(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col).cast("string"))


def described(docs: DataFrame, id_col: str, text_col: str, size: int, salt: int = 0) -> DataFrame:
    """(id, digest, n_shingles, key, check) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = shingle_sets(part.column("text"), size)
                made = [[len(s) for s in sets], [set_key(s, salt) for s in sets], [set_check(s) for s in sets]]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("digest"), *(pa.array(x, pa.int64()) for x in made)], names=["id", "digest", "n_shingles", "key", "check"])

    given = docs.select(F.col(id_col).cast("long").alias("id"), text_digest(text_col).alias("digest"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, "id long, digest long, n_shingles long, key long, check long")


def _dealt(docs: DataFrame, text_col: str, size: int, ranges: int, salt: int) -> DataFrame:
    """Shingles of all documents by hash range: per range and chunk, the keys, counts and 32-bit rests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                by_key = {}
                for s in shingle_sets(part.column("text"), size):
                    if len(s):
                        by_key.setdefault(set_key(s, salt), s)
                if not by_key:
                    continue
                keys, sets = np.array(list(by_key), np.int64), list(by_key.values())
                doc = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
                h = np.concatenate(sets)
                yield pa.RecordBatch.from_pydict(packed(h % U64(ranges), keys, doc, {"rest": (h >> U64(64 - REST_BITS)).astype(np.uint32)}))

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "r long, keys binary, counts binary, rest binary")


def packed(r: np.ndarray, keys: np.ndarray, doc: np.ndarray, columns: dict[str, np.ndarray]) -> dict:
    """Rows by ``r``: distinct ``keys[doc]`` in order, how many entries each has, and the entries."""
    order = np.lexsort((doc, r)) if len(r) else np.zeros(0, np.int64)
    r, doc = r[order], doc[order]
    columns = {k: v[order] for k, v in columns.items()}
    heads = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, np.int64)
    out = {"r": [], "keys": [], "counts": [], **{k: [] for k in columns}}
    for lo, hi in zip(heads, np.r_[heads, len(r)][1:], strict=True):
        d = doc[lo:hi]
        first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        out["r"].append(int(r[lo]))
        out["keys"].append(keys[d[first]].tobytes())
        out["counts"].append(np.diff(np.r_[first, hi - lo]).astype(np.uint32).tobytes())
        for k, v in columns.items():
            out[k].append(v[lo:hi].tobytes())
    return {k: pa.array(v, pa.int64() if k == "r" else pa.binary()) for k, v in out.items()}


def unpacked(rows: pd.DataFrame, **types) -> tuple[np.ndarray, ...]:
    """The key of each entry, then the columns named in ``types``."""
    keys = np.concatenate([np.repeat(np.frombuffer(k, np.int64), np.frombuffer(c, np.uint32)) for k, c in zip(rows["keys"], rows["counts"], strict=True)])
    return keys, *(np.concatenate([np.frombuffer(x, t) for x in rows[c]]) for c, t in types.items())


def _shared(rows: pd.DataFrame, groups: int) -> dict:
    """Of one range: entries whose shingle is in two classes or more, by group of classes.  Where shingles of one
    set share a name, all but one come as entries of level 0, which the windows of the set count."""
    keys, rest = unpacked(rows, rest=np.uint32)
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(x) // 4 for x in rows["rest"]])
    order = np.argsort(rest, kind="stable")
    t = rest[order]
    same = t[1:] == t[:-1]
    some = order[np.r_[False, same] | np.r_[same, False]]
    t, k, row = rest[some], keys[some], row[some]
    order = np.lexsort((row, k, t))
    t, k, row = t[order], k[order], row[order]
    once = np.r_[True, (t[1:] != t[:-1]) | (k[1:] != k[:-1])] if len(t) else np.zeros(0, bool)
    # copies of a class come in other rows; in one row a name met again is another shingle of the set
    again = ~once & (row == row[once][np.cumsum(once) - 1])
    again_t, again_k = t[again], k[again]
    t, k = t[once], k[once]
    heads = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.zeros(0, np.int64)
    df = np.repeat(np.diff(np.r_[heads, len(t)]), np.diff(np.r_[heads, len(t)]))
    t, k, df = t[df > 1], k[df > 1], df[df > 1]
    level = np.minimum(255, np.ceil(8 * np.log2(np.maximum(df, 1)))).astype(np.uint8)
    t, k, level = np.r_[t, again_t], np.r_[k, again_k], np.r_[level, np.zeros(len(again_t), np.uint8)]
    classes, doc = np.unique(k, return_inverse=True)
    return packed(classes[doc] % groups, classes, doc, {"rest": t, "level": level})


def candidate_edges(docs: DataFrame, classes: DataFrame, text_col: str, size: int, percent: int, tokens: int, n_classes: int, salt: int) -> DataFrame:
    """Levels 1 and 2: (a, b) of classes that share a region and whose sizes may link."""
    ranges = max(16, -(-tokens // RANGE_TOKENS))
    groups = max(16, n_classes // 2000)

    def shared(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = pa.table(_shared(rows, groups)).to_pandas()
        return out.rename(columns={"r": "g"}).assign(r=key[0])[["g", "r", "keys", "counts", "rest", "level"]]

    def windows(key: tuple, known: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"r": [], "keys": [], "counts": [], "rest": [], "reach": [], "n": []})
        if not len(rows) or not len(known):
            return empty
        keys, rest, level = unpacked(rows, rest=np.uint32, level=np.uint8)
        r = np.concatenate([np.full(len(x) // 4, v, np.int64) for v, x in zip(rows["r"], rows["rest"], strict=True)])
        known = known.sort_values("key")
        at = known["key"].to_numpy().searchsorted(keys)
        lost = np.bincount(at[level == 0], minlength=len(known))  # shingles without a name of their own
        order = np.lexsort((rest, r, level, at))
        order = order[level[order] > 0]
        if not len(order):
            return empty
        at, r, rest = at[order], r[order], rest[order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        count = np.diff(np.r_[first, len(at)])
        n = known["n"].to_numpy()[at[first]]
        alone = n - lost[at[first]] - count  # names that no other class has come first
        # a name for two shingles shortens the set and the overlap that it needs alike
        window = n - (percent * n + 99) // 100 + 1 - alone
        rank = np.arange(len(at)) - np.repeat(first, count)
        use = rank < np.repeat(np.minimum(window, count), count)
        if not use.any():
            return empty
        all_n = known["n"].to_numpy()
        # the largest partner: the overlap is at most what is left from here on
        size_, place = np.repeat(n, count), np.repeat(alone, count) + rank
        reach = (size_ - place) * (100 + percent) // percent - size_
        out = pa.table(packed(r[use].astype(U64), known["key"].to_numpy(), at[use], {"rest": rest[use], "reach": reach[use].astype(np.int32)})).to_pandas()
        out["n"] = [all_n[known["key"].to_numpy().searchsorted(np.frombuffer(k, np.int64))].tobytes() for k in out["keys"]]
        return out

    def regions(rows: pd.DataFrame) -> pd.DataFrame:
        keys, rest, reach = unpacked(rows, rest=np.uint32, reach=np.int32)
        n = np.concatenate([np.repeat(np.frombuffer(x, np.int64), np.frombuffer(c, np.uint32)) for x, c in zip(rows["n"], rows["counts"], strict=True)])
        anchor = reach >= n  # it may link with sets of its own size or more
        order = np.lexsort((keys, ~anchor, n, rest))
        keys, rest, n, anchor = keys[order], rest[order], n[order], anchor[order]
        reach = np.where(anchor, np.minimum(reach[order], 100 * n // percent), 0)
        # a region falls apart where sizes in order leave what no smaller anchor reaches
        new = np.r_[True, rest[1:] != rest[:-1]]
        far = np.maximum.accumulate(reach + (np.cumsum(new) << 40)) - (np.cumsum(new) << 40)
        new[1:] |= n[1:] > far[:-1]
        hub = keys[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        out = pd.DataFrame({"a": keys, "b": hub})
        return out[out["a"] != out["b"]].drop_duplicates()

    dealt = _dealt(docs, text_col, size, ranges, salt)
    both = dealt.groupBy("r").applyInPandas(shared, "g long, r long, keys binary, counts binary, rest binary, level binary")
    known = classes.select(F.expr(f"pmod(key, {groups}L)").alias("g"), "key", F.col("n_shingles").alias("n"))
    placed = known.groupBy("g").cogroup(both.groupBy("g")).applyInPandas(windows, "r long, keys binary, counts binary, rest binary, reach binary, n binary")
    return placed.groupBy("r").applyInPandas(lambda rows: regions(rows), "a long, b long").distinct()


def region_links(sets: list[np.ndarray], start: np.ndarray, percent: int, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Level 3 in memory: component of each set given components at the ``start``, exact.

    The first ``first`` sets are pivots of the whole region: their distances to all sets are the
    second result.  Every pair is tested, ruled out by a window, or already in one component.
    """
    k = len(sets)
    n = np.array([len(s) for s in sets])
    comp = np.unique(start, return_inverse=True)[1]
    tokens, doc = np.concatenate(sets), np.repeat(np.arange(k), n)
    order = np.argsort(tokens, kind="stable")
    tokens, doc = tokens[order], doc[order]
    epsilon = 1 - percent / 100
    known: list[np.ndarray] = []
    far = np.full((first, k), np.nan)
    near = _near_sets(tokens, doc, n, percent) if k - first > FEW else None
    for p in range(k):
        if p >= first:
            may = np.zeros(k, bool)
            may[p + 1 :] = True
            may &= (comp != comp[p]) & (100 * np.minimum(n, n[p]) >= percent * np.maximum(n, n[p]))
            for d in known:
                may &= ~(np.abs(d - d[p]) > epsilon + 1e-9)
            if near is not None and may.any():
                may &= near(p)
            if not may.any():
                continue
            if len(known) == PIVOTS and (some := np.flatnonzero(may)).size * 8 < k:
                both = np.concatenate([sets[q] for q in some])
                at = np.minimum(sets[p].searchsorted(both), n[p] - 1)
                inter = np.bincount(np.repeat(np.arange(some.size), n[some])[sets[p][at] == both], minlength=some.size)
                joined = comp[some[100 * inter >= percent * (n[some] + n[p] - inter)]]
                comp[np.isin(comp, joined)] = comp[p]
                continue
        lo, hi = np.searchsorted(tokens, sets[p], "left"), np.searchsorted(tokens, sets[p], "right")
        length = hi - lo
        at = np.repeat(lo - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum())
        inter = np.bincount(doc[at], minlength=k)
        union = n + n[p] - inter
        d = 1 - inter / np.maximum(union, 1)
        if p < first:
            far[p] = d
        if len(known) < PIVOTS:
            known.append(d)
        joined = np.unique(comp[(100 * inter >= percent * union) & (union > 0)])
        comp[np.isin(comp, joined)] = comp[p]
    return comp, far


def _near_sets(tokens: np.ndarray, doc: np.ndarray, n: np.ndarray, percent: int):
    """A function from a set's number to the mask of the sets that the bounds of level 1 leave it, by the order of
    rarity among these sets alone: what all share comes last and brings no two together that need more than it."""
    token, df = np.unique(tokens, return_inverse=True, return_counts=True)[1:]
    order = np.lexsort((token, df[token], doc))
    token, doc = token[order], doc[order]
    place = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    use = place < n[doc] - (percent * n[doc] + 99) // 100 + 1
    token, doc, place = token[use], doc[use], place[use]
    reach = (n[doc] - place) * (100 + percent) // percent - n[doc]
    first = np.searchsorted(doc, np.arange(len(n) + 1))
    post = np.argsort(token, kind="stable")
    start = np.searchsorted(token[post], np.arange(len(df) + 1))

    def near(p: int) -> np.ndarray:
        own = slice(first[p], first[p + 1])
        lo, length = start[token[own]], start[token[own] + 1] - start[token[own]]
        at = post[np.repeat(lo - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum())]
        other = doc[at]
        smaller = n[p] <= n[other]
        out = np.zeros(len(n), bool)
        out[other[np.where(smaller, np.repeat(reach[own], length) >= n[other], reach[at] >= n[p])]] = True
        return out

    return near


def _local(rows: pd.DataFrame, size: int, percent: int) -> pd.DataFrame:
    """Links of the regions in ``rows`` (region, key, text, comp): (a, b) by component."""
    a, b = [], []
    for _, part in rows.drop_duplicates(["region", "key", "cell"]).groupby(["region", "cell"]):
        if len(part) > 1:
            part = part.sort_values("key")  # links lead to the smallest key
            keys = part["key"].to_numpy()
            comp, _ = region_links(shingle_sets(pa.array(part["text"], pa.large_string()), size), part["comp"].to_numpy(), percent)
            hub = np.full(comp.max() + 1, -1)
            hub[comp[::-1]] = np.arange(len(comp))[::-1]
            out = keys[hub[comp]] != keys
            a.append(keys[out])
            b.append(keys[hub[comp]][out])
    return pd.DataFrame({"a": np.concatenate([*a, np.zeros(0, np.int64)]), "b": np.concatenate([*b, np.zeros(0, np.int64)])})


def _cell_links(pieces: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links within (region, cell, comp, key) rows, each cell joined in one task."""
    full = pieces.distinct().join(texts.drop("n"), ["region", "key"])
    return full.groupBy("region", "cell").applyInPandas(lambda rows: _local(rows, size, percent), "a long, b long")


def _in_blocks(cells: DataFrame) -> DataFrame:
    """(region, cell, comp, key): outside members of each cell against all its members, in blocks of half a cap."""
    half = REGION_CAP // 2
    cells = cells.withColumns({"bo": F.ceil(F.col("n_own") / half), "ba": F.ceil(F.col("n_all") / half)})
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    own = cells.where("own").select("region", "cell", "key", "comp", F.pmod(F.xxhash64("key"), "bo").alias("x"), upto("ba").alias("y"))
    every = cells.select("region", "cell", "key", "comp", upto("bo").alias("x"), F.pmod(F.xxhash64("key"), "ba").alias("y"))
    return own.unionByName(every).select("region", F.xxhash64("cell", "x", "y").alias("cell"), "comp", "key")


def _sized(cells: DataFrame) -> tuple[DataFrame, int]:
    """Cells that hold outside members, with their counts, and the comparisons that they would take."""
    count = cells.groupBy("region", "cell").agg(F.count_if("own").alias("n_own"), F.count("*").alias("n_all")).where("n_own > 0")
    count = materialize(count, "jaccard-cell-sizes")
    return materialize(cells.join(count, ["region", "cell"]), "jaccard-cells"), count.agg(F.sum(F.col("n_own") * F.col("n_all"))).first()[0] or 0


def _pivot_distances(cells: DataFrame, texts: DataFrame, size: int, percent: int, level: int) -> DataFrame:
    """(region, cell, key, own, pivot, comp, hub, far): the distances of all members of each cell to its pivots, which are
    outside members drawn by hash, at the first level half of them the smallest sets (where a template is nearly the whole
    of a set, they link with most others), and the first member (a pivot if one is) of its component within the block.
    ``comp`` comes in as what is known to be connected and goes out as the first comp of the component."""
    span = Window.partitionBy("region", "cell").orderBy(F.xxhash64("key", F.lit(level)), "key")
    # the smallest hashes of a sample of about 8 * PIVOTS outside members (the first level has as many as it wants)
    some = cells.where("own").where(F.pmod(F.xxhash64("key", F.lit(level), F.lit(7)), F.col("n_own")) < 8 * PIVOTS).withColumn("rank", F.row_number().over(span)).where(F.col("rank") <= PIVOTS)
    if not level:
        least = Window.partitionBy("region", "cell").orderBy("n", "key")
        small = cells.join(texts.select("region", "key", "n"), ["region", "key"]).withColumn("rank", F.row_number().over(least)).where(F.col("rank") <= PIVOTS // 2)
        # ranks stay unlike, as all blocks must meet the pivots in one order
        some = some.where(F.col("rank") <= PIVOTS - PIVOTS // 2).withColumn("rank", F.col("rank") + PIVOTS)
        some = small.select(*some.columns).unionByName(some).groupBy(*cells.columns).agg(F.min("rank").alias("rank"))
    blocks = F.ceil(F.col("n_all") * 2 / REGION_CAP).cast("long")
    pivots = some.select("region", "cell", "key", "own", "comp", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), "rank")
    dealt = cells.select("region", "cell", "key", "own", "comp", F.pmod(F.xxhash64("key"), blocks).alias("block"), F.lit(0).alias("rank"))

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = pd.concat([rows[rows["rank"] > 0].sort_values("rank"), rows[rows["rank"] == 0].sort_values("key")])
        first = int((rows["rank"] > 0).sum())
        keys = rows["key"].to_numpy()
        start = rows["comp"].to_numpy()
        comp, far = region_links(shingle_sets(pa.array(rows["text"], pa.large_string()), size), start, percent, first)
        hub = np.full(comp.max() + 1, -1)
        hub[comp[::-1]] = np.arange(len(comp))[::-1]
        out = rows[["region", "cell", "key", "own"]].assign(pivot=rows["rank"] > 0, comp=start[hub[comp]], hub=keys[hub[comp]])
        return out.assign(far=pd.Series(list(far.T), dtype=object, index=out.index))

    full = dealt.unionByName(pivots).join(texts.drop("n"), ["region", "key"])
    return full.groupBy("region", "cell", "block").applyInPandas(block, "region long, cell long, key long, own boolean, pivot boolean, comp long, hub long, far array<double>")


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    """What the pivots of one region, seen from all blocks, say is connected: (region, comp, root)."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            x = root[x] = root[root[x]]
        return x

    for a, b in zip(rows["was"], rows["comp"], strict=True):
        root[find(a)] = find(b)
    return pd.DataFrame({"region": rows["region"].iloc[0], "comp": list(root), "root": [find(x) for x in root]})


def _large_regions(members: DataFrame, size: int, percent: int) -> DataFrame:
    """Links within regions of more classes than one task should hold; ``members``: region, key, n, text."""
    texts = materialize(members, "jaccard-large")
    every = texts.select("region", F.col("region").alias("cell"), "key", F.lit(True).alias("own"), F.col("key").alias("comp"))
    cells, cost = _sized(every)
    links, most = None, None
    epsilon = 1 - percent / 100

    def gathered(more: DataFrame, name: str) -> None:
        nonlocal links
        more = materialize(more, name)
        links = more if links is None else links.unionByName(more)

    for level in range(LEVELS):
        few = (F.col("n_own") <= REGION_CAP // 2) | (F.col("n_all") <= REGION_CAP)
        if most is not None:  # at first all cells are large
            gathered(_cell_links(_in_blocks(cells.where(few)), texts, size, percent), "jaccard-cell-links")
            cells = cells.where(~few)
            if cells.isEmpty():
                return links
        seen = materialize(_pivot_distances(cells, texts, size, percent, level), "jaccard-pivots")
        gathered(seen.where("key <> hub").select(F.col("key").alias("a"), F.col("hub").alias("b")), "jaccard-seen-links")
        # pivots are in every block: their comps there, a few a cell, say which comps of different blocks are one
        said = seen.where("pivot").join(cells.select("region", "cell", "key", F.col("comp").alias("was")), ["region", "cell", "key"]).select("region", "was", "comp").distinct()
        roots = materialize(said.groupBy("region").applyInPandas(_merged, "region long, comp long, root long"), "jaccard-roots")
        seen = seen.where("not pivot").join(roots, ["region", "comp"], "left").withColumn("comp", F.coalesce("root", "comp")).drop("root")
        if most is None:  # members of the largest component need not find each other; it stays the same one below
            sizes = seen.groupBy("region", "comp").count()
            most = materialize(sizes.groupBy("region").agg(F.max_by("comp", F.struct("count", "comp")).alias("most")), "jaccard-most")
        else:
            moved = roots.withColumnsRenamed({"comp": "most"})
            most = materialize(most.join(moved, ["region", "most"], "left").select("region", F.coalesce("root", "most").alias("most")), "jaccard-most")
        near = F.array_position("far", F.array_min("far")).cast("int") - 1
        outside = seen.join(most, "region").select("region", "cell", "key", "comp", "far", near.alias("near"), (F.col("own") & (F.col("comp") != F.col("most"))).alias("own"))
        seen = materialize(outside, "jaccard-outside")
        radius = seen.where("own").groupBy("region", "cell", F.col("near").alias("to")).agg(F.max(F.array_min("far")).alias("radius"))
        spread = seen.select("region", "cell", "key", "comp", "own", "near", F.array_min("far").alias("least"), F.posexplode("far").alias("to", "d"))
        spread = spread.where((F.col("d") <= F.col("least") + 2 * epsilon + 1e-9) | (F.col("to") == F.col("near")))
        spread = spread.join(radius, ["region", "cell", "to"]).where(F.col("d") <= F.col("radius") + epsilon + 1e-9)
        deeper, less = _sized(spread.select("region", F.xxhash64("cell", "to").alias("cell"), "key", (F.col("own") & (F.col("to") == F.col("near"))).alias("own"), "comp"))
        if not less:
            return links
        if 2 * less > cost:  # windows rule too little out: compare what pivots have left
            cells = _sized(seen.select("region", "cell", "key", "own", "comp"))[0]
            break
        cells, cost = deeper, less
    gathered(_cell_links(_in_blocks(cells), texts, size, percent), "jaccard-left")
    return links


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """(id_col, n_shingles, component_id) of every row; see the module's text."""
    rows, named = _named(docs, id_col, text_col, size, percent)
    if named is None:
        return rows.select(F.col("id").alias(id_col), "n_shingles", F.col("id").alias("component_id"))
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    names = materialize(named.join(least, "comp").select("key", "component_id"), "jaccard-names")
    out = rows.join(names, "key", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """(id, digest, n) of one row of each component: the smallest id, nulls last, then the smallest
    `text_digest`; ``n`` rows are equal to it.  Wordless rows are one component where id and text are equal."""
    rows, named = _named(docs, id_col, text_col, size, percent)
    per = rows.groupBy("key", F.col("n_shingles") > 0, "id", "digest").agg(F.count("*").alias("n")).toDF("key", "linked", "id", "digest", "n")
    per = materialize(per, "jaccard-equal")
    wordless = per.where("not linked").select("id", "digest", "n")
    if named is None:
        return wordless
    best = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "digest", "n")).alias("best")
    # by class first, so that a class of many rows meets its component as one row
    best_of_class = per.where("linked").groupBy("key").agg(best)
    best = best_of_class.join(named, "key").groupBy("comp").agg(F.min("best").alias("best"))
    return best.select("best.id", "best.digest", "best.n").unionByName(wordless)


def _named(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """The described rows, and (key, least id, comp) of every class of them, or None without classes."""
    for salt in range(4):
        rows = materialize(described(docs, id_col, text_col, size, salt), "jaccard-rows")
        # one row of the documents, by id and digest, stands for each class
        digest = F.coalesce(F.min_by("digest", "id"), F.min("digest")).alias("digest")
        classes = rows.where("n_shingles > 0").groupBy("key").agg(F.first("n_shingles").alias("n_shingles"), F.min("id").alias("least"), digest, (F.min("check") != F.max("check")).alias("shared"))
        classes = materialize(classes, "jaccard-classes")
        total = classes.agg(F.sum("n_shingles").alias("tokens"), F.count("*").alias("n"), F.max("shared").alias("shared")).first()
        if not total["shared"]:
            break
    else:
        raise RuntimeError("different sets share a name under every salt")
    if not total["n"]:
        return rows, None
    edges = materialize(candidate_edges(docs, classes, text_col, size, percent, total["tokens"], total["n"], salt), "jaccard-edges")
    regions = materialize(connected_components(edges).select(F.col("node").alias("key"), F.col("component").alias("region")), "jaccard-regions")
    # sizes are written first: the join then has a shuffle of its own on either side, which Spark can split
    sizes = materialize(regions.groupBy("region").agg(F.count("*").alias("n_region")), "jaccard-sizes")
    links = region_join(docs, classes, regions.join(sizes, "region"), id_col, text_col, size, percent)
    comps = materialize(connected_components(links), "jaccard-linked")
    return rows, classes.join(comps, classes["key"] == comps["node"], "left").select("key", "least", F.coalesce("component", "key").alias("comp"))


def region_join(docs: DataFrame, classes: DataFrame, regions: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """Levels 2 and 3: links between the classes of each region, from one text a class."""
    rep = classes.select("key", F.col("least").alias("_id"), F.col("digest").alias("_digest"), F.col("n_shingles").alias("n")).join(regions, "key")
    rep = materialize(rep, "jaccard-reps")
    n = rep.count()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_digest(text_col).alias("digest"), F.col(text_col).cast("string").alias("text"))
    picked = texts.join(if_small(rep, n), texts["id"].eqNullSafe(rep["_id"]) & (texts["digest"] == rep["_digest"])).select("region", "n_region", "key", "n", "text")
    # rows of one id and text come as often as they are given: one a class goes on
    picked = picked.groupBy("region", "n_region", "key", "n").agg(F.min("text").alias("text")).withColumns({"cell": F.lit(0).cast("long"), "comp": F.col("key")})
    bins = max(16, n // 200)
    small = picked.where(F.col("n_region") <= REGION_CAP).withColumn("bin", F.pmod(F.xxhash64("region"), F.lit(bins)))
    links = materialize(small.groupBy("bin").applyInPandas(lambda part: _local(part, size, percent), "a long, b long"), "jaccard-links")
    if rep.where(F.col("n_region") > REGION_CAP).isEmpty():
        return links
    large = picked.where(F.col("n_region") > REGION_CAP).select("region", "key", "n", "text")
    return links.unionByName(_large_regions(large, size, percent))
