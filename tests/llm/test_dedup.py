import random

import pytest
from pyspark.sql import functions as F

from flowspark.llm import jaccard_join, substring_dedup
from flowspark.llm.common import connected_components

from .helpers import SCHEMA, WORD, awkward, components, without_repeats


@pytest.mark.parametrize("cap", [512, 3])
def test_jaccard_join_is_exact(spark, monkeypatch, cap):
    monkeypatch.setattr(jaccard_join, "REGION_CAP", cap)
    rows = awkward()
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=str) == components(rows)


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join.jaccard_join(spark.createDataFrame([], SCHEMA)).collect() == []
    got = jaccard_join.jaccard_join(spark.createDataFrame([(3, None, None, None, 1), (4, "", None, None, 1)], SCHEMA)).collect()
    assert sorted(map(tuple, got)) == [(3, 0, 3), (4, 0, 4)]


@pytest.mark.parametrize("cap", [256, 8])
def test_large_region_of_chained_copies(spark, monkeypatch, cap):
    """Copies that drift: neighbours link, ends do not; all are one component."""
    monkeypatch.setattr(jaccard_join, "REGION_CAP", cap)
    rows = [(k, " ".join(f"t{j}" for j in range(k * 4, k * 4 + 80)), None, None, 0) for k in range(60)]
    rows += [(1000 + k, " ".join(f"t{j}" for j in range(k * 40, k * 40 + 36)) + f" own{k}" * 14, None, None, 0) for k in range(5)]
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=str) == components(rows)


@pytest.mark.parametrize("few", [0, 512])
def test_region_links_tests_every_pair(monkeypatch, few):
    import numpy as np

    monkeypatch.setattr(jaccard_join, "FEW", few)
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(60)]
    comp, _ = jaccard_join.region_links(sets, np.arange(60), 50)
    links = [(a, b) for a in range(60) for b in range(a) if 2 * len(np.intersect1d(sets[a], sets[b])) >= len(np.union1d(sets[a], sets[b]))]
    parent = list(range(60))
    for _ in range(60):
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert len(set(zip(comp, parent, strict=True))) == len(set(comp)) == len(set(parent))


def test_substring_dedup_is_exact(spark):
    rows = awkward()
    out = substring_dedup.substring_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_removed, " ".join(WORD.findall(r.text or ""))) for r in out), key=str)
    assert got == without_repeats(rows)


def test_substring_dedup_keeps_other_columns_and_spacing(spark):
    passage = " ".join(f"p{k}" for k in range(13))
    rows = [(1, f"a  b\n{passage}\tz", "x", "y", 5), (2, f"c\n\n{passage} d\te ", "x", "y", None)]
    out = substring_dedup.substring_dedup(spark.createDataFrame(rows, SCHEMA)).orderBy("doc_id").collect()
    assert [r.text for r in out] == [rows[0][1], "c\n\nd\te "]
    assert [(r.component_id, r.g) for r in out] == [("y", 5), ("y", None)]
    assert substring_dedup.substring_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_equal_windows_share_a_symbol():
    import pyarrow as pa

    from flowspark.llm.common import Words

    for k in range(200):
        inner = " ".join(f"w{(k * 7 + j * j) % 11}" for j in range(13))
        words = Words(pa.array([f"l{k} a{k} {inner} r{k}", f"{inner} z{k}"]), lower=False)
        name, start, doc, whole = substring_dedup.settled_names(words)
        first, second = ({int(n) for n, d, w in zip(name, doc, whole, strict=True) if d == x and w} for x in (0, 1))
        assert first & second


def thue_morse(n, letters):
    return "".join(letters[bin(k).count("1") % 2] for k in range(n))


def test_words_that_polynomial_hashes_confuse(spark):
    """Thue-Morse words collide under any polynomial modulo a power of two; here they are different words."""
    one, other = thue_morse(1024, "ab"), thue_morse(1024, "ba")
    words = [f"w{k}" for k in range(12)]
    rows = [(1, " ".join([*words[:6], one, *words[6:]]), None, None, 0), (2, " ".join([*words[:6], other, *words[6:]]), None, None, 0), (3, " ".join([*words[:6], one, *words[6:]]) + " more", None, None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, " ".join(WORD.findall(r.text or ""))) for r in substring_dedup.substring_dedup(docs).collect()), key=str)
    assert got == without_repeats(rows) and [g[2] for g in got] == [0, 0, 13]
    assert sorted((tuple(r) for r in jaccard_join.jaccard_join(docs).collect()), key=str) == components(rows)


def test_names_of_words_of_every_length():
    import pyarrow as pa

    from flowspark.llm.common import Words

    texts = ["x" * n + y for n in range(300) for y in "ab"] + [thue_morse(n, s) for n in (64, 128, 1024) for s in ("ab", "ba")]
    words = Words(pa.array([" ".join(texts), *texts]), lower=False)
    for lane in (0, 1):
        h = words.lane(lane)
        assert h[: len(texts)].tolist() == h[len(texts) :].tolist() and len(set(h.tolist())) == len(set(texts))


def test_sets_that_share_a_name_are_named_anew(spark, monkeypatch):
    own = jaccard_join.set_key
    monkeypatch.setattr(jaccard_join, "set_key", lambda s, salt=0: 5 if salt == 0 and len(s) else own(s, salt))
    rows = awkward()[:30]
    assert sorted((tuple(r) for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == components(rows)


def test_rows_without_ids_or_with_one_id(spark):
    rows = awkward()
    rows = [((None, 4, r[0])[k % 3], *r[1:]) for k, r in enumerate(rows)] * 2
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=str) == components(rows)


def test_sets_that_only_a_template_joins_stay_apart(spark):
    """Sets that share four fifths with all others, below the threshold, beside some that link."""
    common = [f"c{k}" for k in range(84)]
    rows = [(k, " ".join([*common, *(f"own{k}.{j}" for j in range(16 + k % 3))]), None, None, 0) for k in range(40)]
    rows += [(100 + k, " ".join([*common, *(f"own{k}.{j}" for j in range(12))]), None, None, 0) for k in range(5)]
    rows += [(200 + k, " ".join([*common, f"z{k}"]), None, None, 0) for k in range(4)]
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=str) == components(rows)


@pytest.mark.parametrize("bits", [1, 6])
def test_shingles_of_one_set_that_share_a_name(spark, monkeypatch, bits):
    """Names of few bits: a set's shingles often share one, pairs just at the threshold link all the same."""
    monkeypatch.setattr(jaccard_join, "REST_BITS", bits)
    rows = awkward()
    at = [f"e{k}" for k in range(64)]  # 60 shingles in common and 10 of each one's own: 60 of 80
    rows += [(5000 + k, " ".join([*at, *(f"x{k}.{j}" for j in range(10))]), None, None, 0) for k in range(2)]
    rows += [(6000 + k, " ".join([f"y{k % 2}" * (k > 0), *at[::-1], *(f"x{k}.{j}" for j in range(10 + k % 2))]), None, None, 0) for k in range(3)]
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=str) == components(rows)
    assert len({r.component_id for r in got if 5000 <= (r.doc_id or 0) < 6000}) == 1


@pytest.mark.parametrize("cap", [512, 16])
def test_pages_of_one_template_under_the_threshold(spark, monkeypatch, cap):
    """60 words of 70 in common bring no two pages together; words of a small vocabulary beside them do for some."""
    monkeypatch.setattr(jaccard_join, "REGION_CAP", cap)
    rng = random.Random(4)
    common = [f"c{k}" for k in range(60)]
    rows = [(k, " ".join([*common, *(f"own{k}.{j}" for j in range(10))]), None, None, 0) for k in range(120)]
    rows += [(1000 + k, " ".join([*common, *(rng.choice("abcdef") for _ in range(rng.randrange(8, 16)))]), None, None, 0) for k in range(150)]
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=str) == components(rows)


def test_a_template_alone_makes_no_candidates(spark):
    common = " ".join(f"c{k}" for k in range(60))
    rows = [(k, common + " " + " ".join(f"own{k}.{j}" for j in range(10)), None, None, 0) for k in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    described = jaccard_join.described(docs, "doc_id", "text", 5)
    assert jaccard_join.candidate_edges(docs, described.select("key", "n_shingles"), "text", 5, 75, 400 * 66, 400, 0).count() == 0


def test_connected_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 101), (-5, 100), (7, 7)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {**{k: 0 for k in range(31)}, 100: -5, 101: -5, -5: -5}
    hub = [(0, k) for k in range(1, 2500)] + [(k, 5000 + k) for k in range(1, 50)]
    got = connected_components(spark.createDataFrame(hub, "a long, b long")).collect()
    assert len(got) == 2549 and {r.component for r in got} == {0}
    assert connected_components(spark.createDataFrame([], "a long, b long")).agg(F.count("*")).first()[0] == 0
