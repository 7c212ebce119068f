import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from flowspark.llm import merkle, queries

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, `tree` int, `a.b` int"


def framed(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def climb(digests):
    """Root of a list of digests, and each one's siblings level by level."""
    paths, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        runs = [digests[k : k + 8] for k in range(0, len(digests), 8)]
        for i, p in enumerate(at):
            run, k = runs[p // 8], p % 8
            paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
        at = [p // 8 for p in at]
        digests = [H(*run) for run in runs]
    return digests[0], paths


def brute_force(rows):
    trees = {}
    for doc_id, source, lang, n_chars, text, *_ in rows:
        leaf = lambda t: H(*map(framed, (doc_id, source, lang, n_chars, t)))  # noqa: B023, E731
        tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        shown = leaf(text.translate({c: c + 32 for c in range(65, 91)}) if text is not None and tampered else text)
        trees.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf(text), doc_id, shown))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    subroots, paths = {}, {}
    for lang in names:
        trees[lang].sort()
        subroots[lang], paths[lang] = climb([r[2] for r in trees[lang]])
    root, over = climb([subroots[x] for x in names]) if names else (None, [])
    out = []
    for lang, more in zip(names, over, strict=True):
        for (_, _, leaf, doc_id, shown), path in zip(trees[lang], paths[lang], strict=True):
            now = shown
            for before, after in path + more:
                now = H(before, now, after)
            out.append((doc_id, leaf, subroots[lang], root, H(*(b + a for b, a in path + more)), now, now == root))
    return sorted(out, key=str)


def made(n, langs, seed=0):
    rng = random.Random(seed)
    return [(k * 3 - 5, rng.choice(["web", None, "é|1"]), langs[k % len(langs)], rng.choice([None, k]), rng.choice([None, "", f"Text {k} Ü", "same"]), 1, 2) for k in range(n)]


@pytest.mark.parametrize("rows", [made(1, ["en"]), made(9, ["en"]), made(64, ["en"]), made(65, ["en", None]), made(1100, ["en", "en", "en", "fr", "", None, "é"]), made(40, [f"l{k}" for k in range(20)]), made(513, ["en"]) + [(7, "a", "de", 1, "X", 1, 2)] * 20 + [(None, None, None, None, None, None, None)] * 3 + [(None, "s", "en", 1, "Y", 1, 1)]])
def test_against_brute_force(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op11_merkle(spark, str(tmp_path))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, out.collect()), key=str) == brute_force(rows)


def test_empty_table_and_long_text(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/e/documents.parquet")
    assert queries.op11_merkle(spark, f"{tmp_path}/e").collect() == []
    rows = [(1, "s", "en", 5, "long Text " * 300_000, 1, 1), (2, "s", "en", 5, "LONG " * 10, 1, 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/l/documents.parquet")
    assert sorted(map(tuple, queries.op11_merkle(spark, f"{tmp_path}/l").collect()), key=str) == brute_force(rows)


def test_only_every_third_level_is_stored(spark):
    rows = spark.range(5000).select(F.col("id").alias("k"))
    made = merkle.build(rows, merkle.leaf(F.col("k")), F.lit("x"), [F.col("k")], F.struct("k"))
    assert [level.count() for level in made.levels] == [5000, 10, 1]
    proof = made.proofs().where("row.k = 4999").first()
    assert [len(s.before + s.after) // 64 for s in proof.proof] == [7, 0, 6, 1, 1] and proof.pos == 4999
    checked = made.proofs().where(merkle.fold(F.col("digest"), F.col("proof")) != made.root().first().root)
    assert checked.count() == 0
