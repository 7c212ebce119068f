import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowspark.llm import hard_negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int, id string, x string"


def brute_force(rows, every=50, scale=256):
    """(anchor, positive, rank, negative, positive score, negative score) by scoring all pairs."""
    kept = {}
    for vec_id, vector, label, *_ in rows:
        if vec_id is None or label is None or vector is None or any(v is None or not math.isfinite(v) for v in vector):
            continue
        kept[vec_id] = ((label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(scale * float(np.float32(v))) for v in vector])
    out = []
    for a, (label, x) in kept.items():
        if a % every:
            continue
        scores = sorted((-sum(p * q for p, q in zip(x, y)), i) for i, (_, y) in kept.items() if i != a)
        for minus, i in [s for s in scores if kept[s[1]][0] == label][:5]:
            good = [(o, -s) for s, o in scores if kept[o][0] != label and -50 * minus <= -100 * s <= -95 * minus]
            out += [(a, i, r + 1, o, -minus, s) for r, (o, s) in enumerate(good[:3])]
    return sorted(out)


def vectors(n, dim, seed, groups=12, spread=0.4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    return (centres[rng.integers(groups, size=n)] + spread * rng.normal(size=(n, dim))).astype(np.float32)


def run(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = queries.op13_hard_negatives(spark, str(tmp_path))
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, out.collect()))


def test_against_all_pairs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 7)
    monkeypatch.setattr(hard_negatives, "ROUND_BYTES", 3000)  # several rounds
    rng = random.Random(1)
    rows = [(k, v.tolist(), rng.randrange(10), "i", "x") for k, v in enumerate(vectors(1500, 12, 3))]
    rows += [(2000 + k, rows[k % 3][1], rng.randrange(3), "t", None) for k in range(200)]  # ties
    rows += [(3000, None, 1, "", ""), (3050, [], 1, "", ""), (3100, [1.0, None], 1, "", ""), (3150, [float("nan")] * 12, 2, "", ""), (3200, [float("inf")] * 12, 2, "", ""), (3250, [0.5, 0.25], 4, "", ""), (3300, [0.0] * 12, 4, "", ""), (None, [1.0] * 12, 1, "", ""), (3350, [1.0] * 12, None, "", "")]
    want = brute_force(rows)
    assert run(spark, tmp_path, rows) == want and len(want) > 150


def test_defined_cases(spark, tmp_path):
    assert run(spark, tmp_path / "a", [(50, [1.0], 1, "", "")]) == []
    assert run(spark, tmp_path / "b", []) == []
    twice = [(50, [1.0, 0.0], 1, "", ""), (50, [1.0, 0.0], 1, "", ""), (51, [1.0, 0.0], 1, "", ""), (52, [0.75, 0.0], 2, "", ""), (52, [0.75, 0.0], 2, "", ""), (53, [0.75, 9.0], 3, "", ""), (54, [-1.0, 0.0], 2, "", "")]
    assert run(spark, tmp_path / "c", twice) == [(50, 51, 1, 52, 65536, 49152), (50, 51, 2, 53, 65536, 49152)]
    big = [(50, [3e5, 1.0], 1, "", ""), (51, [2.9e5, 1.0], 1, "", ""), (52, [2e5, 3.0], 2, "", ""), (53, [2e5, 1.0], 2, "", "")]
    assert run(spark, tmp_path / "d", big) == brute_force(big)  # scores beyond what doubles hold exactly
    with pytest.raises(Exception, match="do not fit a long"):
        run(spark, tmp_path / "e", [(50, [1e15], 1, "", ""), (51, [1e15], 1, "", "")])


def test_bounds_hold_and_spare_work():
    """Bounds from the tree hold the exact scores, and near groups are mostly not scored."""
    x = np.floor(256 * vectors(4000, 16, 5, groups=6, spread=0.05)).astype(np.int64)
    order, parents, lengths = hard_negatives.spanning_tree(x[:100])
    assert sorted(order) == list(range(100)) and parents[0] == -1 and all(p < k for k, p in enumerate(parents))
    block = hard_negatives.Block({"ids": np.arange(100).tobytes(), "labels": np.zeros(100, np.int64).tobytes(), "width": 16, "x": x[:100][order].tobytes(), "parents": parents.tobytes(), "lengths": lengths.tobytes()})
    exact = x @ x[:100][order].T
    scored = 0

    def wanted(k, low, high):
        assert (low <= exact[:, k]).all() and (exact[:, k] <= high).all()
        return high >= np.sort(exact[:, k])[-5]

    for k, rows, scores in block.scores(x, wanted):
        assert (scores == exact[rows, k]).all() and set(np.argsort(-exact[:, k], kind="stable")[:5]) <= set(np.flatnonzero(exact[:, k] >= np.sort(exact[:, k])[-5]))
        assert set(np.flatnonzero(exact[:, k] >= np.sort(exact[:, k])[-5])) <= set(rows)
        scored += len(rows)
    assert scored < 0.5 * exact.size


def test_label_rule(spark):
    rows = spark.createDataFrame([(7, 9), (8, 9)], "vec_id long, label int")
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    assert [r[0] for r in rows.select(label).collect()] == [0, 9]
