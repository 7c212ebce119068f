import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from flowspark.llm import sharding
from flowspark.llm.queries import QUERIES, piece_model

from .helpers import awkward, components, hits, without_repeats

pytest.importorskip("public_tokenizers")


def test_pipeline_against_brute_force(spark, tmp_path):
    import sentencepiece

    rows = [(i, t and t.strip() and t.replace("\n", " ") + ".", "en", "s", len(t or "")) for i, t, *_ in awkward(3) if i is not None]
    extra = " ".join(f"q{k}" for k in range(80))
    rows += [(5000 + k, f"{extra}{'x' * k}.", "en", "s", 0) for k in range(3)]
    words = next(t for _, t, *_ in rows if t and len(t) > 5000).split()
    bench = [(1, " ".join(f"w{k} v" for k in range(30))), (2, " ".join(words[5:60]))]
    rows.append((6000, " ".join(words[5:60]) + " and more words than fifty in all so that nothing else fails.", "en", "s", 0))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    from .helpers import base_rules

    kept = {(i, t) for i, t, *_ in rows if not base_rules(t)[5]}
    docs = sorted(kept)
    same = {i: c for i, _, c in components(docs)}
    docs = [(i, t) for i, t in docs if same[i] == i]
    clean = {i: (n, gone, text) for i, n, gone, text in without_repeats(docs)}
    docs = [(i, clean[i][2]) for i, _ in docs if clean[i][1] < clean[i][0]]
    docs = [(i, t) for i, t in docs if not hits(t, bench)[4]]
    assert {i: " ".join(r.text.split()) for i, r in got.items()} == dict(docs)
    model = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    for r in got.values():
        assert list(r.token_ids) == model.encode(r.text) and r.n_tokens == len(r.token_ids) and r.n_chars == len(r.text)


def test_one_row_of_each_group_stays_with_null_and_repeated_ids(spark):
    """Rows of no id are groups of their own, and an id does not keep what another text of it won."""
    a, b, c, d, e = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcde")
    rows = [(None, a), (None, a + " more"), (None, b), (1, b + " more"), (None, None), (None, "")]
    rows += [(7, c), (7, d), (3, d + " more"), (7, e), (7, e + " more"), (7, c), (None, a)]
    rows = [(i, t, "en", "s", 0) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert len(got) == len(set(got))
    starts = sorted(((i, (t or "")[:1]) for i, t in got), key=str)
    assert starts == sorted([(None, "a"), (1, "b"), (None, ""), (None, ""), (7, "c"), (3, "d"), (7, "e")], key=str)


def test_stages_keep_columns_and_take_nothing(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], schema)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns + (["token_ids", "n_tokens"] if k == 4 else []) and out.collect() == []


def test_stages_take_odd_rows(spark, tmp_path):
    """Null and repeated ids and texts, wordless texts and clashing columns go through every stage alone."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, items string, digest long, c0 int"
    spark.createDataFrame([(1, "one two three"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i, t, None, "s", len(t or ""), "k", 7, 3) for i in (None, 1, 1, 2) for t in (None, "", " \n ", "a b c", "w " * 3000)]
    docs = spark.createDataFrame(rows, schema)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        got = out.collect()
        assert out.columns[:8] == docs.columns and all(r.items == "k" and r.digest == 7 and r.c0 == 3 for r in got)
        if k in (2, 3, 4):  # of these rows nothing goes but repeated words
            assert len(got) == (len(rows) - 2 if k == 2 else len(rows))
        if k == 4:
            assert all(r.n_tokens == len(r.token_ids) and (r.n_tokens == 0) == (not (r.text or "")) for r in got)


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_sharded_table(spark, tmp_path):
    table = sharding.ShardedTable(spark, str(tmp_path / "t"), F.octet_length("text"), target=40_000, fan=3)
    with pytest.raises(ValueError):
        table.read()
    rows = spark.createDataFrame([(k, "x" * 100, "hot", k) for k in range(300)] + [(None, None, None, None), (5, "x" * 100, "hot", 5)], "id long, text string, source string, shard long")
    assert table.append(rows.limit(0)) == 1 and table.manifest().count() == 0
    assert table.read().columns == rows.columns and table.read().collect() == []
    for k in range(3):
        table.append(rows.where(F.pmod("id", F.lit(3)).eqNullSafe(F.lit(k))).coalesce(2).select("shard", "text", "id", "source"))
    table.append(rows.where("id is null"))
    before = table.manifest().collect()
    assert sum(r.n_rows for r in before) == 302 and max(r.n_bytes for r in before) < 20_000
    version = table.compact()
    after = table.manifest().collect()
    assert len(after) < len(before) and sum(r.n_rows for r in after) == 302
    assert rows_of(table.read()) == rows_of(rows) == rows_of(table.read(version - 1)) == rows_of(table.placed().drop("place"))
    assert table.versions()[-1] == version
    assert table.vacuum(keep=1) == 0 < table.vacuum(keep=1, older_than=0) and rows_of(table.read()) == rows_of(rows)
    with pytest.raises(ValueError):
        table.append(rows.drop("shard"))


def test_shards_are_even_for_one_key(spark, tmp_path):
    table = sharding.ShardedTable(spark, str(tmp_path / "t"), F.octet_length("text"), target=10_000, fan=2)
    for _ in range(4):
        table.append(spark.range(100).select(F.lit(None).cast("long").alias("id"), F.repeat(F.lit("x"), 100).alias("text")).coalesce(1))
    table.compact()
    sizes = [r.n_rows for r in table.manifest().collect()]
    assert len(sizes) == 4 and sum(sizes) == 400 and max(sizes) < 160


def test_one_of_two_writers_commits(spark, tmp_path, monkeypatch):
    """Both pass all checks before either commits: one wins, the other gets Conflict, and nothing is lost."""
    make = lambda: sharding.ShardedTable(spark, str(tmp_path / "t"), F.octet_length("text"))
    rows = spark.createDataFrame([(k, "y") for k in range(60)], "id long, text string")
    one, other = make(), make()
    one.append(rows.where("id < 20"))
    publish = sharding.ShardedTable._publish

    def late(self, aside, to):
        monkeypatch.setattr(sharding.ShardedTable, "_publish", publish)
        assert other.append(rows.where("id >= 40")) == 2
        return publish(self, aside, to)

    monkeypatch.setattr(sharding.ShardedTable, "_publish", late)
    with pytest.raises(sharding.Conflict):
        one.append(rows.where("id between 20 and 39"))
    assert one.versions() == [1, 2] and one.read().count() == 40
    assert one.append(rows.where("id between 20 and 39")) == 3 and rows_of(other.read()) == rows_of(rows)


def test_vacuum_spares_what_is_being_written(spark, tmp_path, monkeypatch):
    table = sharding.ShardedTable(spark, str(tmp_path / "t"), F.octet_length("text"))
    rows = spark.createDataFrame([(k, "y") for k in range(60)], "id long, text string")
    table.append(rows.where("id < 20"))
    write = sharding.ShardedTable._write
    monkeypatch.setattr(sharding.ShardedTable, "_write", lambda self, *a: (write(self, *a), self.vacuum(keep=1))[0])
    table.append(rows.where("id >= 20"))
    assert rows_of(table.read()) == rows_of(rows)
    monkeypatch.setattr(sharding.ShardedTable, "_write", lambda self, *a: (self.spark.createDataFrame(write(self, *a).collect(), sharding.MANIFEST), self.vacuum(keep=1, older_than=-60))[0])
    with pytest.raises(sharding.Conflict):  # an age that spares nothing takes the files: the commit is refused
        table.append(rows)
    monkeypatch.undo()
    assert rows_of(table.read()) == rows_of(rows)


def test_sharding_query_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, run string, shard long, place long").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["op6_sharding"](spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", ["op6_sharding"])
def test_every_document_is_in_one_shard(spark, name):
    out = QUERIES[name](spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert out.count() == docs.count() == out.join(docs, "doc_id").count()
    assert out.groupBy("added", "shard").agg(F.sum("n_bytes").alias("b"), F.first("shard_bytes").alias("s")).where("b <> s").count() == 0


def test_dead_shards_of_a_living_run_go(spark, tmp_path):
    """A compaction that takes some shards of a run: the others stay, what it took is vacuumed, and only live folders are read."""
    import os

    table = sharding.ShardedTable(spark, str(tmp_path / "t"), F.octet_length("text"), target=40_000, fan=3)
    small, large = [(k, "x" * 50) for k in range(3)], [(9, "y" * 30_000)]
    table.append(spark.createDataFrame(small + large, "id long, text string").repartitionByRange(4, "id"))
    run = table.manifest().first().run
    table.compact()
    before = {s.shard for s in table.manifest().where(F.col("run") == run).collect()}
    assert len(before) == 1 and table.vacuum(keep=1, older_than=0) >= 3
    left = {d for d in os.listdir(tmp_path / "t" / "data" / f"run={run}") if d.startswith("shard=")}
    assert left == {f"shard={k}" for k in before}
    assert sorted((r.id, len(r.text)) for r in table.read().collect()) == [(0, 50), (1, 50), (2, 50), (9, 30_000)]
