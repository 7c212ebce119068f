"""Columns of any name stay as they are beside the results of every operator; roles and texts of a megabyte are whole."""

import pytest
from pyspark.sql import functions as F

from flowspark.llm import chat_format, decontaminate, html_extract, pii, quality_rules, sentencepiece_codec, substring_dedup, token_counts, url_filter
from flowspark.llm.queries import URL_RULES

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["_key", "_digest", "_says", "_trust", "_distrust", "_head", "_body", "_learn", "_found", "_runs", "key", "g", "ord", "digest", "words", "a.b", "a`b", "c0", "c1", "i", "head", "host_", "says"]
TEXTS = ["A text, with some words in it; and more of them, so that it is one.", "", None, "x\\y <b> # one two three"]


def rows(spark, extra):
    """Four rows of ``extra`` and the odd columns, each value its own."""
    names = [c.split()[0] for c in extra]
    made = [tuple({"id": k, "conv_id": 1, "turn": k, "role": ["user", "assistant"][k % 2], "text": t, "url": "http://a.com/x", "html": f"<p>{t}</p>" if t else t}[c] for c in names) + tuple(f"{c} {k}" for c in ODD) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(made, ", ".join([*extra, *(f"`{c.replace('`', '``')}` string" for c in ODD)]))


OPERATORS = {
    "quality_rules": lambda spark, d, tmp: quality_rules.quality_rules(d),
    "token_counts": lambda spark, d, tmp: token_counts.token_counts(d, MODEL, f"{tmp}/cache"),
    "encode": lambda spark, d, tmp: sentencepiece_codec.encode(d, MODEL, decoded_col="said"),
    "decode": lambda spark, d, tmp: sentencepiece_codec.decode(sentencepiece_codec.encode(d, MODEL), MODEL),
    "url_filter": lambda spark, d, tmp: url_filter.url_filter(d, URL_RULES),
    "html_extract": lambda spark, d, tmp: html_extract.extract(d, text_col="main"),
    "decontaminate": lambda spark, d, tmp: decontaminate.decontaminate(d, spark.createDataFrame([(1, "one two three")], "item_id long, text string")),
    "substring_dedup": lambda spark, d, tmp: substring_dedup.substring_dedup(d, "id"),
    "chat_format": lambda spark, d, tmp: chat_format.format_turns(d),
    "pii": lambda spark, d, tmp: pii.find_pii(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_columns_stay(spark, tmp_path, name):
    docs = rows(spark, ["id long", "conv_id long", "turn long", "role string", "text string", "url string", "html string"])
    out = OPERATORS[name](spark, docs, tmp_path)
    assert [c for c in out.columns if c in ODD] == ODD
    quoted = ["`id`", *(f"`{c.replace('`', '``')}`" for c in ODD)]
    assert sorted(map(tuple, out.select(*quoted).collect())) == sorted(map(tuple, docs.select(*quoted).collect()))


def test_blocks_of_a_benchmark_keep_odd_columns(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 5)
    docs = rows(spark, ["id long", "text string"])
    out = decontaminate.decontaminate(docs, spark.createDataFrame([(1, "one two three"), (2, "some words in it and more"), (3, "x y")], "item_id long, text string"))
    assert {r["id"]: r["_found"] for r in out.collect()} == {k: f"_found {k}" for k in range(4)}
    assert {r["id"]: len(r["items"]) for r in out.collect()} == {0: 1, 1: 0, 2: 0, 3: 2}


def test_clashing_results_are_replaced(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", "u", "v", "w")], "id long, text string, n_bytes string, n_tokens string, `rule` string")
    out = token_counts.token_counts(docs, MODEL, f"{tmp_path}/c")
    assert out.columns == ["id", "text", "rule", "n_bytes", "n_tokens"] and out.first()["n_bytes"] == 3 and out.first()["rule"] == "w"


def test_roles_and_texts_of_a_megabyte(spark, tmp_path):
    big = "x\\y#<: " * 150_000
    turns = spark.createDataFrame([(1, 0, big, "short"), (1, 1, "assistant", big), (1, 2, "\\" * 100_001 + ":" * 100_000, "")], "conv_id long, turn long, role string, text string")
    role, text = chat_format.read_back(F.col("formatted"))
    for r in chat_format.format_turns(turns).select("role", "text", role.alias("r"), text.alias("t")).collect():
        assert (r.r, r.t) == (r.role, r.text)
    docs = spark.createDataFrame([(1, big), (2, "word " * 200_000)], "id long, text string")
    counts = token_counts.token_counts(docs, MODEL, f"{tmp_path}/c").collect()
    assert {r.id: r.n_bytes for r in counts} == {1: len(big), 2: 1_000_000} and all(r.n_tokens > 100_000 for r in counts)


def test_a_run_writes_only_the_counts_it_asks_for(spark, tmp_path, monkeypatch):
    written = {}
    materialize = token_counts.materialize

    def seen(df, name):
        out = materialize(df, name)
        written.setdefault(name, []).append(out.count())
        return out

    many = spark.createDataFrame([(k, f"text {k}") for k in range(300)], "id long, text string")
    token_counts.token_counts(many, MODEL, f"{tmp_path}/c").collect()
    monkeypatch.setattr(token_counts, "materialize", seen)
    few = spark.createDataFrame([(1, "text 7"), (2, "text 7"), (3, "text 8"), (4, "new")], "id long, text string")
    assert token_counts.token_counts(few, MODEL, f"{tmp_path}/c").count() == 4
    assert written == {"token-digests": [3], "token-counts": [2, 3], "token-misses": [1]}
    assert spark.read.parquet(f"{tmp_path}/c").count() == 301


def test_an_automaton_is_built_once_a_worker():
    class Shipped:
        value = [("a", "one two")]

    first = decontaminate.built("x", Shipped)
    assert decontaminate.built("x", Shipped) is first and decontaminate.built("y", Shipped) is not first
