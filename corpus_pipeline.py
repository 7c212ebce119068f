"""From raw documents to token ids in five stages, each over all that the one before kept.

Every stage takes and gives the columns of documents (the last adds its own), whatever further columns they have;
columns named like an operator's own are kept as they are.  Defined cases, the same in all stages: a null, empty or
wordless text fails the base rules of the first stage and goes there; where a stage is given one, it stays as it is, has no passages,
no windows and no ids.  Null and repeated ids are ordinary rows: rows are told apart by id and text, and of equal
rows one stays in the second stage; a null id sorts after all others.  Texts of any length are whole.  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.llm import decontaminate, jaccard_join, quality_rules, sentencepiece_codec, substring_dedup
from flowspark.llm.common import materialize
from flowspark.llm.queries import piece_model, table


def _packed(docs: DataFrame) -> DataFrame:
    """Id, text and all other columns in one, so that none clashes with an operator's."""
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"))


def _unpacked(out: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` of documents with the text in ``text``, ``n_chars`` counted anew."""
    own = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return out.select(*(own.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that fail the base rules or lose too much."""
    return _unpacked(quality_rules.quality_rules(_packed(docs)).where("kept"), docs.columns, "cleaned")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one row stays: the smallest id, nulls last, then the smallest text digest."""
    kept = materialize(jaccard_join.one_of_each(docs), "pipeline-kept").toDF("_kept", "_digest", "_n")
    same = docs["doc_id"].eqNullSafe(kept["_kept"]) & (jaccard_join.text_digest("text") == kept["_digest"])
    out = docs.join(kept.drop("_n"), same, "left_semi")
    if not kept.where("_n > 1").isEmpty():  # a row given twice: of equal rows one stays
        out = out.dropDuplicates(["doc_id", "text"])
    return out.select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that start in an earlier document go, and documents of which nothing is left."""
    out = substring_dedup.substring_dedup(_packed(docs))
    return _unpacked(out.where("n_removed < n_words or n_words = 0"), docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover a twentieth or more go."""
    out = decontaminate.decontaminate(_packed(docs), table(spark, sf_dir, "benchmark"))
    return _unpacked(out.where("not contaminated"), docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their ids and number of ids (``token_ids``, ``n_tokens``); a null text has none, so 0."""
    out = sentencepiece_codec.encode(docs, piece_model())
    return out.withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_free),
    ("SentencePiece encoding", token_ids),
]
#: Similarity classes and token ids cannot be put into SQL: tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents of ``sf_dir``, each written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
