"""Chat formatting with typed content parts.

A turn's content is either a text or an ordered list of parts ``struct<type, text, ref, tokens>``
of type text, image, audio or document.  A visitor walks the parts: text is escaped, any other
part becomes an ordered placeholder ``<image 2>`` and is recorded as an attachment (type, ref,
number within the turn, tokens it expands to: the part's own count or the type's default).
A turn reads ``### role: text</turn>\\n``.  Control strings inside texts cannot be mistaken for the
template's: ``\\``, ``<`` and ``#`` (in roles also ``:``) get a backslash, which `unescape` takes off again.
All of this is built from column functions, one row a turn, so a conversation of any length is
formatted in parallel; its text is the concatenation of its rows by turn.  Only a digest of a
whole conversation, which no function can compute in pieces, reads its rows in order, and does so
as a stream (`running_digests`), never holding a conversation in memory.

Defined cases: null text is empty, a null role too, null parts or a null part add nothing, a part of null
type is a text or else of type unknown; rows
of one turn are ordered by role and text; repeated rows all stay; a null conversation id is one
conversation; an empty table gives no rows; roles and texts of any length are whole.  Columns of the turns that are named like a result are
replaced, all others stay, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import numbered, restored

#: Tokens that a part stands for where it does not say.
EXPANDED = {"image": 256, "audio": 128, "document": 512}
END = "</turn>\n"
NEW = ("formatted", "loss_start", "loss_end", "attachments", "expanded_tokens")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<#])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _visit(parts: Column) -> tuple[Column, Column]:
    """Text with placeholders, and attachments, of a list of parts."""
    parts = F.filter(F.coalesce(parts, F.array()), lambda p: p.isNotNull())
    # a part of no type is a text, unless only a ref or a count of tokens says that it is something
    untyped = lambda p: F.when(p["text"].isNull() & (p["ref"].isNotNull() | p["tokens"].isNotNull()), "unknown").otherwise("text")
    parts = F.transform(parts, lambda p: F.struct(F.coalesce(p["type"], untyped(p)).alias("type"), p["text"].alias("text"), p["ref"].alias("ref"), p["tokens"].alias("tokens")))
    other = F.filter(parts, lambda p: p["type"] != "text")
    tokens = lambda p: F.coalesce(p["tokens"].cast("long"), *(F.when(p["type"] == k, v) for k, v in EXPANDED.items()), F.lit(0))
    attachments = F.transform(other, lambda p, i: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), (i + 1).alias("number"), tokens(p).cast("long").alias("tokens")))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"))
    placeholder = lambda acc, p: F.concat(F.lit("<"), p["type"], F.lit(" "), (acc["n"] + 1).cast("string"), F.lit(">"))
    step = lambda acc, p: F.struct(
        F.concat(acc["text"], F.when(p["type"] == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(placeholder(acc, p))).alias("text"),
        (acc["n"] + (p["type"] != "text").cast("int")).alias("n"),
    )
    return F.aggregate(parts, start, step)["text"], attachments


def format_turns(turns: DataFrame, role_col: str = "role", text_col: str = "text", parts_col: str | None = None, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``turns`` with formatted, loss_start, loss_end (code points of formatted; equal: no loss),
    attachments and expanded_tokens."""
    work, column, kept = numbered(turns, NEW)
    role = F.coalesce(F.col(column(role_col)).cast("string"), F.lit(""))
    if parts_col:
        body, attachments = _visit(F.col(column(parts_col)))
    else:
        body = escape(F.coalesce(F.col(column(text_col)).cast("string"), F.lit("")))
        attachments = F.array().cast("array<struct<type:string,ref:string,number:int,tokens:bigint>>")
    head = F.concat(F.lit("### "), F.regexp_replace(role, r"([\\<#:])", r"\\$1"), F.lit(": "))
    out = work.withColumns({"head": head, "body": body, "attachments": attachments, "learn": role.isin(*learn)})
    start = F.length("head")
    out = out.withColumns(
        {
            "formatted": F.concat("head", "body", F.lit(END)),
            "loss_start": start,
            "loss_end": F.when(F.col("learn"), start + F.length("body")).otherwise(start),
            "expanded_tokens": F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]),
        }
    )
    return restored(out, kept, NEW)


def read_back(formatted: Column) -> tuple[Column, Column]:
    """Role and text of a formatted turn."""
    # possessive: nothing is tried again, and no step of a long role stays on the stack
    shape = r"(?s)^### ([^\\:]*+(?:\\.[^\\:]*+)*+): (.*)</turn>\n$"
    return unescape(F.regexp_extract(formatted, shape, 1)), unescape(F.regexp_extract(formatted, shape, 2))


def running_digests(rows: DataFrame, key: str, order: list[str], pieces: list[str]) -> DataFrame:
    """(key, sha256 of each column of ``pieces`` over the key's rows in order), in constant memory; a key is of any
    type, a null key is one key, a null piece adds nothing."""
    n, kind = len(pieces), rows.schema[key].dataType
    shape = T.StructType([T.StructField(key, kind), *(T.StructField(p, T.StringType()) for p in pieces)])
    schema = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, None
        made = lambda done: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)
        for batch in batches:
            keys, done = batch.column(0).to_pylist(), []
            columns = [c.to_pylist() for c in batch.columns[1:]]
            for i, k in enumerate(keys):
                if sums is None or k != now:
                    if sums is not None:
                        done.append((now, *(x.hexdigest() for x in sums)))
                    now, sums = k, [hashlib.sha256() for _ in range(n)]
                for x, c in zip(sums, columns, strict=True):
                    x.update((c[i] or "").encode())
            if done:
                yield made(done)
        if sums is not None:
            yield made([(now, *(x.hexdigest() for x in sums))])

    dealt = rows.repartition(key).sortWithinPartitions(key, *order).select(key, *pieces)
    return dealt.mapInArrow(run, shape)
