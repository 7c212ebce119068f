"""Tables between the steps of an operator."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folder of this process where the session names none, as in tests.
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder that all machines of the session see: ``spark.checkpoint.dir``, or a temporary one on a single machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or _own.get("dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        root = _own["dir"] = tempfile.mkdtemp(prefix="flowspark-")
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of the shared folder: what is read from it is not computed again, and a lost executor costs a read."""
    path = f"{shared_folder(df.sparkSession)}/flowspark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Counted rows up to which a table is broadcast.
SMALL = 500_000


def if_small(df: DataFrame, rows: int, limit: int = SMALL) -> DataFrame:
    """``df`` broadcast if its counted ``rows`` are at most ``limit``; beyond that the join shuffles."""
    return F.broadcast(df) if rows <= limit else df


#: Rows that one task is to sort where tables are dealt by `dealt`.
ROWS = 200_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in partitions of about `ROWS` of its counted ``rows``, so that a task does not grow with the table; few rows are left to the
    session's number."""
    return df.repartition(*keys) if rows <= 10 * ROWS else df.repartition(-(-rows // ROWS), *keys)
