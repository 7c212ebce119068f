"""Compare registered queries with their SQL: python -m tests.compare SF_DIR [NAME...]"""

import math
import sys
import time
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, Decimal):
        return round(float(x), 9)
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    if hasattr(x, "asDict"):
        return {k: plain(v) for k, v in x.asDict().items()}
    return {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr([plain(r[i]) for i in order]) for r in data)


def oracle(sf_dir, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    kinds = {d[0]: str(d[1]) for d in got.description}
    return [d[0] for d in got.description], got.fetchall(), kinds


def differ(spark, sf_dir, query, sql):
    """What differs between the query's rows and the SQL's, or an empty text."""
    df = query(spark, sf_dir)
    a_columns, a = rows(df.columns, df.collect())
    names, data, kinds = oracle(sf_dir, sql)
    b_columns, b = rows(names, data)
    if a_columns != b_columns:
        return f"columns {a_columns} {b_columns}"
    odd = {k: (t, kinds[k]) for k, t in df.dtypes if {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}.get(t, kinds[k]) != kinds[k]}
    if odd:
        return f"types {odd}"
    if a != b:
        sa, sb = set(a), set(b)
        only = [x for x in a if x not in sb][:2], [x for x in b if x not in sa][:2]
        return f"rows {len(a)} {len(b)}: {only}"
    return ""


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", "/tmp/compare").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    sql = entry.oracle_sql()
    for name, query in entry.queries().items():
        if len(sys.argv) > 2 and not any(name.startswith(p) for p in sys.argv[2:]):
            continue
        began = time.time()
        try:
            said = differ(spark, sys.argv[1], query, sql[name]) if name in sql else f"no sql, {query(spark, sys.argv[1]).count()} rows"
        except Exception as e:
            said = f"ERROR {str(e)[:600]}"
        print(f"{name} {time.time() - began:.1f}s {said[:900] or 'ok'}", flush=True)
