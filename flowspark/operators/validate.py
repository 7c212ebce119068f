"""Validation of flow tables: the header, the column set, then all row rules in one pass."""

from __future__ import annotations

import csv

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite

# Names of label columns that a flow file may carry and that are dropped.
LABELS = ("Label", "attack_cat", "label")
#: Accepts one- and two-digit days and hours, as C's strptime does.
TIMESTAMP = "d/M/yyyy h:mm:ss a"


class InvalidInput(ValueError):
    """The input breaks the contract; nothing of it is used."""


@dataclass(frozen=True)
class Contract:
    """Names that a flow table must have, may have, and must not bring along."""

    endpoints: tuple[str, ...] = ("Src IP", "Dst IP")
    ports: tuple[str, ...] = ("Src Port", "Dst Port")
    protocol: str = "Protocol"
    timestamp: str = "Timestamp"
    numeric: tuple[str, ...] = ()
    optional: tuple[str, ...] = ("Flow ID",)
    derived: tuple[str, ...] = field(default=("flow_bytes", "flow_packets"))

    @property
    def required(self) -> tuple[str, ...]:
        return (*self.endpoints, *self.ports, self.protocol, self.timestamp, *self.numeric)


def check_header(line: str | None) -> list[str]:
    """Names of a raw CSV header; empty files, empty and repeated names are refused."""
    if line is None or not line.strip("﻿ \r\n"):
        raise InvalidInput("the file is empty")
    names = next(csv.reader([line.lstrip("﻿").rstrip("\r\n")]))
    if any(not n.strip() for n in names):
        raise InvalidInput("a column has no name")
    if repeated := sorted({n for n in names if names.count(n) > 1}):
        raise InvalidInput(f"repeated columns: {', '.join(repeated)}")
    return names


def check_columns(columns: list[str], contract: Contract) -> list[str]:
    """Label columns found; derived names, all missing names at once, and strangers are refused."""
    if taken := [c for c in columns if c in contract.derived]:
        raise InvalidInput(f"derived columns in the input: {', '.join(taken)}")
    if missing := [c for c in contract.required if c not in columns]:
        raise InvalidInput(f"missing columns: {', '.join(missing)}")
    if strange := [c for c in columns if c not in (*contract.required, *contract.optional, *LABELS)]:
        raise InvalidInput(f"unexpected columns: {', '.join(strange)}")
    return [c for c in columns if c in LABELS]


def row_rules(contract: Contract) -> dict[str, Column]:
    """Name of each rule and the condition that breaks it, over text columns."""
    c = lambda name: F.col(f"`{name}`")
    number = lambda name: F.expr(f"try_cast(trim(`{name}`) as double)")
    whole = lambda name, most: ~F.coalesce((number(name) == F.floor(number(name))) & number(name).between(0, most), F.lit(False))
    rules = {f"timestamp:{contract.timestamp}": F.try_to_timestamp(c(contract.timestamp), F.lit(TIMESTAMP)).isNull()}
    rules |= {f"blank:{n}": F.coalesce(F.trim(c(n)), F.lit("")) == "" for n in contract.endpoints}
    rules |= {f"port:{n}": whole(n, 65535) for n in contract.ports} | {f"protocol:{contract.protocol}": whole(contract.protocol, 255)}
    return rules | {f"number:{n}": ~F.coalesce(finite(number(n)), F.lit(False)) for n in contract.numeric}


def with_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``df`` with the names of the rules each row breaks: one pass for all rules."""
    return df.withColumn("violations", F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items()))))


def report(checked: DataFrame, row_id: str, most: int = 20) -> DataFrame:
    """Per broken rule: how many rows and the first few ids."""
    broken = checked.select(row_id, F.explode("violations").alias("rule"))
    # the smallest ids alone, so a rule that every row breaks gathers no list of all
    from pyspark.sql import Window

    first = broken.withColumn("_r", F.row_number().over(Window.partitionBy("rule").orderBy(row_id))).where(F.col("_r") <= most)
    return broken.groupBy("rule").count().join(first.groupBy("rule").agg(F.sort_array(F.collect_list(row_id)).alias("rows")), "rule")


def validate(df: DataFrame, contract: Contract) -> DataFrame:
    """Typed rows of a valid table (all text columns); otherwise `InvalidInput`."""
    labels = check_columns(df.columns, contract)
    checked = with_violations(df, row_rules(contract))
    bad = checked.where(F.size("violations") > 0).limit(20).collect()
    if bad:
        raise InvalidInput("; ".join(sorted({v for r in bad for v in r.violations})))
    types = {contract.timestamp: F.try_to_timestamp(F.col(f"`{contract.timestamp}`"), F.lit(TIMESTAMP)).cast("timestamp_ntz")}
    types |= {n: F.col(f"`{n}`").cast("double").cast("long") for n in (*contract.ports, contract.protocol)}
    types |= {n: F.col(f"`{n}`").cast("double") for n in contract.numeric}
    return df.drop(*labels).select(*(types.get(n, F.col(f"`{n}`")).alias(n) for n in df.columns if n not in labels))
