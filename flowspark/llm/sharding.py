"""Sharding by size-tiered compaction.

A sharded table is a folder of immutable Parquet shards and versioned manifests.  Arrivals are
appended as small shards; a compaction takes, tier by tier (a tier spans a factor of ``fan`` in
bytes), every set of ``fan`` or more shards of one tier and rewrites it as shards of about the
target size.  A manifest is a small Parquet table with one row a shard.  A version is a small file that
names its manifest and the table's columns; it is written aside and then put under its number in one atomic step
that fails if that number exists.  That step is the commit: of two writers of one version one gets
`Conflict`, and readers see the old version or the new one, never half of one.

No commit changes or removes a data file.  Readers open the folders of live shards only.  `vacuum` drops, shard by shard, what no manifest of the last versions names
and has not been touched for ``older_than`` seconds: an arrival or compaction that is being written is younger, so it must
be longer than any write takes (0 only for the only writer).  A commit whose files are gone all the same is refused.

An arrival is written as it is dealt to tasks, a shard each, without a shuffle.  A compaction deals
rows by their place (file and row number) modulo the shards wanted: shards are even whatever source, key or
group of copies a row belongs to, and a task that runs twice deals alike; one shuffle by shard writes
each as one file.  Shards of half the target or more are left alone.  Column functions
only; the driver handles names and counts of shards, never rows.

Defined cases: null texts are ordinary rows of 0 bytes; repeated rows all stay; an empty
arrival commits a version without a new shard; a table without rows reads as no rows of its columns; a table
without a version has no columns and is refused.  Columns may have any names: files hold them by number.
All arrivals have the first one's columns and types, in any order.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


MANIFEST = "run string, shard int, tier int, n_rows long, n_bytes long, added long"
MANIFEST_COLUMNS = [c.split()[0] for c in MANIFEST.split(", ")]
DAY = 86_400


class Conflict(RuntimeError):
    """Another writer has committed this version, or has removed this one's files."""


class ShardedTable:
    def __init__(self, spark: SparkSession, path: str, size: Column, target: int = 128 << 20, fan: int = 4):
        """``size``: bytes of a row, by its columns; ``target``: bytes of a full shard."""
        self.spark, self.path, self.size, self.target, self.fan = spark, path.rstrip("/"), F.coalesce(size, F.lit(0)).cast("long"), target, fan
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- versions

    def _list(self, folder: str) -> list:
        at = self._path(f"{self.path}/{folder}")
        return list(self._fs.listStatus(at)) if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        """Committed versions in order."""
        return sorted(int(n[1:]) for s in self._list("versions") if (n := s.getPath().getName())[0] == "v")

    def _said(self, version: int | None) -> dict:
        version = version or (self.versions() or [0])[-1]
        if not version:
            raise ValueError("the table has no version")
        stream = self._fs.open(self._path(f"{self.path}/versions/v{version:08d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> DataFrame:
        """The shards of a version (the last one unless named), one row each."""
        if not version and not self.versions():
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{self._said(version)['manifest']}")

    # -- rows

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of a version."""
        schema = self._schema(version)
        rows = self._rows(self.manifest(version), schema)
        return rows.select(*(F.col(f"c{i}").alias(f.name) for i, f in enumerate(schema)))

    def placed(self, version: int | None = None, place_col: str = "place") -> DataFrame:
        """Rows of a version with the shard that holds them, a struct of run and shard (a column of that name is replaced)."""
        schema = self._schema(version)
        rows = self._rows(self.manifest(version), schema)
        return rows.select(*(F.col(f"c{i}").alias(f.name) for i, f in enumerate(schema) if f.name != place_col), F.struct("run", "shard").alias(place_col))

    def _schema(self, version: int | None) -> T.StructType:
        return T.StructType.fromJson(self._said(version)["columns"])

    def _rows(self, shards: DataFrame, schema: T.StructType) -> DataFrame:
        """Columns c0, c1, ... and n_bytes, run and shard, and a digest of each row's place (``at``)."""
        stored = T.StructType([*(T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema)), T.StructField("n_bytes", T.LongType()), T.StructField("run", T.StringType()), T.StructField("shard", T.IntegerType())])
        alive = self._shards(shards)
        if not alive:
            return self.spark.createDataFrame([], T.StructType([*stored, T.StructField("at", T.LongType())]))
        files = self.spark.read.schema(stored).option("basePath", f"{self.path}/data").parquet(*(f"{self.path}/data/run={run}/shard={k}" for run, ks in alive.items() for k in sorted(ks)))
        return files.select("*", F.xxhash64("run", "shard", F.col("_metadata.file_name"), F.col("_metadata.row_index")).alias("at"))

    @staticmethod
    def _shards(manifest: DataFrame) -> dict[str, set[int]]:
        """The shards of each run that a manifest names: names only, some hundreds of thousands for a table of 100 TB."""
        out: dict[str, set[int]] = {}
        for r in manifest.select("run", "shard").collect():
            out.setdefault(r.run, set()).add(r.shard)
        return out

    # -- writes

    def append(self, rows: DataFrame) -> int:
        """Add an arrival as small shards, one a task; returns the new version."""
        version = (self.versions() or [0])[-1] + 1
        schema = self._schema(None) if version > 1 else T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
        if sorted((f.name, f.dataType.simpleString()) for f in rows.schema) != sorted((f.name, f.dataType.simpleString()) for f in schema):
            raise ValueError("an arrival has the columns of the table")
        sized = rows.select(*(F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(schema)), self.size.alias("n_bytes"), F.spark_partition_id().alias("shard"))
        return self._commit(self.manifest() if version > 1 else None, self._write(sized, version), version, schema)

    def compact(self) -> int | None:
        """Merge each tier that holds ``fan`` shards or more below half the target; the new version, or None."""
        small = self.manifest().where(F.col("n_bytes") < self.target // 2)
        tiers = [r.tier for r in small.groupBy("tier").count().where(F.col("count") >= self.fan).collect()]
        if not tiers:
            return None
        merged, version, schema = small.where(F.col("tier").isin(tiers)), self.versions()[-1] + 1, self._schema(None)
        shards = max(1, math.ceil(merged.agg(F.sum("n_bytes")).first()[0] / self.target))
        rows = self._rows(merged, schema)
        dealt = rows.select(*(f"c{i}" for i in range(len(schema))), "n_bytes", F.pmod("at", F.lit(shards)).cast("int").alias("shard"))
        new = self._write(dealt.repartition(shards, "shard"), version)
        return self._commit(self.manifest().join(merged, ["run", "shard"], "left_anti"), new, version, schema)

    def vacuum(self, keep: int = 2, older_than: float = DAY) -> int:
        """Remove versions before the last ``keep``, and shards and manifests that none of those names and that are
        ``older_than`` seconds old; returns how many folders."""
        versions = self.versions()
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"{self.path}/versions/v{v:08d}"), True)
        last = versions[-keep:]
        alive: dict[str, set[int]] = {}
        for v in last:
            for run, shards in self._shards(self.manifest(v)).items():
                alive.setdefault(run, set()).update(shards)
        manifests = {self._said(v)["manifest"] for v in last}
        before, gone = self.spark._jvm.java.lang.System.currentTimeMillis() - 1000 * older_than, 0
        dead = [s for s in self._list("manifests") if s.getPath().getName() not in manifests]
        for run in self._list("data"):
            name = run.getPath().getName()
            if named := alive.get(name.removeprefix("run=")):
                dead += [s for s in self._list(f"data/{name}") if s.getPath().getName().startswith("shard=") and int(s.getPath().getName()[6:]) not in named]
            else:
                dead.append(run)
        for s in dead:
            if s.getModificationTime() <= before:
                self._fs.delete(s.getPath(), True)
                gone += 1
        return gone

    def _write(self, rows: DataFrame, version: int) -> DataFrame | None:
        """Write ``rows`` (c0, ..., n_bytes, shard) by their shard under a new run; their manifest rows."""
        run = f"{version:08d}-{uuid.uuid4().hex[:12]}"
        at = f"{self.path}/data/run={run}"
        rows.write.partitionBy("shard").option("compression", "zstd").parquet(at)
        if not any(s.getPath().getName().startswith("shard=") for s in self._fs.listStatus(self._path(at))):
            return None
        back = self.spark.read.schema("n_bytes long, shard int").parquet(at).groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum("n_bytes").alias("n_bytes"))
        tier = F.floor(F.log(float(self.fan), F.greatest("n_bytes", F.lit(1)))).cast("int")
        return back.select(F.lit(run).alias("run"), "shard", tier.alias("tier"), "n_rows", "n_bytes", F.lit(version).cast("long").alias("added"))

    def _commit(self, old: DataFrame | None, new: DataFrame | None, version: int, schema: T.StructType) -> int:
        name = uuid.uuid4().hex
        every = self.spark.createDataFrame([], MANIFEST) if old is None else old.select(*MANIFEST_COLUMNS)
        if new is not None:
            every = every.unionByName(new)
        every.coalesce(1).write.parquet(f"{self.path}/manifests/{name}")
        for run, shards in self._shards(self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{name}")).items():
            there = {s.getPath().getName() for s in self._list(f"data/run={run}")}
            if not {f"shard={k}" for k in shards} <= there:
                raise Conflict(f"files of run {run} are gone")
        aside, to = self._path(f"{self.path}/versions/.{name}"), self._path(f"{self.path}/versions/v{version:08d}")
        stream = self._fs.create(aside, False)
        stream.write(bytearray(json.dumps({"manifest": name, "columns": schema.jsonValue()}).encode()))
        stream.close()
        if not self._publish(aside, to):
            self._fs.delete(aside, False)
            raise Conflict(f"version {version} exists")
        return version

    def _publish(self, aside, to) -> bool:
        """Give the file its number unless that is taken, in one step: a hard link on a local disk (where a rename
        would replace), a rename elsewhere, which file systems as HDFS refuse onto an existing file."""
        if self._fs.getScheme() != "file":
            try:
                return self._fs.rename(aside, to)
            except Exception as e:
                if "Exist" in str(e):
                    return False
                raise
        nio = self.spark._jvm.java.nio.file
        local = lambda p: nio.Paths.get(self._fs.makeQualified(p).toUri())
        try:
            nio.Files.createLink(local(to), local(aside))
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        self._fs.delete(aside, False)
        return True
