"""Tables whose files are named by a manifest: data first, the manifest last, so a write is seen whole or not at all.

A manifest lists the files of each part.  A new version names new files for the parts that changed and the old ones for
the others, so what did not change is neither read nor written.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from barloom.sources.store import key_text, upsert


class Conflict(RuntimeError):
    """Another writer has committed since the version that this one started from."""


class CommittedTable:
    """Files under ``path`` and the manifests that name them, on any file system that Spark's Hadoop client reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def version(self) -> int:
        """The last committed version, 0 before the first."""
        return max((int(n[:-5]) for n in self._names("manifests") if re.fullmatch(r"\d+\.json", n)), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "parts": {}, "schemas": {}, "facts": {}}
        text = self.spark.read.option("wholetext", True).text(f"{self.path}/manifests/{version:08d}.json").first()[0]
        return json.loads(text)

    def write(self, df: DataFrame, by: str | None = None) -> dict[str, list[str]]:
        """New files of ``df``, by the values of column ``by`` where one is given; not part of the table before ``commit``."""
        folder = f"{self.path}/files/{uuid.uuid4().hex}"
        (df.write.partitionBy(by) if by else df.write).parquet(folder)
        found: dict[str, list[str]] = {}
        for f in self.spark.read.schema(df.schema).parquet(folder).inputFiles():
            value = re.search(rf"/{by}=([^/]*)/", f)[1] if by else ""
            found.setdefault(value, []).append(f)
        return found

    def commit(self, base: int, parts: dict[str, list[str]], schemas: dict[str, str], facts: dict) -> int:
        """Make the files the next version after ``base``; raises ``Conflict`` where another writer was first.

        The version number is claimed by creating a file, which one writer can do; the manifest then appears by one rename.
        """
        version = base + 1
        claim, done = self._path(f"{self.path}/claims/{version:08d}"), self._path(f"{self.path}/manifests/{version:08d}.json")
        if self.version() != base or self._fs.exists(done):
            raise Conflict(f"version {base} is not the last one")
        if not self._fs.createNewFile(claim):
            raise Conflict(f"version {version} is claimed; remove {claim} if its writer is gone")
        draft = self._path(f"{self.path}/claims/{version:08d}.json")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps({"version": version, "parts": parts, "schemas": schemas, "facts": facts}).encode()))
        out.close()
        self._fs.mkdirs(self._path(f"{self.path}/manifests"))
        if not self._fs.rename(draft, done):
            raise Conflict(f"version {version} exists")
        return version

    def read(self, part: str, files: list[str], manifest: dict) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(manifest["schemas"][part]))
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*files)


class KeyedTable(CommittedTable):
    """Records in buckets by the hash of their key; an upsert rewrites the buckets of the new keys only."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], columns: list[str], buckets: int = 64):
        super().__init__(spark, path)
        self.key, self.columns, self.buckets = key, columns, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[key_text(c) for c in self.key]), F.lit(self.buckets)).cast("int")

    def records(self, version: int | None = None) -> DataFrame:
        """All records of the last version, or of an earlier one."""
        found = self.manifest(version)
        if not found["parts"]:
            return self.spark.createDataFrame([], ", ".join(f"`{c}` string" for c in self.columns))
        return self.read("records", [f for files in found["parts"].values() for f in files], found)

    def upsert(self, new: DataFrame, sequence: str) -> int:
        """Replace or add the records of ``new``, the greatest ``sequence`` of each key winning; returns the version.

        Only files of touched buckets are read; ``buckets`` numbers at most pass through the driver.
        """
        before = self.manifest()
        touched = [str(b) for (b,) in new.select(self._bucket()).distinct().collect()]
        if not touched:
            return before["version"]
        old = [f for b in touched for f in before["parts"].get(b, [])]
        stored = self.read("records", old, before) if old else self.spark.createDataFrame([], ", ".join(f"`{c}` string" for c in self.columns))
        stored = stored.withColumn(sequence, F.lit(None).cast(new.schema[sequence].dataType))
        merged = upsert(stored, new, self.key, self.columns, sequence)
        files = self.write(merged.withColumn("bucket", self._bucket()).repartition(len(touched), "bucket"), "bucket")
        return self.commit(before["version"], {**before["parts"], **files}, {"records": merged.schema.json()}, {"touched": sorted(map(int, touched))})


def write_dataset(df: DataFrame, path: str, target: str, by: str = "symbol", preview: int = 100) -> dict:
    """Data by ``by``, head and tail previews in order of time and ``by``, and facts about them, as one version."""
    table = CommittedTable(df.sparkSession, path)
    base = table.version()
    data = [f for files in table.write(df, by).values() for f in files]
    written = df.sparkSession.read.schema(df.schema).option("basePath", data[0].split(f"/{by}=")[0]).parquet(*data).select(*df.columns) if data else df.limit(0)
    parts, order = {"data": data}, ["ts", by]
    for name, cols in (("head", order), ("tail", [F.col(c).desc() for c in order])):
        parts[name] = [f for files in table.write(written.orderBy(*cols).limit(preview).coalesce(1)).values() for f in files]
    facts = written.agg(F.count(F.lit(1)).alias("rows"), F.min("ts").cast("string").alias("start"), F.max("ts").cast("string").alias("end"),
                        F.sum(F.col(target)).cast("double").alias("positives")).first().asDict()
    facts |= {"target": target, "by": by, "columns": df.columns}
    table.commit(base, parts, {n: df.schema.json() for n in parts}, facts)
    return facts


def read_dataset(spark: SparkSession, path: str, part: str = "data") -> tuple[DataFrame, dict]:
    """``data``, ``head`` or ``tail`` of the last version, and its facts."""
    table = CommittedTable(spark, path)
    found = table.manifest()
    files = found["parts"][part]
    schema = T.StructType.fromJson(json.loads(found["schemas"][part]))
    if part != "data" or not files:
        return table.read(part, files, found), found["facts"]
    return spark.read.schema(schema).option("basePath", files[0].split(f"/{found['facts']['by']}=")[0]).parquet(*files).select(*schema.names), found["facts"]
