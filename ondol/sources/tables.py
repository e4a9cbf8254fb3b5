"""Sources and sinks: tolerant log scans, label files, routed writes, and small mutable tables over Parquet.

A mutable Table is a folder of complete snapshots.  Every change writes the next snapshot and
readers take the newest one that is complete, so a lost executor or driver leaves the old rows in
force.  A change rewrites the table: it is meant for operational tables (saved estimates, tokens,
caches, reference prices).  Corpus-sized rows go through `append` and `write_routed`, which write
only what is new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType


class Table:
    """Snapshots v=0, v=1, ... below a path; the two newest are kept, since a reader may still hold the older.

    One writer at a time: two that change the table at once meet an error at the same snapshot's folder.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

    def _files(self):
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return root, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the complete snapshots."""
        root, fs = self._files()
        if not fs.exists(root):
            return []
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(path(f"{self.path}/{n}/_SUCCESS")))

    def read(self) -> DataFrame:
        """The newest snapshot; no rows where nothing was written yet."""
        found = self.versions()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={found[-1]}") if found else self.spark.createDataFrame([], self.schema)

    def replace_all(self, rows: DataFrame) -> None:
        """Rows of other column order or with more columns are cut to the table's schema."""
        found = self.versions()
        new = found[-1] + 1 if found else 0
        root, fs = self._files()
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        broken = path(f"{self.path}/v={new}")
        if fs.exists(broken):
            fs.delete(broken, True)  # left by a writer that was lost before it ended
        rows.select([F.col(f"`{f.name}`").cast(f.dataType) for f in self.schema]).write.mode("errorifexists").parquet(f"{self.path}/v={new}")
        for old in found[:-1]:
            fs.delete(path(f"{self.path}/v={old}"), True)

    def insert(self, rows: DataFrame) -> None:
        self.replace_all(self.read().unionByName(rows.select(self.schema.names)))

    def put_if_absent(self, rows: DataFrame, keys: list[str], order: str) -> None:
        """The first writer of a key wins; among new rows of one key that with the least order."""
        old = self.read()
        first = rows.withColumn("_i", F.row_number().over(Window.partitionBy(keys).orderBy(order))).where("_i = 1").select(self.schema.names)
        self.replace_all(old.unionByName(first.join(old.select(keys), keys, "left_anti").select(self.schema.names)))

    def upsert(self, rows: DataFrame, keys: list[str], order: str) -> None:
        """The last writer of a key wins; among new rows of one key that with the largest order."""
        last = rows.withColumn("_i", F.row_number().over(Window.partitionBy(keys).orderBy(F.desc(order)))).where("_i = 1").select(self.schema.names)
        self.replace_all(self.read().join(last.select(keys), keys, "left_anti").select(self.schema.names).unionByName(last))

    def delete(self, condition: Column) -> int:
        """Number of rows deleted; a condition that is null keeps the row."""
        old, hit = self.read(), F.coalesce(condition, F.lit(False))
        n = old.where(hit).count()
        if n:
            self.replace_all(old.where(~hit))
        return n

    def update(self, condition: Column, **values: Column) -> int:
        """Number of rows changed."""
        old, hit = self.read(), F.coalesce(condition, F.lit(False))
        n = old.where(hit).count()
        if n:
            changed = [F.when(hit, values[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in values else F.col(f"`{c}`") for c in self.schema.names]
            self.replace_all(old.select(changed))
        return n

    def take(self, condition: Column) -> DataFrame:
        """Consume once: the rows that meet the condition, which the table then no longer has.

        They are read from the previous snapshot, which stays until two more changes.
        """
        old, hit = self.read(), F.coalesce(condition, F.lit(False))
        self.replace_all(old.where(~hit))
        return old.where(hit)


def append(rows: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = rows.write.mode("append")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_routed(rows: DataFrame, path: str, confidence: str = "confidence", least: float = 0.7) -> None:
    """Rows with at least that confidence go to target=cases, others and nulls to target=review."""
    target = F.when(F.col(confidence) >= least, "cases").otherwise("review")
    append(rows.withColumn("target", target), path, "target")


def read_logs(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines; malformed ones stay as rows with the line in `malformed`, and a missing level is info."""
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    raw = spark.read.text(path)
    wanted = StructType([*fields.fields]).add("malformed", StringType())
    parsed = raw.where("trim(value) <> ''").select(F.from_json("value", wanted, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "malformed"}).alias("e")).select("e.*")
    return parsed.withColumn("level", F.coalesce("level", F.lit("info"))) if "level" in fields.names else parsed


def append_unseen(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old label rows, and new ones whose keys are not labelled yet; of repeated new keys one row stays."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(keys), keys, "left_anti").select(old.columns))


def read_labels(spark: SparkSession, path: str, schema: StructType | str, encoding: str = "UTF-8") -> DataFrame:
    """A label CSV with a header; encoding names that of the file, and a byte order mark is skipped."""
    return spark.read.option("header", True).option("encoding", encoding).schema(schema).csv(path)
