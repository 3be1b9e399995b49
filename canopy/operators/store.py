"""Tables that outlive a run: a log of keyed values, and versions of what was built, with commits.

Everything is Parquet in a folder that all nodes reach, written by Spark alone. Rows are only ever added; what counts is
decided when reading, by the last commit or the newest row. So a run that fails midway leaves what was there before.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_folder: str | None = None


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; where that is unset, in a temporary one, in local mode only."""
    global _own_folder
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        if _own_folder is None:
            _own_folder = tempfile.mkdtemp(prefix="canopy-")
            atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
        folder = f"file://{_own_folder}"
    return f"{folder.rstrip('/')}/canopy/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder, read again: made once, whoever reads it, and kept when executors go."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _target(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, system = _target(spark, path)
    return system.exists(target)


def remove(spark: SparkSession, path: str) -> bool:
    """Whether there was something to delete."""
    target, system = _target(spark, path)
    return system.delete(target, True)


def nothing(spark: SparkSession, schema: str) -> DataFrame:
    """No rows, of which Spark knows that there are none: nothing is shuffled to meet them, and no worker is started."""
    columns = [c.split() for c in schema.split(", ")]
    return spark.range(1).select(*[F.lit(None).cast(kind).alias(name) for name, kind in columns]).limit(0)


#: Rows of keys or ids that are broadcast at most; a bigger side is joined by a shuffle.
MOST = 1_000_000


def among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of a written table (_id, ...) whose _id is one of ids (_id, each once).

    The smaller of both, the ids that stay and those that go, meets the rows by broadcast, so that rows with long texts
    aren't shuffled; where both are beyond MOST, by a shuffle.
    """
    n, every = ids.count(), rows.count()
    if n == every:
        return rows
    if n <= MOST:
        return rows.join(F.broadcast(ids), "_id", "left_semi")
    if every - n <= MOST:
        return rows.join(F.broadcast(written(rows.select("_id").join(ids, "_id", "left_anti"), "ids")), "_id", "left_anti")
    return rows.join(ids, "_id", "left_semi")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with a gapless number (long) from 0 in an order, without one task that sees all rows.

    Rows are sorted by ranges; a row's number is its place in its partition and the sizes of the partitions before.
    Which of equal rows comes first is open.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = written(sorted_.withColumn("_part", F.shiftright("_at", 33)), "numbered")
    sizes = rows.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = sizes.select("_part", (ahead - F.col("first")).alias("_shift"))  # one row a partition
    return rows.join(F.broadcast(shift), "_part").withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


# -- a log of keyed values


def latest(log: DataFrame) -> DataFrame:
    """(key, value) of a log (key, value, version): each key's newest valid value.

    A value is JSON; one that isn't is a miss, as if it had never been written. A null value takes its key back, and a
    null key everything up to its version. Of several rows of a key and version, the greatest value counts.
    """
    newest = _live(log).groupBy("key").agg(F.max(F.struct("version", "value"))["value"].alias("value"))
    return newest.filter("value is not null")


def known(log: DataFrame) -> DataFrame:
    """(key) of what latest reads, without moving the values."""
    there = F.struct("version", F.col("value").isNotNull().alias("there"))  # as a null value is less than any other
    return _live(log).groupBy("key").agg(F.max(there)["there"].alias("there")).filter("there").select("key")


def _live(log: DataFrame) -> DataFrame:
    """The rows of a log that weren't cleared and whose value is JSON or null."""
    cleared = log.filter("key is null").agg(F.max("version")).first()[0]
    live = log.filter("key is not null") if cleared is None else log.filter(F.col("key").isNotNull() & (F.col("version") > cleared))
    return live.filter(F.col("value").isNull() | F.try_parse_json("value").isNotNull())


class Log:
    """Keyed JSON texts in a folder; versions are the driver's clock in nanoseconds, one for each append."""

    SCHEMA = "key string, value string, version long"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch(spark, "log")

    def rows(self) -> DataFrame:
        if exists(self.spark, self.path):
            return self.spark.read.schema(self.SCHEMA).parquet(self.path)
        return nothing(self.spark, self.SCHEMA)

    def read(self) -> DataFrame:
        return latest(self.rows())

    def keys(self) -> DataFrame:
        return known(self.rows())

    def append(self, rows: DataFrame) -> None:
        """Rows (key, value)."""
        rows.select("key", "value", F.lit(time.time_ns()).alias("version")).write.mode("append").parquet(self.path)

    def clear(self) -> None:
        """What was written so far is no longer read."""
        self.append(self.spark.range(1).select(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value")))

    def compact(self) -> None:
        """Rewrite the log with what counts, into a new folder that this log then reads; the old one stays for its readers."""
        now, path = self.read(), f"{self.path.rstrip('/')}-{time.time_ns()}"
        now.withColumn("version", F.lit(time.time_ns())).write.parquet(path)
        self.path = path


# -- versions of what was built


class Store:
    """Named tables of many sources in versions. A version counts from its commit on, which is written last.

    Tables lie at path/name/key/version, key being 24 digits of the hash of the source's text; commits of all sources
    are one table (key, source, version, params, built_at, live).
    """

    COMMITS = "key string, source string, version long, params string, built_at timestamp, live boolean"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch(spark, "store")

    @staticmethod
    def key(source: str) -> str:
        from hashlib import sha256

        return sha256(source.encode()).hexdigest()[:24]

    def _at(self, name: str, source: str, version: int) -> str:
        return f"{self.path}/{name}/{self.key(source)}/{version}"

    def commits(self) -> DataFrame:
        """Of each commit of each source one row."""
        path = f"{self.path}/commits"
        return self.spark.read.schema(self.COMMITS).parquet(path) if exists(self.spark, path) else nothing(self.spark, self.COMMITS)

    def status(self) -> DataFrame:
        """(source, version, params, built_at) of what is remembered."""
        last = self.commits().groupBy("key").agg(F.max_by(F.struct("source", "version", "params", "built_at", "live"), F.struct("version", "built_at")).alias("c"))
        return last.select("c.*").filter("live").drop("live")

    def version(self, source: str, params: str) -> int | None:
        """The last version of a source, if it was built with the same parameters."""
        found = self.status().filter(F.col("source") == source).collect()  # one row at most
        return found[0].version if found and found[0].params == params else None

    def read(self, name: str, source: str, version: int) -> DataFrame | None:
        path = self._at(name, source, version)
        return self.spark.read.parquet(path) if exists(self.spark, path) else None

    def append(self, name: str, source: str, version: int, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self._at(name, source, version))

    def commit(self, source: str, version: int, params: str, live: bool = True) -> None:
        row = self.spark.range(1).select(
            F.lit(self.key(source)).alias("key"), F.lit(source).alias("source"), F.lit(version).cast("long").alias("version"), F.lit(params).alias("params"),
            F.current_timestamp().alias("built_at"), F.lit(live).alias("live"),
        )
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def forget(self, source: str) -> bool:
        """Whether there was a version to forget; its rows stay until vacuum."""
        known = self.status().filter(F.col("source") == source).count() > 0
        if known:
            self.commit(source, time.time_ns(), "", live=False)
        return known

    def listing(self, name: str) -> DataFrame:
        """(source, built_at, n) of what is remembered: how many rows the table `name` of each source's last version has, 0 if it has none."""
        last = self.status().select("source", "version", "built_at", F.substring(F.sha2("source", 256), 1, 24).alias("key"))
        if not exists(self.spark, f"{self.path}/{name}"):
            return last.select("source", "built_at", F.lit(0).cast("long").alias("n"))
        rows = self.spark.read.schema("source string").option("recursiveFileLookup", True).parquet(f"{self.path}/{name}")
        at = F.split(F.col("_metadata.file_path"), "/")  # .../name/key/version/file; rows are counted, not read
        counts = rows.select(F.element_at(at, -3).alias("key"), F.element_at(at, -2).cast("long").alias("version")).groupBy("key", "version").agg(F.count("*").alias("n"))
        return last.join(counts, ["key", "version"], "left").select("source", "built_at", F.coalesce("n", F.lit(0)).cast("long").alias("n"))

    def vacuum(self, names: list[str], source: str) -> int:
        """Delete all versions of a source but the last that counts; how many folders went."""
        kept = {r.version for r in self.status().filter(F.col("source") == source).collect()}
        gone = 0
        for name in names:
            target, system = _target(self.spark, f"{self.path}/{name}/{self.key(source)}")
            for child in system.listStatus(target) if system.exists(target) else []:
                if int(child.getPath().getName()) not in kept:
                    gone += system.delete(child.getPath(), True)
        return gone
