"""What the operators share: the shared folder, written tables, word rules, bounded samples."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text is a sequence of words between these ASCII white-space characters.
ASCII_SPACE = r"[\x20\x09-\x0D]+"

_own_folder: str | None = None


#: Rows and bytes of an Arrow batch, in place of Spark's 10,000 and 64 MB: texts are long, and a worker holds a batch
#: several times over.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b")}


def bounded_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for this session, where it has Spark's own sizes."""
    for key, (usual, ours) in BATCHES.items():
        if spark.conf.get(key, usual) == usual:
            spark.conf.set(key, ours)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder, through Spark's reader only."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a temporary one in local mode only."""
    global _own_folder
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="canopy-")
        atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
    return f"file://{_own_folder}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/canopy/{label}-{uuid.uuid4().hex}"


@contextmanager
def tidy_shuffles(spark: SparkSession):
    """What is run within gives up its shuffle files when it ends; else they stay until the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: a cut in the lineage that survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    bounded_batches(spark)
    with tidy_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a folder that new_path named."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def local_path(path: str) -> str | None:
    """The plain path of a file: URI, or None for another store."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if path.startswith("/") else None


def fold(column, by: int):
    """The remainder that splits documents into folds: crc32 of the id as text; -1, in no fold, for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % by, F.lit(-1))


def words_column(text):
    """Lower-cased words of a text column as an array; null and blank texts give an empty array."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), ASCII_SPACE), lambda w: w != "")


def byte_classes(kept: str) -> bytes:
    """A table for byte_words: A-Z become a-z, the kept ASCII characters and all bytes beyond ASCII stay, others part words."""
    stay = {ord(c) for c in kept}
    return bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or b in stay else 32 for b in range(256))


def byte_words(raw: bytes, classes: bytes, piece: int = 1 << 20):
    """Lists of the words of a UTF-8 text, in order; a long text comes in pieces, so memory doesn't grow with its words."""
    clean = raw.translate(classes)
    at = 0
    while at < len(clean):
        end = clean.find(b" ", at + piece)
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end


def per_process(kind: str, version, make):
    """make()'s value, kept for later tasks in the same Python worker; that of another kind or version goes first.

    Workers live as long as their executor, so what several models leave behind would add up.
    """
    import ctypes
    import gc
    import sys
    import types

    store = sys.modules.setdefault("_canopy_process_store", types.ModuleType("_canopy_process_store")).__dict__
    held = store.get("held")
    if held is None or held[:2] != (kind, version):
        if held is not None:
            store["held"] = held = None
            gc.collect()
            try:
                ctypes.CDLL(None).malloc_trim(0)  # else the freed memory stays with the worker
            except (AttributeError, OSError):
                pass
        store["held"] = kind, version, make()
    return store["held"][2]
