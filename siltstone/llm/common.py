"""What the operators of this subpackage share: session set-up, durable tables, word splitting."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch handed to Python. A batch holds whole texts, so few rows keep it in memory even when texts are very long.
BATCH_ROWS = 256
REPO = Path(__file__).resolve().parents[2]


def prepare(spark: SparkSession) -> None:
    """Set what every operator needs: small Arrow batches, and this package on the executors.

    The package is shipped as a zip file unless the Python path already names the place it lies in.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    known = {Path(p or ".").resolve() for p in (os.environ.get("PYTHONPATH", "").split(os.pathsep) + [os.getcwd()])}
    if REPO in known or (Path.cwd() / "siltstone").exists() or getattr(context, "_siltstone_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="siltstone-")) / "siltstone_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((REPO / "siltstone").rglob("*.py")):
            z.write(p, p.relative_to(REPO))
    context.addPyFile(str(target))
    context._siltstone_shipped = True


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a new local one, on a
    local master alone: on a cluster, executors would each write to their own disk, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="siltstone-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def durable(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/siltstone/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._siltstone_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the files of a ``durable`` table that nothing will read again."""
    path = getattr(df, "_siltstone_path", None)
    if path:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def give_back() -> None:
    """Return memory that is no longer used to the system: after training, the driver would hold it to the end."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # glibc alone has this call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_HELD: dict = {}


def held(key, make):
    """What a Python worker keeps between tasks: one large object at a time, the one asked for last.

    Workers outlive their stages, so caches of several operators would add up in an executor's memory.
    """
    if key not in _HELD:
        _HELD.clear()
        give_back()
        _HELD[key] = make()
    return _HELD[key]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it; Spark does not tell cases apart."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fold_of(doc_id) -> F.Column:
    """crc32 of the decimal doc_id modulo 4; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(4)


def in_share(doc_id, share) -> F.Column:
    """True for about ``share`` of all ids, always the same ones: a sample without an order, a limit or a shuffle."""
    return F.pmod(F.xxhash64(doc_id), F.lit(1 << 31)) < F.least(F.lit(1.0), share if isinstance(share, F.Column) else F.lit(float(share))) * (1 << 31)


def ascii_lower_words(text: str) -> list[bytes]:
    """Words between the six ASCII white-space characters, A-Z lower-cased; other letters stay as they are."""
    return text.encode("utf-8", "surrogatepass").lower().split()
