"""Tables as Parquet folders below one root: scan, existence, overwrite, append, and queries over them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once in the folder that driver and executors share (``spark.checkpoint.dir``), for several readers."""
    spark, master = df.sparkSession, df.sparkSession.sparkContext.master
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:  # tests and local runs
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="siltstone-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    path, schema = f"{base.rstrip('/')}/siltstone/{name}-{uuid.uuid4().hex}", df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


class Store:
    """Names like ``silver.claims`` are folders below the root.

    Every write goes to a new folder; then a pointer file names the folders that are the table from now on: the new one
    alone, or those before it too. Frames that read the table keep their input, also the one being written, and a
    failed write leaves it as it was. Of two writers at once one fails, as a pointer is never written over.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def _folder(self, name: str) -> str:
        return f"{self.root}/{name.replace('.', '/')}"

    def _pointers(self, name: str) -> list[str]:
        fs, p = self._fs(f"{self._folder(name)}/_current")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _parts(self, name: str, pointer: str) -> list[str]:
        fs, p = self._fs(f"{self._folder(name)}/_current/{pointer}")
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()
        finally:
            stream.close()

    def _current(self, name: str) -> list[str]:
        """The folders that are the table now."""
        pointers = self._pointers(name)
        return [f"{self._folder(name)}/{part}" for part in self._parts(name, pointers[-1])] if pointers else []

    def exists(self, name: str) -> bool:
        return bool(self._pointers(name))

    def table(self, name: str) -> DataFrame:
        parts = self._current(name)
        if not parts:
            raise KeyError(f"no table {name!r} in {self.root}")
        return self.spark.read.option("mergeSchema", len(parts) > 1).parquet(*parts)

    def _point(self, name: str, parts: list[str], after: list[str]) -> None:
        fs, pointer = self._fs(f"{self._folder(name)}/_current/{int(after[-1]) + 1 if after else 0:012d}")
        stream = fs.create(pointer, False)  # an error where another writer was first
        stream.writeBytes("\n".join(parts))
        stream.close()

    def _write(self, name: str, df: DataFrame, keep: bool) -> DataFrame:
        pointers, part = self._pointers(name), f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self._folder(name)}/{part}")
        before = self._parts(name, pointers[-1]) if keep and pointers else []
        self._point(name, [*before, part], pointers)
        return self.table(name)

    def overwrite(self, name: str, df: DataFrame) -> DataFrame:
        return self._write(name, df, keep=False)

    def append(self, name: str, df: DataFrame) -> DataFrame:
        return self._write(name, df, keep=True)

    def clean_up(self, name: str, keep: int = 2) -> None:
        """Remove pointers but the last ``keep``, and folders that none of these names."""
        pointers = self._pointers(name)
        used = {part for p in pointers[-keep:] for part in self._parts(name, p)}
        fs, folder = self._fs(self._folder(name))
        for s in fs.listStatus(folder) if pointers else []:
            if s.getPath().getName().startswith("v-") and s.getPath().getName() not in used:
                fs.delete(s.getPath(), True)
        for p in pointers[:-keep]:
            fs.delete(self._fs(f"{self._folder(name)}/_current/{p}")[1], False)

    def register(self, name: str) -> None:
        """Make the table readable in SQL under its name's last part."""
        self.table(name).createOrReplaceTempView(name.rsplit(".", 1)[-1])


def run_query(spark: SparkSession, sql: str) -> list[dict]:
    """The rows of a query as dictionaries: for results as small as counts."""
    return [r.asDict() for r in spark.sql(sql).collect()]


def query_columns(spark: SparkSession, sql: str) -> list[str]:
    """The columns of a query; it does not run."""
    return spark.sql(sql).columns


def describe(df: DataFrame) -> list[dict]:
    """Name and type of each column."""
    return [{"col_name": n, "data_type": t} for n, t in df.dtypes]
