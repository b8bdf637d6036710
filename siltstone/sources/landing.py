"""Landing folders of CSV files, brought to the declared columns; files with the same header line are read together."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.plans.config import BATCH_COLUMNS, METADATA_COLUMNS, TableSpec


@dataclass
class Landed:
    """A bronze table, the files it came from, what was unexpected in them, and the header of each file of the folder."""

    bronze: DataFrame
    files: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    headers: dict[str, list[str]] = field(default_factory=dict)


#: Header lines that the driver fetches at the same time; each is a line of a file, no Spark job.
FETCHES = 16


def csv_files(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the folder's CSV files, by name; listed with Hadoop, so on any file system that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(path):
        return []
    return sorted(s.getPath().toString() for s in fs.listStatus(path) if s.isFile() and s.getPath().getName().lower().endswith(".csv"))


def read_csv(spark: SparkSession, paths: str | list[str], spec: TableSpec) -> DataFrame:
    """Files with one header, all columns text. Never others with them: Spark would lay those under the first one's header."""
    how = spec.expected_file_format
    return spark.read.csv(paths, header=True, sep=how.get("delimiter", ","), encoding=how.get("encoding", "utf-8"), inferSchema=False)


def header_line(spark: SparkSession, path: str, encoding: str) -> str | None:
    """The first line of a file that is not blank, as it is; None where there is none. Reads no further."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).open(p), encoding))
    try:
        while (line := reader.readLine()) is not None and not line.strip():
            pass
        return line
    finally:
        reader.close()


def header_groups(spark: SparkSession, paths: list[str], spec: TableSpec) -> list[tuple[list[str], list[str]]]:
    """(columns, paths) of the files of each header line, in order of their first file.

    So Spark plans a read for each different header, not for each file. A file without a line has no columns.
    """

    def line(path: str) -> str | None:
        try:
            return header_line(spark, path, spec.expected_file_format.get("encoding", "utf-8"))
        except Exception as e:
            raise RuntimeError(f"table '{spec.table_name}': file '{_name(path)}' ({path}) failed: {e}") from e

    groups: dict[str | None, list[str]] = {}
    with ThreadPoolExecutor(FETCHES) as pool:
        for path, header in zip(paths, pool.map(line, paths)):
            groups.setdefault(header, []).append(path)
    return [([] if header is None else read_csv(spark, same[0], spec).columns, same) for header, same in groups.items()]


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def align(df: DataFrame, headers: list[str], file: str = "") -> tuple[DataFrame, list[str]]:
    """Declared columns in order, NULL where the file lacks one; then its extras, which are warned of; then batch columns."""
    extras = [c for c in df.columns if c not in headers and c not in BATCH_COLUMNS]
    columns = [F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in headers]
    columns += [F.col(f"`{c}`") for c in [*extras, *(c for c in BATCH_COLUMNS if c in df.columns and c not in headers)]]
    return df.select(*columns), [f"file '{file}' has unexpected column '{c}' not in expected_headers" for c in extras]


def with_provenance(df: DataFrame, file: str | Column, ingested_at=None) -> DataFrame:
    """When and from which file a row came; ``ingested_at`` fixes the time, else it is the query's start."""
    at = F.current_timestamp() if ingested_at is None else F.lit(ingested_at).cast("timestamp")
    return df.withColumns({"_bronze_ingest_timestamp": at, "_source_file": F.lit(file) if isinstance(file, str) else file})


def file_of(df: DataFrame) -> Column:
    """The name of the file that a row of a read was in; Spark gives it as part of a URI."""
    return F.url_decode(F.replace(df.metadataColumn("_metadata")["file_name"], F.lit("+"), F.lit("%2B")))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows by column name; a column that a frame lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def ingest(spark: SparkSession, folder: str, spec: TableSpec, ingested_at=None, known: set[str] = frozenset()) -> Landed:
    """The bronze rows of a folder's files but the ``known`` ones. Without files, no rows of the declared columns, and a warning."""
    groups = header_groups(spark, csv_files(spark, folder), spec)
    headers = {_name(p): columns for columns, paths in groups for p in paths}
    files, frames, extras = [], [], {}
    for columns, paths in groups:
        new = [p for p in paths if _name(p) not in known]
        files += new
        if new and columns:
            df = read_csv(spark, new, spec)
            extras |= {_name(p): align(df, spec.headers, _name(p))[1] for p in new}
            frames.append(with_provenance(align(df, spec.headers)[0], file_of(df), ingested_at))
    if not frames:
        kinds = [f"`{c}` {'timestamp' if c == '_bronze_ingest_timestamp' else 'string'}" for c in (*spec.headers, *METADATA_COLUMNS)]
        frames.append(spark.createDataFrame([], ", ".join(kinds)))
    warnings = [w for name in sorted(extras) for w in extras[name]] if headers else [f"no CSV files found in {folder}"]
    return Landed(union_all(frames), sorted(files), warnings, dict(sorted(headers.items())))


def header_union(spark: SparkSession, folder: str, spec: TableSpec) -> dict[str, list[str]]:
    """The header of each file, by name; no data is read."""
    return dict(sorted((_name(p), columns) for columns, paths in header_groups(spark, csv_files(spark, folder), spec) for p in paths))
