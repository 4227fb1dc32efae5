"""Files that executors open as streams, whatever their size.

Python tasks reach local and mounted folders, HDFS, S3, Google and Azure stores through pyarrow's file systems, with
the credentials that those find by themselves. A store of any other scheme is read by Spark's binary files, which hold a
file whole and end at 2 GB.
"""

from __future__ import annotations

import fnmatch
import hashlib
from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StructField, StructType

from tessera.plans.lineage import cut
from tessera.session import in_arrow

#: Schemes of Hadoop's file systems, and pyarrow's name for the same store (fixed values of both).
STREAMED = {
    "file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss",
}
#: Bytes that are held of a file at once.
CHUNK = 8 << 20


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """A path as Hadoop writes it (``file:/a b``, ``s3a://bucket/key``), as a file system and the path there."""
    scheme, mark, rest = path.partition(":/")
    if not mark or "/" in scheme:
        return pafs.LocalFileSystem(), path
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    if scheme not in STREAMED:
        raise ValueError(f"no stream for {scheme}:")
    return pafs.FileSystem.from_uri(f"{STREAMED[scheme]}:/{quote(rest, safe='/@:')}")


def sha256(path: str, chunk: int = CHUNK) -> str:
    """A file's digest; a chunk of it is in memory."""
    system, name = located(path)
    state, held = hashlib.sha256(), memoryview(bytearray(chunk))
    with system.open_input_stream(name, compression=None, buffer_size=0) as stream:
        while n := stream.readinto(held):
            state.update(held[:n])
    return state.hexdigest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column is the path; its digest comes behind it."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            digest = pa.array([sha256(row.columns[-1][0].as_py())], pa.string())
            yield pa.RecordBatch.from_arrays([*row.columns, digest], names=[*row.schema.names, "sha256"])


def _content(path: str | None) -> bytes | None:
    if path is None:
        return None
    system, name = located(path)
    try:
        with system.open_input_stream(name, compression=None) as stream:
            return stream.read()
    except FileNotFoundError:
        raise FileNotFoundError(f"no image {path}") from None


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column is a list of paths; a list of their files' bytes comes behind it. A batch goes on when it holds some MB of them."""
    for batch in batches:
        start, held, size = 0, [], 0
        for i in range(batch.num_rows):
            held.append([_content(p) for p in batch.columns[-1][i].as_py() or ()])
            size += sum(len(b) for b in held[-1] if b)
            if size >= CHUNK or i + 1 == batch.num_rows:
                made = batch.slice(start, len(held))
                yield pa.RecordBatch.from_arrays([*made.columns, pa.array(held, pa.list_(pa.binary()))], names=[*made.schema.names, "_"])
                start, held, size = i + 1, [], 0


def with_contents(rows: DataFrame, paths: str, name: str) -> DataFrame:
    """``rows`` with an array of the bytes of the files that the array ``paths`` names; null for null, and an error for a file that isn't there."""
    rows = rows.select(*[c for c in rows.columns if c != paths], paths)
    renamed = [F.col(c).alias(f"c{k}") for k, c in enumerate(rows.columns)]
    plain = rows.select(*renamed)
    out = plain.transform(in_arrow, _contents, StructType([*plain.schema.fields, StructField("_", ArrayType(BinaryType()))]))
    return out.toDF(*rows.columns, name)


def streams(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether executors open files below ``path`` themselves; several paths are of one store."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path if isinstance(path, str) else path[0])
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme() in STREAMED


def listed(spark: SparkSession, path: str | list[str], pattern: str = "*") -> DataFrame:
    """``path``, ``length`` of the files with content below one directory or several, at any depth; nothing of them is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length")


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What lies in each folder of a column of paths; a path that is a file stands for itself. Names that begin with a dot or an underscore are no data, as in Spark's listings."""
    for batch in batches:
        for path in batch.columns[0].to_pylist():
            system, name = located(path)
            itself = system.get_file_info(name)
            if itself.type == pafs.FileType.NotFound:
                raise FileNotFoundError(path)
            below = [(path, itself)] if itself.is_file else [
                (f"{path.rstrip('/')}/{f.base_name}", f) for f in system.get_file_info(pafs.FileSelector(name)) if f.base_name[0] not in "._"
            ]
            yield pa.RecordBatch.from_arrays([
                pa.array([p for p, _ in below], pa.string()), pa.array([f.size or 0 for _, f in below], pa.int64()), pa.array([not f.is_file for _, f in below], pa.bool_()),
            ], names=["path", "length", "folder"])


def walked(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path``, ``length`` of all files below a folder whose names are of a pattern of shells, empty files too, which Spark's listings leave out.

    Each level of folders is listed by the executors; a folder is one task's.
    """
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(there).toString()
    tasks, found = 4 * spark.sparkContext.defaultParallelism, []
    level = spark.range(1).select(F.lit(root).alias("path"))
    while True:
        entries = cut(level.transform(in_arrow, _entries, "path string, length long, folder boolean"))
        found.append(entries.where(~F.col("folder") & F.regexp_extract("path", "([^/]+)$", 1).rlike(fnmatch.translate(pattern))).select("path", "length"))
        level = entries.where("folder").select("path")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found)
        level = level.repartition(tasks)


def hashed(files: DataFrame) -> DataFrame:
    """``path, length, sha256`` of listed files, each read as one stream. They are dealt out, so that few files don't share a task."""
    dealt = files.select("length", "path").repartition(4 * files.sparkSession.sparkContext.defaultParallelism)
    return dealt.transform(in_arrow, _digests, "length long, path string, sha256 string").select("path", "length", "sha256")


def hashes(spark: SparkSession, path: str | list[str], pattern: str = "*", only: DataFrame | None = None) -> DataFrame:
    """``path, length, sha256`` of the files with content below a directory, or of those whose directory's name is a ``part`` of ``only``.

    Without ``only``, a task takes the files that Spark's scan gives it by their lengths.
    """
    parent = F.regexp_extract("path", "([^/]+)/[^/]+$", 1)
    pick = lambda df: df if only is None else df.withColumn("part", parent).join(only, "part", "left_semi").drop("part")
    if not streams(spark, path):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
        return pick(files).select("path", "length", F.sha2("content", 256).alias("sha256"))
    if only is not None:
        return hashed(pick(listed(spark, path, pattern)))
    return listed(spark, path, pattern).select("length", "path").transform(in_arrow, _digests, "length long, path string, sha256 string").select("path", "length", "sha256")
