"""Looking at files through Hadoop's FileSystem, so that any path Spark reads can also be checked.

Only "not there" counts as absent; every other error (permissions, an unreachable store) is raised.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _open(spark, path)
    return bool(fs.exists(p))


def data_files(spark: SparkSession, path: str) -> int:
    """Number of a table folder's files of data (markers left out)."""
    return sum(not n.rsplit("/", 1)[-1].startswith(("_", ".")) for n, _, _ in files(spark, path)) if exists(spark, path) else 0


def has_data(spark: SparkSession, path: str) -> bool:
    """Whether a table folder holds files of data (a folder of markers alone is an empty table)."""
    return data_files(spark, path) > 0


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder, sorted."""
    fs, p = _open(spark, path)
    return sorted(str(s.getPath().getName()) for s in fs.listStatus(p))


def files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """``(path, length, time of change in ms)`` of every file at or under ``path``, sorted."""
    fs, p = _open(spark, path)
    out, it = [], fs.listFiles(p, True)
    while it.hasNext():
        s = it.next()
        out.append((str(s.getPath().toString()), int(s.getLen()), int(s.getModificationTime())))
    return sorted(out)


def qualified(spark: SparkSession, path: str) -> str:
    fs, p = _open(spark, path)
    return str(fs.makeQualified(p).toString())


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder of our own, if it is there."""
    fs, p = _open(spark, path)
    if fs.exists(p):
        fs.delete(p, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _open(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _open(spark, path)
    source = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
    finally:
        source.close()
