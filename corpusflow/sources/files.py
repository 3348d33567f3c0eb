"""Small files and folders of any Hadoop file system, from the driver."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path, or anything that its wildcards match, is there."""
    p, system = _path(spark, path)
    return bool(system.globStatus(p))


def is_folder(spark: SparkSession, path: str) -> bool:
    p, system = _path(spark, path)
    return bool(system.exists(p) and system.getFileStatus(p).isDirectory())


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file, folders included."""
    p, system = _path(spark, path)
    out = system.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def get_text(spark: SparkSession, path: str) -> str:
    """Read a small text file, its line ends as they are."""
    p, system = _path(spark, path)
    stream = system.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or a folder with all that is in it, if it is there."""
    p, system = _path(spark, path)
    system.delete(p, True)


def listed(spark: SparkSession, folder: str, endings: tuple[str, ...]) -> list[str]:
    """The files right in a folder with one of the endings, by name; none where the folder is missing."""
    p, system = _path(spark, folder)
    if not system.exists(p):
        return []
    found = [s.getPath().toString() for s in system.listStatus(p) if s.isFile()]
    return sorted(f for f in found if f.lower().endswith(endings))
