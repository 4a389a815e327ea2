"""Change capture by modification time and replacement by file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed_files(now: DataFrame, known: DataFrame, path="file_path", mtime="mtime") -> DataFrame:
    """Files that are new or whose modification time differs."""
    return now.join(known.select(path, mtime), [path, mtime], "left_anti")


def deleted_files(now: DataFrame, known: DataFrame, path="file_path") -> DataFrame:
    return known.join(now.select(path), path, "left_anti")


def replace_by_file(units: DataFrame, fresh: DataFrame, touched: DataFrame, gone: DataFrame | None = None, path="file_path") -> DataFrame:
    """Units without those of touched (and deleted) files, and the fresh ones."""
    out = touched.select(path).unionByName(gone.select(path)) if gone is not None else touched.select(path)
    return units.join(out.distinct(), path, "left_anti").unionByName(fresh)


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by ``order``, with map-side combination."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_r")).select(key, "_r.*")
