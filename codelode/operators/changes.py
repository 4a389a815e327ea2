"""Diff hunks and the symbols they touch."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HUNK = r"^@@ -(\d*)(?:,(\d*))?[^+]*\+(\d*)(?:,(\d*))?"


def git_diff(spark: SparkSession, root: str, target: str = "HEAD") -> DataFrame:
    """The diff of a work tree as one row (diff_id, diff); git runs on the driver and its failures give no text."""
    done = subprocess.run(["git", "-C", root, "diff", "--unified=0", target], capture_output=True, text=True, errors="replace", check=False)
    return spark.createDataFrame([(0, done.stdout)], "diff_id long, diff string")


def parse_hunks(diffs: DataFrame, diff_id="diff_id", diff="diff") -> DataFrame:
    """(diff_id, hunk_seq, file_path, old_start, old_count, new_start, new_count); a +++ line sets the file, /dev/null none."""
    lines = diffs.select(F.col(diff_id).alias("diff_id"), F.posexplode(F.split(F.col(diff), "\n")).alias("hunk_seq", "line"))
    name = F.when(F.col("line").startswith("+++ b/"), F.substr("line", F.lit(7))).when(F.col("line").startswith("+++ "), F.lit(""))
    marked = lines.where(F.col("line").startswith("+++ ") | F.col("line").startswith("@@ "))
    carried = F.last(name, ignorenulls=True).over(Window.partitionBy("diff_id").orderBy("hunk_seq"))
    number = lambda g, default: F.coalesce(F.nullif(F.regexp_extract("line", HUNK, g), F.lit("")).try_cast("int"), F.lit(default))
    found = marked.withColumn("file_path", carried).where(F.col("line").startswith("@@ ") & (F.col("file_path") != ""))
    return found.select("diff_id", "hunk_seq", "file_path", number(1, 0).alias("old_start"), number(2, 1).alias("old_count"), number(3, 0).alias("new_start"), number(4, 1).alias("new_count"))


def touched(hunks: DataFrame, units: DataFrame, unit_key: list[str] | None = None) -> DataFrame:
    """(name, kind, file_path, line_number, change): the first hunk that a unit's line lies in, by new lines, else by old ones."""
    h = hunks.select(F.col("file_path").alias("_f"), "hunk_seq", "old_start", "old_count", "new_start", "new_count")
    within = lambda s, n: (F.col(n) > 0) & (F.col("line_number") >= F.col(s)) & (F.col("line_number") < F.col(s) + F.col(n))
    new, old = within("new_start", "new_count"), within("old_start", "old_count")
    change = F.when(new & (F.col("old_count") == 0), "added").when(new, "modified").when(old & (F.col("new_count") == 0), "deleted").when(old, "modified")
    hit = units.join(h, (F.col("file_path") == F.col("_f")) & (new | old)).withColumn("change", change)
    key = unit_key or ["name", "kind", "file_path", "line_number"]
    return hit.groupBy(*key).agg(F.min_by("change", "hunk_seq").alias("change"))
