"""Several projects side by side: an engine for each project root, opened when it is first asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.plans.engine import Engine
from codelode.sources import files as sources


class Catalog:
    def __init__(self, spark: SparkSession):
        self.spark, self.engines = spark, {}

    def project(self, path: str) -> Engine:
        """The engine of the project that ``path`` lies in."""
        root = sources.project_root(path)
        if root not in self.engines:
            self.engines[root] = Engine(self.spark, sources.scan_tree(self.spark, root), root)
        return self.engines[root]

    def add(self, root: str, files: DataFrame) -> Engine:
        """A project whose files come from a table."""
        self.engines[root] = Engine(self.spark, files, root)
        return self.engines[root]

    def status(self) -> DataFrame:
        """(project, units, files, vector_bytes), a row for each project."""
        out = self.spark.createDataFrame([], "project string, units long, files long, vector_bytes long")
        for root, engine in sorted(self.engines.items()):
            out = out.unionByName(engine.status().withColumn("project", F.lit(root)))
        return out

    def units(self) -> DataFrame:
        """The units of all projects, by project."""
        frames = [e.units.withColumn("project", F.lit(root)) for root, e in sorted(self.engines.items())]
        out = frames[0] if frames else None
        for f in frames[1:]:
            out = out.unionByName(f)
        return out
