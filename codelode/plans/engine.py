"""The query surface: one object over an indexed source tree, a table of files or a table of units."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions.hypervectors import WORDS, widest_distance
from codelode.functions.tables import materialize, numbered
from codelode.operators import changes, clusters, encode, extract, graph, outline, ranking, refresh, syntax
from codelode.plans import render
from codelode.sources import files as sources

#: What counts where an argument is missing or out of range.
TOP_K, MAX_DEPTH, MIN_SIZE, THRESHOLD, TARGET = 20, 2, 2, 0.15, "HEAD"


def whole(value, default: int, most: int | None = None) -> int:
    """A positive whole number up to ``most``, else the default."""
    good = isinstance(value, int) and not isinstance(value, bool) and value > 0 and (most is None or value <= most)
    return value if good else default


def number(value, default: float) -> float:
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else default


class Clusters(NamedTuple):
    heads: DataFrame  # cluster_id, size, label
    members: DataFrame  # units by distance from their cluster's centroid
    unclustered: DataFrame  # one row: unclustered_count


class Engine:
    """Nine queries over code units. Results are DataFrames; ``text=True`` renders them.

    Units, vectors, references and postings are written tables. They belong to a version of the
    index: whatever changes the units drops what was derived from them.
    """

    def __init__(self, spark: SparkSession, files: DataFrame, root: str = ".", backend: str = "lines"):
        """``backend`` ``syntax`` takes the units of Python files from their syntax trees."""
        self.spark, self.root, self.version = spark, root, 0
        self.extract = {"lines": extract.extract_units, "syntax": syntax.extract_units}[backend]
        self._index(files)

    @classmethod
    def open(cls, spark: SparkSession, path: str = ".") -> Engine:
        root = sources.project_root(path)
        return cls(spark, sources.scan_tree(spark, root), root)

    @classmethod
    def of_units(cls, units: DataFrame, root: str = ".") -> Engine:
        """An engine over units that come from elsewhere; ``ast`` and ``refresh`` have no files to look at."""
        e = cls.__new__(cls)
        e.spark, e.root, e.version, e.files, e.extract = units.sparkSession, root, 0, None, None
        e._set_units(units)
        return e

    def _index(self, files: DataFrame) -> None:
        self.files = materialize(files, "engine-files")
        self._set_units(self.extract(self.files))

    def _set_units(self, units: DataFrame) -> None:
        # ids follow path and line
        # and, where a line has several, name
        self.units = materialize(numbered(units, ["file_path", "line_number", "kind", "name"], "unit_id"), "engine-units")
        self._vectors = self._refs = self._postings = None
        self.version += 1

    @property
    def vectors(self) -> DataFrame:
        if self._vectors is None:
            self._vectors = materialize(encode.encode_units(self.units), "engine-vectors")
        return self._vectors

    @property
    def references(self) -> DataFrame:
        if self._refs is None:
            self._refs = materialize(graph.references(self.units), "engine-refs")
        return self._refs

    @property
    def postings(self) -> ranking.Postings:
        if self._postings is None:
            texts = self.units.select("unit_id", ranking.document_text().alias("text"))
            self._postings = ranking.Postings.build(texts, "unit_id")
        return self._postings

    def _with_units(self, scores: DataFrame, order: list) -> DataFrame:
        return scores.join(self.units, "unit_id").orderBy(*order)

    def search(self, query: str, k: int = TOP_K, mode: str = "hybrid", text: bool = False):
        """Units by ``hybrid`` (both rankings at twice k, fused), ``vector`` or ``bm25``."""
        k = whole(k, TOP_K)
        many = 2 * k if mode == "hybrid" else k
        if mode != "bm25":
            near = ranking.nearest(self.vectors, encode.encode_query(self.spark, query), many)
        if mode == "vector":
            out = near.withColumnRenamed("similarity", "score").drop("dist")
        else:
            words = ranking.top(self.postings.scores(query).withColumnRenamed("doc_id", "unit_id"), many, key="unit_id")
            out = words
        if mode == "hybrid":
            out = ranking.fuse(ranking.ranked(words, key="unit_id"), ranking.ranked(near, by="dist", key="unit_id", descending=False), k, key="unit_id")
        found = self._with_units(out, [F.desc("score"), "unit_id"])
        return render.results(found.collect()) if text else found

    def status(self) -> DataFrame:
        return self.units.agg(F.count(F.lit(1)).alias("units"), F.countDistinct("file_path").alias("files")).withColumn("vector_bytes", F.col("units") * WORDS * 8)

    def reindex(self, files: DataFrame | None = None) -> DataFrame:
        """Scan again and rebuild; deleted files go."""
        self._index(sources.scan_tree(self.spark, self.root) if files is None else files)
        return self.status()

    def refresh(self, files: DataFrame | None = None) -> DataFrame:
        """Scan again and replace the units of files that are new or changed since, by modification time; deleted files go. The index stays so."""
        now = materialize(sources.scan_tree(self.spark, self.root) if files is None else files, "engine-files")
        touched, gone = refresh.changed_files(now, self.files), refresh.deleted_files(now, self.files)
        old = self.units.drop("unit_id")
        fresh = self.extract(touched).select(*old.columns)
        self._set_units(refresh.replace_by_file(old, fresh, touched, gone))
        self.files = now
        return self.status()

    def ast(self, files: list[str] | str | None = None, pattern: str | None = None, text: bool = False):
        chosen = self.files
        names = [files] if isinstance(files, str) else files
        if names or pattern:
            test = F.lit(False)
            if names:
                test = test | F.col("file_path").isin(names)
            if pattern:
                test = test | sources.glob_match(F.col("file_path"), pattern)
            chosen = chosen.where(test)
        nodes = outline.outline(chosen)
        if not text:
            return nodes
        # rendered by plan, a row for each file
        shown = render.outline_table(nodes).orderBy("file_path", "lang").collect()
        body = "".join(r["text"] for r in shown)
        alone = isinstance(files, str) and not pattern
        return body if alone else render.project_head(self.root, len(shown), sum(r["n"] for r in shown)) + body

    def refs(self, symbol: str, text: bool = False):
        defs = graph.definitions(self.units).where(F.col("name") == symbol)
        found = graph.references_to(self.references, symbol)
        if not text:
            return defs, found
        return render.refs(defs.orderBy("file_path", "line_number").collect(), found.orderBy("file_path", "line_number").collect())

    def impact(self, symbol: str, max_depth: int = MAX_DEPTH, text: bool = False):
        found = graph.impact(graph.definitions(self.units), self.references, symbol, whole(max_depth, MAX_DEPTH, 10))
        return render.impact(symbol, found.orderBy("depth", "file_path", "line_number").collect()) if text else found

    def context(self, symbol: str, text: bool = False):
        found = graph.context(self.units, symbol)
        return render.context(found.orderBy("section", "file_path", "line_number").collect()) if text else found

    def changes(self, target: str = TARGET, diff: DataFrame | None = None, text: bool = False):
        hunks = changes.parse_hunks(changes.git_diff(self.spark, self.root, target) if diff is None else diff)
        found = changes.touched(hunks, self.units)
        return render.changes(found.orderBy("file_path", "line_number").collect()) if text else found

    def clusters(self, threshold: float = THRESHOLD, min_size: int = MIN_SIZE, text: bool = False, exact: bool = True):
        """Clusters with label and size, their units by distance from the centroid, and how many units are in none.

        Pairs are compared exactly by default; ``exact=False`` samples bits first, for high thresholds.
        """
        widest, size = widest_distance(number(threshold, THRESHOLD)), whole(min_size, MIN_SIZE)
        pairs = (clusters.similar_pairs if exact else clusters.near_pairs)(self.vectors, widest)
        labelled = materialize(clusters.connected(self.vectors.select("unit_id"), pairs), "engine-labels")
        members = materialize(clusters.number_clusters(labelled, size), "engine-clusters")
        named = clusters.labels(members.join(self.units.select("unit_id", "name"), "unit_id"))
        heads = members.select("cluster_id", "size").distinct().join(named, "cluster_id").orderBy("cluster_id")
        placed = clusters.to_centroid(members, self.vectors).join(self.units, "unit_id").orderBy("cluster_id", "distance", "unit_id")
        found = Clusters(heads, placed, clusters.unclustered(labelled, size))
        return render.clusters(heads.collect(), placed.collect()) if text else found
