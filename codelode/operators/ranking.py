"""BM25 over a postings table, exact nearest vectors and reciprocal rank fusion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codelode.functions.hypervectors import distance, similarity
from codelode.functions.tables import materialize, parts_of
from codelode.functions.text import search_term, search_tokens

K1, B, FUSION_K = 1.2, 0.75, 60


def document_text(name="name", module="module_name", signature="signature") -> Column:
    return F.concat_ws(" ", name, module, signature)


def postings(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """(doc_id, term, tf, dl).

    Texts are dealt out by document before the tokeniser, as a few large files leave it little
    to share, and that one shuffle also brings the tokens of a document together for the count.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_x")).repartition(parts_of(docs.sparkSession), "doc_id")
    tokens = rows.select("doc_id", search_tokens(F.col("_x")).alias("_t")).withColumn("dl", F.size("_t").cast("long"))
    # an inner explode would be given a filter on the size of its array, and so run the tokeniser once more, before the texts are dealt out
    terms = tokens.select("doc_id", "dl", F.explode_outer("_t").alias("term")).where("term is not null").withColumn("term", search_term(F.col("term")))
    return terms.groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf")).select("doc_id", "term", "tf", "dl")


def document_frequency(terms: DataFrame) -> DataFrame:
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df_n"))


def corpus_stats(docs: DataFrame, text="text") -> DataFrame:
    """One row: n_docs, total_dl, avgdl."""
    return corpus_totals(docs, text).withColumn("avgdl", F.col("total_dl") / F.when(F.col("n_docs") > 0, F.col("n_docs")))


def corpus_totals(docs: DataFrame, text="text") -> DataFrame:
    """One row: n_docs, total_dl; documents without a token count as well."""
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_x")).repartition(parts_of(docs.sparkSession))
    return rows.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum(F.size(search_tokens(F.col("_x")))), F.lit(0)).cast("long").alias("total_dl"))


@dataclass
class Postings:
    """A written index: postings sorted by term, so that a query reads the row groups of its terms only, and the corpus totals."""

    terms: DataFrame
    n_docs: int
    total_dl: int

    @classmethod
    def build(cls, docs: DataFrame, doc_id="doc_id", text="text") -> Postings:
        """One pass of the tokeniser. Range partitions by term and id, so that a frequent term is spread over several."""
        spark = docs.sparkSession
        counted = materialize(postings(docs, doc_id, text), "postings-by-doc")
        own = counted.select("doc_id", "dl").distinct().agg(F.coalesce(F.sum("dl"), F.lit(0)).alias("t")).first()["t"]
        dealt = counted.repartitionByRange(parts_of(spark), "term", "doc_id").sortWithinPartitions("term", "doc_id")
        return cls(materialize(dealt, "postings"), docs.count(), int(own))

    def scores(self, query: str) -> DataFrame:
        """(doc_id, score) of documents that share a term with the query; a term repeated in the query counts as often."""
        weights = query_terms(self.terms.sparkSession, query)
        hits = self.terms.where(F.col("term").isin(list(weights)))
        # a row for each query term, by an aggregate of the same few row groups
        df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df_n"))
        repeats = F.create_map(*(x for t, n in weights.items() for x in (F.lit(t), F.lit(n)))) if weights else F.create_map(F.lit(""), F.lit(0))
        scored = hits.join(F.broadcast(df), "term")
        idf = F.log((self.n_docs - F.col("df_n") + 0.5) / (F.col("df_n") + 0.5) + 1)
        average = self.total_dl / max(1, self.n_docs)
        part = idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / average))
        return scored.groupBy("doc_id").agg(F.sum(part * repeats[F.col("term")]).alias("score"))


def query_terms(spark: SparkSession, query: str) -> dict[str, int]:
    """The terms of a query, with how often each is there."""
    row = spark.range(1).select(F.transform(search_tokens(F.lit(query)), search_term).alias("q")).first()
    weights: dict[str, int] = {}
    for t in row["q"]:
        weights[t] = weights.get(t, 0) + 1
    return weights


def bm25(docs: DataFrame, query: str, doc_id="doc_id", text="text") -> DataFrame:
    """(doc_id, score) for a single query over ``docs``; several queries go faster over one ``Postings``."""
    return Postings.build(docs, doc_id, text).scores(query)


def top(scores: DataFrame, k: int, by="score", key="doc_id", descending=True) -> DataFrame:
    """The best k rows, ties by key; a heap on each partition, then one merge of k rows each."""
    return scores.orderBy(F.col(by).desc() if descending else F.col(by).asc(), F.col(key)).limit(k)


def nearest(vectors: DataFrame, query: list[int], k: int, key="unit_id", vector="vector", positive=True) -> DataFrame:
    """(key, dist, similarity) of the k nearest vectors to one query vector, itself a literal in the plan."""
    d = distance(F.col(vector), F.array(*map(F.lit, query)))
    scored = vectors.select(F.col(key), d.alias("dist")).withColumn("similarity", similarity(F.col("dist")))
    if positive:
        scored = scored.where("similarity > 0")
    return scored.orderBy("dist", key).limit(k)


def ranked(results: DataFrame, by="score", key="doc_id", descending=True) -> DataFrame:
    """Adds rank 1, 2, ... to a short list."""
    return results.withColumn("rank", F.row_number().over(Window.orderBy(F.col(by).desc() if descending else F.col(by).asc(), F.col(key))))


def fuse(first: DataFrame, second: DataFrame, k: int, key="doc_id", constant: int = FUSION_K, names=("bm25_rank", "hdc_rank")) -> DataFrame:
    """Reciprocal rank fusion of two ranked short lists (key, rank): full outer join, sum of 1 / (constant + rank)."""
    both = first.select(key, F.col("rank").alias(names[0])).join(second.select(key, F.col("rank").alias(names[1])), key, "full_outer")
    share = lambda n: F.coalesce(1.0 / (constant + F.col(n)), F.lit(0.0))
    return top(both.withColumn("score", share(names[0]) + share(names[1])), k, key=key)
