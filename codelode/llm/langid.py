"""Language identification with a bit-sliced Bloom filter of character n-grams.

Row p of the filter has a bit for each language, in as many 64-bit words as there are languages
for, so that the AND of an n-gram's rows is the set of all languages whose filter holds it. A
text's hits are counted by language, corrected for each filter's false positive rate, and the
largest count decides.

Training reads a bounded sample: about ``sample`` rows of each language, picked by hash of
doc_id, or all rows where ``sample`` is None, as ``in_known_language`` has it, and keeps at most
``keep`` n-grams of each. No language is left out; the model has 256 KB
for up to 8 of them and 2 MB for each 64 beyond.

Odd cases: a null text or one without a letter is ``und`` with score 0; without any hit the
most frequent language is given with score 0; null langs aren't learnt; an empty training
table makes everything ``und``; texts of any length are read whole, in blocks; rows that repeat
are judged each, and learnt from each where their doc_id is in the sample; extra columns stay,
but for ``lang_pred``, ``score`` and ``_p``, which ``identify`` replaces or drops.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codelode.llm.common import map_arrow, materialize, ready
from codelode.llm.grams import U64, char_runs, folded

SIZES, SLOT_BITS, PROBES = (3, 4), 18, 3
BLOCK = 1 << 16
#: n-grams that a task holds before it counts them; steps of a text's known share where medians are taken.
HELD, STEPS = 1 << 21, 10_000


def _grams(text: str | None):
    """Hashes of a text's n-grams, block by block; a space stands before and after the text."""
    chars, _ = folded(text, digits=False)
    chars = np.concatenate(([np.uint32(32)], chars, [np.uint32(32)]))
    for at in range(0, len(chars), BLOCK):
        part = chars[at : at + BLOCK + max(SIZES) - 1]
        for q in SIZES:
            own = part[: BLOCK + q - 1]
            yield char_runs(own, q) ^ U64(q)


def _slots(grams: np.ndarray):
    for j in range(PROBES):
        yield ((grams >> U64(j * 20)) & U64((1 << SLOT_BITS) - 1)).astype(np.int64)


@dataclass
class Model:
    langs: list[str]
    rows: np.ndarray  # languages of each slot: bits of a byte, or of a row of 64-bit words
    wrong: np.ndarray  # false positive rate of each language's filter

    def hits(self, text: str | None) -> tuple[np.ndarray, int]:
        """Corrected count of n-grams by language, and the number of n-grams."""
        found, total = np.zeros(len(self.langs)), 0
        for grams in _grams(text):
            mask = None
            for slot in _slots(grams):
                mask = self.rows[slot] if mask is None else mask & self.rows[slot]
            total += len(grams)
            if mask.ndim == 1:
                of = np.bincount(mask, minlength=256)
                found += [of[_MEMBERS[b]].sum() for b in range(len(self.langs))]
            else:
                for at in range(0, len(mask), 1 << 12):  # bits take eight times the room
                    bits = np.unpackbits(mask[at : at + (1 << 12)].view(np.uint8), axis=1, bitorder="little")
                    found += bits.sum(axis=0, dtype=np.int64)[: len(self.langs)]
        return np.maximum(0, (found - total * self.wrong) / (1 - self.wrong)), total

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """The language, its share among the hits of all, and the share of the text's n-grams that it knows."""
        if not self.langs or text is None or not has_letter(text):
            return "und", 0.0, 0.0
        found, total = self.hits(text)
        whole, best = found.sum(), int(found.argmax())
        return self.langs[best], float(found[best] / whole) if whole > 0 else 0.0, float(found[best] / total)

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.judge(text)[:2]


_MEMBERS = [np.flatnonzero((np.arange(256) >> b) & 1) for b in range(8)]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def build(langs: list[str], grams: dict[str, np.ndarray]) -> Model:
    """Filters of the n-grams of each language."""
    if len(langs) <= 8:
        rows = np.zeros(1 << SLOT_BITS, np.uint8)
    else:
        rows = np.zeros((1 << SLOT_BITS, -(-len(langs) // 64)), np.uint64)
    for b, lang in enumerate(langs):
        column, bit = (rows, np.uint8(1 << b)) if rows.ndim == 1 else (rows[:, b // 64], U64(1) << U64(b % 64))
        for slot in _slots(grams[lang]):
            column[np.unique(slot)] |= bit
    bits = np.unpackbits(rows.view(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")
    return Model(langs, rows, bits.mean(axis=0)[: len(langs)] ** PROBES)


def _tally(held: dict[str, list[np.ndarray]]) -> pa.RecordBatch:
    parts = [(lang, *np.unique(np.concatenate(grams), return_counts=True)) for lang, grams in held.items()]
    columns = [[pa.repeat(pa.scalar(k, pa.string()), len(v)) for k, v, _ in parts], [pa.array(v.view(np.int64)) for _, v, _ in parts], [pa.array(n, pa.int64()) for _, _, n in parts]]
    return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], ["lang", "gram", "n"])


def _counted(batches):
    """n-gram counts by language, given out whenever HELD n-grams are held, so that a task's memory is bounded."""
    held: dict[str, list[np.ndarray]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for grams in _grams(text):
                held.setdefault(lang, []).append(grams)
                size += len(grams)
                if size >= HELD:
                    yield _tally(held)
                    held, size = {}, 0
    if held:
        yield _tally(held)


def _sampled(docs: DataFrame, doc_id="doc_id", text="text", lang="lang", sample: int | None = 600) -> tuple[list[tuple[str, int]], DataFrame | None]:
    """The languages with their counts, and (lang, text) of about ``sample`` rows of each, or of all."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.crc32(F.concat(F.lit("langid:"), F.col(doc_id).cast("string"))).alias("h"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    sizes = [(r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").collect()]
    if not sizes:
        return [], None
    if sample is None:
        return sizes, rows.select("lang", "text")
    rate = F.element_at(F.create_map(*(x for k, n in sizes for x in (F.lit(k), F.lit(min(1.0, sample / n))))), F.col("lang"))
    return sizes, rows.where(F.col("h") < rate * 2.0**32).select("lang", "text")


def train(docs: DataFrame, doc_id="doc_id", text="text", lang="lang", sample: int | None = 600, keep: int = 6000, least: int = 3, share: float = 0.4) -> Model:
    """Learn from ``docs``, all of them where ``sample`` is None: an n-gram joins a language's filter if ``share`` of its frequency over all languages is there."""
    sizes, chosen = _sampled(docs, doc_id, text, lang, sample)
    if not sizes:
        return Model([], np.zeros(1 << SLOT_BITS, np.uint8), np.zeros(0))
    grams = map_arrow(chosen, _counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = materialize(grams, "langid-grams")
    totals = grams.groupBy("lang").agg(F.sum("n").alias("total"))
    freq = grams.join(F.broadcast(totals), "lang").withColumn("f", F.col("n") / F.col("total"))
    apart = freq.groupBy("gram").agg(F.sum("f").alias("all_f"), F.collect_list(F.struct("lang", "n", "f")).alias("by"))
    fit = apart.select("gram", F.explode("by").alias("x")).where((F.col("x.n") >= least) & (F.col("x.f") >= share * F.col("all_f"))).select("gram", "x.lang", "x.f")
    # a limit by group that is applied on either side of the shuffle; the driver takes at most ``keep`` n-grams of each language
    best = fit.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("f"), "gram"))).where(F.col("rank") <= keep)
    top = best.select("lang", "gram").toPandas()
    own = {k: v.to_numpy(np.int64).view(U64) for k, v in top.groupby("lang")["gram"]}
    langs = [k for k, _ in sizes]
    return build(langs, {k: own.get(k, np.empty(0, U64)) for k in langs})


def predictor(model: Model):
    """A column function: text to struct(lang_pred, score, known)."""

    @F.arrow_udf("struct<lang_pred:string,score:double,known:double>")
    def predict(texts: pa.Array) -> pa.Array:
        got = [model.judge(t.as_py()) for t in texts]
        kinds = (pa.string(), pa.float64(), pa.float64())
        return pa.StructArray.from_arrays([pa.array([g[c] for g in got], k) for c, k in enumerate(kinds)], ["lang_pred", "score", "known"])

    return predict


def in_training(doc_id: str) -> Column:
    """Rows to learn from: crc32 of the id as text, modulo 4, isn't 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4, F.lit(0)) != 2


def identify(docs: DataFrame, train_on: DataFrame | None = None, **settings) -> DataFrame:
    """``docs`` with lang_pred and score, learnt from the training rows of ``train_on`` (``docs`` by default)."""
    source = docs if train_on is None else train_on
    ready(docs.sparkSession)
    model = train(source.where(in_training("doc_id")), **settings)
    return docs.drop("lang_pred", "score").withColumn("_p", predictor(model)(F.col("text"))).select("*", "_p.lang_pred", "_p.score").drop("_p")


def in_known_language(docs: DataFrame, part: float = 0.25, **settings) -> DataFrame:
    """The rows of ``docs`` of whose n-grams the winning language knows at least ``part`` of its usual share.

    All training rows are learnt from, unless ``sample`` says otherwise. The usual share is the
    median, in steps of 1/10,000, over all training rows that are given their own language. A text in
    another language has chance hits and a few shared words only, whatever its length.
    Texts are judged once, and written with their verdicts.
    """
    ready(docs.sparkSession)
    model = train(docs.where(in_training("doc_id")), **({"sample": None} | settings))
    judged = materialize(docs.withColumn("_p", predictor(model)(F.col("text"))), "langid-judged")
    own = judged.where(in_training("doc_id") & (F.col("_p.lang_pred") == F.col("lang")))
    own = own.groupBy("lang", F.floor(F.col("_p.known") * STEPS).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    usual = {r["lang"]: r["m"] / STEPS for r in own.groupBy("lang").agg(F.percentile("k", 0.5, F.col("n")).alias("m")).collect()}
    least = F.lit(0.0)
    for k, m in usual.items():
        least = F.when(F.col("_p.lang_pred") == k, F.lit(part * m)).otherwise(least)
    return judged.where((F.col("_p.lang_pred") != "und") & (F.col("_p.score") > 0) & (F.col("_p.known") >= least)).drop("_p")
