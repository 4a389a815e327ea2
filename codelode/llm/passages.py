"""Passages of at least 50 words that several documents share, by sparse suffix arrays.

Suffixes are kept only where a run of K words is the minimiser of its window, so that equal
passages keep suffixes at equal places. Runs that only one document has are dropped by a count
over the corpus. The others are sorted, with the words right and left of the place, and each is
compared with its neighbours from other documents: the match is extended right and left, and
counts from ``min_words`` words on. A long passage is covered by the matches around each of its
minimisers. The sort is a range partitioning by the whole content, so that a run that very many
documents have is spread over tasks; the edges of the partitions are sorted and compared in the
same way, in as many levels as it takes until one task's share of rows is left.
Where suffixes beyond the neighbours looked at have the run too, the stretches of ``min_words``
words around the place that they could share are counted over the corpus by hash, so that the
number of neighbours is no cap.

Odd cases: null, empty and short texts have no passage; a repeat inside one document only isn't
one; rows that share a doc_id are one document, repeated rows too; a null doc_id is left out; a
text of any length is read whole; an empty table gives no rows; extra columns are ignored.
Documents without a passage have no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codelode.llm.common import map_arrow, materialize, parts_of
from codelode.llm.grams import U64, mix, runs, words

#: Words in a run; neighbours looked at on each side; rows of a partition where edges are compared.
K, HOPS, EDGES = 16, 8, 8192
FOUND = "doc_id long, s long, e long, edge boolean, window long, lo long, hi long, right binary, left binary, at long"


def minimisers(w: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, run hashes) of the least run of each window of min_words words, the first where tied."""
    g = runs(w, K)
    width = min_words - K + 1
    if len(g) < width:
        return np.empty(0, np.int64), g[:0]
    least = np.lib.stride_tricks.sliding_window_view(g, width).argmin(axis=1) + np.arange(len(g) - width + 1)
    at = least[np.concatenate(([True], least[1:] != least[:-1]))]
    return at, g[at]


def _places(min_words: int):
    def places(batches):
        for batch in batches:
            ids, at, run = [], [], []
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                p, g = minimisers(words(text.as_py()), min_words)
                ids.append(np.full(len(p), i, np.int64))
                at.append(p)
                run.append(g.view(np.int64))
            none = np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *x])) for x in (ids, run, at)], ["doc_id", "run", "at"])

    return places


def _contexts(min_words: int):
    """The words right and left of each wanted place, left ones nearest first; 0 stands beyond an end."""

    def contexts(batches):
        for batch in batches:
            for i, text, at in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("places"), strict=True):
                w = (words(text.as_py()) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
                at = np.unique(np.array(at.as_py(), np.int64))
                at = at[at < len(w)]
                padded = np.concatenate((np.zeros(min_words, np.uint32), w, np.zeros(min_words, np.uint32)))
                windows = np.lib.stride_tricks.sliding_window_view(padded, min_words)
                for k in range(0, len(at), 4096):
                    own = at[k : k + 4096]
                    right = windows[own + min_words].astype(">u4").tobytes()
                    left = windows[own][:, ::-1][:, : min_words - K].astype(">u4").tobytes()
                    cut = lambda b, n: [b[x : x + n] for x in range(0, len(b), n)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), i, np.int64)), pa.array(own), pa.array(cut(right, 4 * min_words), pa.binary()), pa.array(cut(left, 4 * (min_words - K)), pa.binary())],
                        ["doc_id", "at", "right", "left"],
                    )

    return contexts


def _matrix(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), ">u4").reshape(-1, width).astype(np.uint32)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common start of each pair of rows; a 0 ends it."""
    same = (a == b) & (a != 0)
    return np.where(same.all(axis=1), a.shape[1], same.argmin(axis=1))


def _windows(right: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Hash of each stretch of as many words as ``right`` has that holds the run, by the words it takes from the left; 0 beyond an end of the text."""
    size, n = right.shape[1], left.shape[1] + 1
    whole = np.concatenate((left[:, ::-1], right), axis=1).astype(U64)
    total = np.zeros((len(whole), n), U64)
    for j, m in enumerate(mix(np.arange(1, size + 1, dtype=U64)) | U64(1)):
        total += whole[:, j : j + n] * m
    inside = (whole[:, :n] != 0) & (whole[:, size - 1 :] != 0)
    return np.where(inside, mix(total) | U64(1), U64(0))[:, ::-1]


def _compare(min_words: int, edges: bool, further: bool = False):
    """Over sorted suffixes: (s, e) of what each shares with its neighbours.

    With ``edges`` also the rows at either edge of the partition; with ``further`` the stretches
    of each suffix that one further off than HOPS could share: whose they are, and which are
    still in question.
    """

    def rest(doc, at, right, left, reach, most_r, most_l):
        h = _windows(right, left)
        taken = np.arange(h.shape[1])
        open_ = (h != 0) & (min_words - taken <= reach[:, None])
        row, o = np.nonzero(open_)
        key = h[row, o]
        order = np.lexsort((doc[row], key))
        if len(order):
            ks, ds = key[order], doc[row][order]
            start = np.flatnonzero(np.concatenate(([True], ks[1:] != ks[:-1])))
            end = np.append(start[1:], len(ks)) - 1
            yield _batch(window=ks[start].view(np.int64), lo=ds[start], hi=ds[end])
        ask = ~((o <= most_l[row]) & (min_words - o <= most_r[row]))
        row, o = row[ask], o[ask]
        yield _batch(doc_id=doc[row], s=at[row] - o, window=h[row, o].view(np.int64))

    def compare(batches):
        tail = None
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, at = batch.column("doc_id").to_numpy(), batch.column("at").to_numpy()
            rb, lb = batch.column("right").to_pylist(), batch.column("left").to_pylist()
            if edges and tail is None:
                yield _edge_rows(doc[:HOPS], at[:HOPS], rb[:HOPS], lb[:HOPS])
            seen = 0
            if tail is not None:
                seen = len(tail[0])
                doc, at, rb, lb = np.concatenate((tail[0], doc)), np.concatenate((tail[1], at)), tail[2] + rb, tail[3] + lb
            # places of one document in equal surroundings stand side by side and count as one
            new = np.array([True, *(doc[i] != doc[i - 1] or rb[i] != rb[i - 1] or lb[i] != lb[i - 1] for i in range(1, len(doc)))])
            of, first = np.cumsum(new) - 1, np.flatnonzero(new)
            d, right, left = doc[first], _matrix([rb[i] for i in first], min_words), _matrix([lb[i] for i in first], min_words - K)
            most_r, most_l = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
            for hop in range(1, min(HOPS, len(first) - 1) + 1):
                other = np.flatnonzero(d[:-hop] != d[hop:])
                r, l = _common(right[other], right[other + hop]), _common(left[other], left[other + hop])
                good = r + l >= min_words
                for side in (other[good], other[good] + hop):
                    np.maximum.at(most_r, side, r[good])
                    np.maximum.at(most_l, side, l[good])
            r, l = most_r[of], most_l[of]
            hit = np.flatnonzero(r > 0)
            yield _batch(doc_id=doc[hit], s=at[hit] - l[hit], e=at[hit] + r[hit])
            if further:
                # no suffix beyond the last neighbour on a side shares more than it does; beyond the partition any may
                reach = np.full(len(first), min_words)
                if len(first) > 2 * HOPS:
                    far = _common(right[:-HOPS], right[HOPS:])
                    reach[HOPS:-HOPS] = np.maximum(far[HOPS:], far[:-HOPS])
                waits = of >= len(first) - HOPS
                now = np.flatnonzero(np.where(waits, ~new, of >= max(0, seen - HOPS)))
                now = now[np.where(waits[now], min_words, reach[of[now]]) >= K]
                for k in range(0, len(now), 4096):
                    x = now[k : k + 4096]
                    g = of[x]
                    yield from rest(doc[x], at[x], right[g], left[g], np.where(waits[x], min_words, reach[g]), most_r[g], most_l[g])
            keep = first[-2 * HOPS :]
            tail = (doc[keep], at[keep], [rb[i] for i in keep], [lb[i] for i in keep])
        if edges and tail is not None:
            doc, at, rb, lb = (x[-HOPS:] for x in tail)
            yield _edge_rows(doc, at, rb, lb)
        if further and tail is not None:
            doc, at, rb, lb = (x[-HOPS:] for x in tail)
            none = np.zeros(len(doc), np.int64)
            yield from rest(doc, at, _matrix(rb, min_words), _matrix(lb, min_words - K), none + min_words, none, none)

    return compare


def _batch(edge: bool = False, **columns):
    """A batch of FOUND; columns that aren't given are null."""
    n = len(next(iter(columns.values())))
    made = [pa.array([edge] * n, pa.bool_()) if f.name == "edge" else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in FOUND_ARROW]
    return pa.RecordBatch.from_arrays(made, schema=FOUND_ARROW)


def _edge_rows(doc, at, right, left):
    return _batch(True, doc_id=doc, at=at, right=right, left=left)


FOUND_ARROW = pa.schema([(name, {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[kind]) for name, kind in (x.split() for x in FOUND.split(", "))])
ORDER = ["right", "left", "doc_id", "at"]


def repeated_passages(docs: DataFrame, doc_id="doc_id", text="text", min_words: int = 50) -> DataFrame:
    """(doc_id, start_word, end_word, n_words): the merged stretches that a document shares with others."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    places = materialize(map_arrow(rows, _places(min_words), "doc_id long, run long, at long"), "passage-places")
    shared = places.groupBy(F.bitwise_not("run").alias("nr")).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    # every join here is of tables that grow with the texts, and Spark sizes what is read of a written table by the widths of types: never by broadcast
    kept = places.join(shared.select(F.bitwise_not("nr").alias("run")).hint("merge"), "run", "left_semi")
    wanted = kept.groupBy("doc_id").agg(F.collect_set("at").alias("places"))
    context = map_arrow(rows.join(wanted.hint("merge"), "doc_id"), _contexts(min_words), "doc_id long, at long, right binary, left binary")
    context = materialize(context, "passage-suffixes")
    ordered = context.repartitionByRange(parts_of(docs.sparkSession), *ORDER).sortWithinPartitions(*ORDER)
    found = materialize(map_arrow(ordered, _compare(min_words, True, True), FOUND), "passage-matches")
    spans = found.where("e is not null").select("doc_id", "s", "e")
    # what stands at the edges is compared across them: 2 * HOPS rows of each partition, then of each partition of those
    edges = materialize(found.where("edge").select(*ORDER).distinct(), "passage-edges")
    while (n := edges.count()) > EDGES:
        ordered = edges.repartitionByRange(-(-n // (EDGES // 2)), *ORDER).sortWithinPartitions(*ORDER)
        level = materialize(map_arrow(ordered, _compare(min_words, True), FOUND), "passage-matches")
        spans = spans.unionByName(level.where("e is not null").select("doc_id", "s", "e"))
        edges = materialize(level.where("edge").select(*ORDER).distinct(), "passage-edges")
    across = map_arrow(edges.coalesce(1).sortWithinPartitions(*ORDER), _compare(min_words, False), FOUND)
    # exactly, what lies further off than the neighbours looked at: equal stretches of min_words words of several documents
    owners = found.where("lo is not null").groupBy(F.bitwise_not("window").alias("nw")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi")
    asked = found.where("window is not null and lo is null").select("doc_id", "s", "window")
    further = asked.join(owners.select(F.bitwise_not("nw").alias("window")).hint("merge"), "window").select("doc_id", "s", (F.col("s") + min_words).alias("e"))
    spans = spans.unionByName(across.select("doc_id", "s", "e")).unionByName(further)
    by_start = Window.partitionBy("doc_id").orderBy("s", "e")
    reach = F.max("e").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("s") <= F.col("reach"), 0).otherwise(1)).over(by_start.rowsBetween(Window.unboundedPreceding, 0))
    merged = spans.withColumn("reach", reach).withColumn("island", island).groupBy("doc_id", "island").agg(F.min("s").alias("start_word"), F.max("e").alias("end_word"))
    return merged.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))
