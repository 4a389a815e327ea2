"""Benchmark decontamination by q-gram lemma filtering.

Benchmark items are folded (lower case, all but letters and digits as single spaces) and cut
into overlapping probes at two scales: long ones, for items that are edited unevenly, and short
ones, of which any contiguous excerpt of 83 characters (56 + 28 - 1) holds one whole. A stretch
of a document within k edits of a probe of m characters shares at least m + 1 - q (k + 1) of its
q-grams, in a diagonal band as wide as k. So shared q-grams are counted in overlapping bands,
regions that meet the bound are kept, and a banded alignment confirms them. k is ``rate`` of m,
rounded down, at every m; q is 8, and 5 for probes so short that 8 would leave no bound. Items
below 24 characters are looked for exactly, as whole words.

The benchmark is a query set that is held by every task: its size is counted, and beyond
``block_chars`` it is worked through in blocks, each against all documents. A block is a
broadcast variable, and a worker builds its index once.

Odd cases: null and empty texts, items without a letter or digit and null ids on either side
match nothing; documents of any length are searched whole, hits in pieces of bounded size; rows
that share an id, repeated rows among them, are one; an empty table gives no rows; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

import re
import uuid
from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.common import map_arrow
from codelode.llm.grams import U64, char_runs, folded

#: Characters of a gram for probes of ``SHORT[0]`` characters and more, and for shorter ones.
Q, SHORT_Q = 8, 5
RATE, PROBE, STRIDE, MIN_CHARS = 0.1, 160, 80, 24
LONG, SHORT = (PROBE, STRIDE), (56, 28)
FILTER_BITS = 22
#: Places of shared grams that are counted at a time.
HITS = 1 << 20


@dataclass
class Probes:
    """Probes of a block of items with grams of one size, and the places of their q-grams by hash."""

    q: int
    item: list[int]
    chars: list[np.ndarray]
    budget: np.ndarray  # edits allowed
    need: np.ndarray  # shared q-grams that the budget implies
    grams: np.ndarray  # sorted, distinct
    begin: np.ndarray  # of each gram in ``probe`` and ``place``
    probe: np.ndarray
    place: np.ndarray
    maybe: np.ndarray  # bit filter over the top bits of a hash


@dataclass
class Index:
    """What documents are searched with: probes by size of their grams; short items by their text, and how many words these have."""

    probes: list[Probes]
    exact: dict[str, list[int]]
    lengths: list[int]


def stripped(text: str) -> np.ndarray:
    c, _ = folded(text, digits=True)
    c = c[1:] if len(c) and c[0] == 32 else c
    return c[:-1] if len(c) and c[-1] == 32 else c


def cuts(c: np.ndarray, scales) -> list[tuple[int, int]]:
    """(start, end) of the probes of each (length, stride); an item of at most that length is a probe of its own."""
    out = {}
    for size, stride in scales:
        starts = [0] if len(c) <= size else sorted({*range(0, len(c) - size, stride), len(c) - size})
        out |= dict.fromkeys((at, min(len(c), at + size)) for at in starts)
    return list(out)


def probes(items: list[tuple[int, str]], rate: float = RATE, scales=(LONG,), q: int | None = None) -> Probes:
    """The probes of ``items``; those with grams of ``q`` characters only, if given."""
    ids, chars = [], []
    for item, text in items:
        c = stripped(text)
        if len(c) >= MIN_CHARS:
            for at, end in cuts(c, scales):
                if q is None or q == (Q if end - at >= SHORT[0] else SHORT_Q):
                    ids.append(item)
                    chars.append(c[at:end])
    q = q or Q
    sizes = np.array([len(c) for c in chars], np.int64)
    budget = np.floor(rate * sizes + 1e-9).astype(np.int64)
    need = np.maximum(1, sizes + 1 - q * (budget + 1))
    grams = [char_runs(c, q) for c in chars]
    every = np.concatenate([np.empty(0, U64), *grams])
    probe = np.repeat(np.arange(len(chars)), [len(g) for g in grams])
    place = np.concatenate([np.empty(0, np.int64), *(np.arange(len(g)) for g in grams)])
    order = np.argsort(every, kind="stable")
    distinct, begin = np.unique(every[order], return_index=True)
    maybe = np.zeros(1 << FILTER_BITS, bool)
    maybe[(distinct >> U64(64 - FILTER_BITS)).astype(np.int64)] = True
    return Probes(q, ids, chars, budget, need, distinct, np.append(begin, len(every)), probe[order], place[order].astype(np.int64), maybe)


def index_of(items: list[tuple[int, str]], rate: float = RATE, scales=(LONG, SHORT)) -> Index:
    found = [p for q in (Q, SHORT_Q) if (p := probes(items, rate, scales, q)).item]
    exact: dict[str, list[int]] = {}
    for item, text in items:
        c = stripped(text)
        if 0 < len(c) < MIN_CHARS:
            exact.setdefault(as_text(c), []).append(item)
    return Index(found, exact, sorted({x.count(" ") + 1 for x in exact}))


def as_text(chars: np.ndarray) -> str:
    return chars.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def short_items(index: Index, chars: np.ndarray):
    """(item, start, end) of each short item that stands in folded characters as whole words."""
    text = as_text(chars)
    places = [m.span() for m in re.finditer("[^ ]+", text)]
    for n in index.lengths:
        for (start, _), (_, end) in zip(places, places[n - 1 :], strict=False):
            for item in index.exact.get(text[start:end], ()):
                yield item, start, end


def regions(p: Probes, chars: np.ndarray):
    """(probe, least diagonal, width) of the bands with enough shared q-grams."""
    h = char_runs(chars, p.q)
    at = np.flatnonzero(p.maybe[(h >> U64(64 - FILTER_BITS)).astype(np.int64)])
    k = np.searchsorted(p.grams, h[at])
    hit = k < len(p.grams)
    hit[hit] = p.grams[k[hit]] == h[at][hit]
    at, k = at[hit], k[hit]
    if not len(at):
        return []
    places = p.begin[k + 1] - p.begin[k]
    keys, count = np.empty(0, np.int64), np.empty(0, np.int64)
    piece = np.cumsum(places) // HITS
    for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(piece)) + 1):
        n = places[part]
        rows = np.repeat(p.begin[k[part]] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        probe, diagonal = p.probe[rows], np.repeat(at[part], n) - p.place[rows] + PROBE
        # bands of twice the width start at every multiple of it, so that each stretch lies in one whole
        lower = diagonal // (2 * p.budget[probe] + 2)
        new, times = np.unique(np.concatenate((probe * (1 << 40) + lower, probe * (1 << 40) + np.maximum(lower - 1, 0))), return_counts=True)
        if not len(keys):
            keys, count = new, times
        else:  # a text with more hits than a piece holds
            both, of = np.unique(np.concatenate((keys, new)), return_inverse=True)
            keys, count = both, np.bincount(of, np.concatenate((count, times)), len(both)).astype(np.int64)
    which, band = keys >> 40, keys & ((1 << 40) - 1)
    good = count >= p.need[which]
    width = 2 * p.budget[which] + 2
    return list(zip(which[good].tolist(), (band * width - PROBE)[good].tolist(), (2 * width)[good].tolist(), strict=True))


def window(text: np.ndarray, low: int, size: int) -> np.ndarray:
    """``size`` characters from place ``low`` on, zeros outside the text."""
    out = np.zeros(size, np.uint32)
    part = text[max(0, low) : max(0, low + size)]
    out[max(0, -low) : max(0, -low) + len(part)] = part
    return out


def ends(own: np.ndarray, near: np.ndarray, budget: int) -> np.ndarray:
    """Per row: edits of the whole probe ``own``, by the diagonal of ``near`` it ends at; beyond all budgets where none is left."""
    n, m = own.shape
    width = near.shape[1] - m
    span, live = np.arange(width + 1, dtype=np.int32), np.arange(n)
    cost, out = np.zeros((n, width + 1), np.int32), np.full((n, width + 1), 1 << 20, np.int32)
    for j in range(m):
        # cost[b]: of the probe so far, ending at diagonal b; beyond the text nothing is equal
        step = cost + (near[:, j : j + width + 1] != own[:, j : j + 1])
        np.minimum(step[:, :-1], cost[:, 1:] + 1, out=step[:, :-1])
        cost = np.minimum.accumulate(step - span, axis=1) + span
        if j % 4 == 3:
            good = cost.min(axis=1) <= budget
            if not good.all():
                live, cost, own, near = live[good], cost[good], own[good], near[good]
            if not len(live):
                break
    out[live] = cost
    return out


def align(p: Probes, wanted: list[tuple[np.ndarray, int, int, int]], block: int = 1024) -> list[tuple[int, int, int] | None]:
    """(edits, start, end) of the best alignment of each whole probe in (text, probe, least diagonal, width), or None; probes of a size at once."""
    out: list = [None] * len(wanted)
    sizes: dict[int, list[int]] = {}
    for i, (_, which, _, _) in enumerate(wanted):
        sizes.setdefault(len(p.chars[which]), []).append(i)
    for m, mine in sizes.items():
        budget = int(p.budget[wanted[mine[0]][1]])
        for at in range(0, len(mine), block):
            part = mine[at : at + block]
            own = np.stack([p.chars[wanted[i][1]] for i in part])
            forth = ends(own, np.stack([window(t, low, width + m) for t, _, low, width in (wanted[i] for i in part)]), budget)
            best = forth.argmin(axis=1)
            edits = forth[np.arange(len(part)), best]
            good = np.flatnonzero(edits <= budget)
            if not len(good):
                continue
            stop = [min(len(wanted[part[g]][0]), wanted[part[g]][2] + int(best[g]) + m) for g in good]
            # the same from behind gives the start
            behind = [window(wanted[part[g]][0][:e][::-1], -budget, 2 * budget + m) for g, e in zip(good, stop, strict=True)]
            back = ends(own[good][:, ::-1], np.stack(behind), budget).argmin(axis=1)
            for g, e, b in zip(good, stop, back, strict=True):
                out[part[g]] = (int(edits[g]), max(0, e - (m + int(b) - budget)), e)
    return out


def matches_of(index: Index, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
    """Per text (item, start, end, edits) of each confirmed region, as code points of the text."""
    folds = [folded(text, digits=True) for text in texts]
    found: list = [[] for _ in texts]
    if index.exact:
        for n, (chars, places) in enumerate(folds):
            found[n] += [(item, int(places[s]), int(places[e - 1]) + 1, 0) for item, s, e in short_items(index, chars)]
    for p in index.probes:
        tries, wanted = [], []
        for n, (chars, _) in enumerate(folds):
            whole = None
            for which, low, width in regions(p, chars):
                probe = p.chars[which]
                whole = chars.tobytes() if whole is None else whole
                at = whole.find(probe.tobytes(), 4 * max(0, low), 4 * (low + width + len(probe)) + 4)
                if at >= 0 and at % 4 == 0:
                    tries.append((n, which, (0, at // 4, at // 4 + len(probe))))
                else:
                    tries.append((n, which, len(wanted)))
                    wanted.append((chars, which, low, width))
        aligned, done = align(p, wanted), set()
        for n, which, got in tries:
            got = aligned[got] if isinstance(got, int) else got
            if got and (n, which, got[2]) not in done:
                done.add((n, which, got[2]))
                places = folds[n][1]
                found[n].append((p.item[which], int(places[got[1]]), int(places[got[2] - 1]) + 1, got[0]))
    return found


def in_parts(texts: list[str | None], chars: int = 500_000):
    """(first, last) of runs of texts of about so many characters."""
    first = size = 0
    for n, text in enumerate(texts):
        size += len(text or "")
        if size >= chars or n == len(texts) - 1:
            yield first, n + 1
            first, size = n + 1, 0


#: Indexes that this worker has built, by block.
_built: OrderedDict[str, Index] = OrderedDict()


def _search(block, name: str, rate: float):
    """``block``: a broadcast list of (item_id, text)."""

    def search(batches):
        if name not in _built:
            _built[name] = index_of(block.value, rate)
            while len(_built) > 2:
                _built.popitem(last=False)
        index = _built[name]
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            out = [(i, *m) for a, b in in_parts(texts) for i, found in zip(ids[a:b], matches_of(index, texts[a:b]), strict=True) for m in found]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(5)], ["doc_id", "item_id", "s", "e", "edits"])

    return search


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id="doc_id", text="text", item_id="item_id", item_text="text", rate: float = RATE, block_chars: int = 8_000_000) -> DataFrame:
    """(doc_id, item_id, start, end, probes, edits): where a document holds an item or a long part of it."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = int(size // block_chars) + 1
    found = None
    for b in range(blocks):
        own = [(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()]
        block = spark.sparkContext.broadcast(own)
        part = map_arrow(rows, _search(block, uuid.uuid4().hex, rate), "doc_id long, item_id long, s long, e long, edits long")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(F.min("s").alias("start"), F.max("e").alias("end"), F.count(F.lit(1)).alias("probes"), F.min("edits").alias("edits"))
