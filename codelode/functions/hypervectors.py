"""Algebra of binary hypervectors: 157 words of 64 bits, of which 10,000 bits count.

Bind, distance and similarity are Column expressions; atoms and bundles, which need wrapping
64-bit arithmetic and bit counts by position, are Arrow functions.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions.shipping import ship
from codelode.functions.tables import materialize

WORDS, DIMENSION = 157, 10_000
# The step and the multipliers of the splitmix64 generator.
GAMMA, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
# Roles and the names of their atoms.
ROLES = {
    "name": "__role_name__", "params": "__role_params__", "returns": "__role_returns__", "calls": "__role_calls__", "module": "__role_module__", "fields": "__role_fields__", "kind": "__role_kind__",
    "imports": "__role_imports__", "file": "__role_filepath__",
}


def bind(a, b) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))


def distance(a, b) -> Column:
    """Number of bits that differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def similarity(d: Column) -> Column:
    return 1.0 - 2.0 * d / float(DIMENSION)


def widest_distance(threshold: float) -> int:
    """The largest distance whose similarity reaches the threshold, by the same arithmetic; -1 if none does."""
    d = min(64 * WORDS, max(0, int((1.0 - threshold) * DIMENSION / 2) + 2))
    while d >= 0 and 1.0 - 2.0 * d / DIMENSION < threshold:
        d -= 1
    return d


def permute(v, n: int) -> Column:
    """Circular shift by ``n`` bits over all words, upwards."""
    words, bits = divmod(n % (64 * WORDS), 64)
    v = F.col(v) if isinstance(v, str) else v
    at = lambda i: F.get(v, F.pmod(i - words, F.lit(WORDS)).cast("int"))
    low = lambda i: F.shiftrightunsigned(at(i - 1), 64 - bits)
    return F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: F.shiftleft(at(i), bits).bitwiseOR(low(i)) if bits else at(i))


def is_zero(v) -> Column:
    return F.forall(v, lambda x: x == 0)


def expand(seeds: np.ndarray) -> np.ndarray:
    """Vectors of 64-bit seeds by splitmix64, one row each."""
    steps = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(GAMMA)
    z = seeds.astype(np.uint64)[:, None] + steps[None, :]
    z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_A)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_B)
    return z ^ (z >> np.uint64(31))


def majority(vectors: np.ndarray) -> np.ndarray:
    """Per bit majority, ties to 0; one vector stays as it is, none gives zeros."""
    if len(vectors) == 0:
        return np.zeros(WORDS, np.uint64)
    if len(vectors) == 1:
        return vectors[0]
    bits = np.unpackbits(np.ascontiguousarray(vectors).view(np.uint8).reshape(len(vectors), -1), axis=1, bitorder="little")
    won = 2 * bits.sum(axis=0, dtype=np.int64) > len(vectors)
    won[DIMENSION:] = False
    return np.packbits(won, bitorder="little").view(np.uint64)


def _from_seed(seeds: pa.Array) -> pa.Array:
    v = expand(seeds.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)).view(np.int64)
    return pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * WORDS, v.ravel())


def from_seed(seed: Column) -> Column:
    """The vector of a 64-bit seed."""
    return F.arrow_udf(_from_seed, "array<bigint>")(seed)


def atom_seed(name) -> Column:
    """The seed of a token's vector: 60 bits of its MD5, which every engine has."""
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def seed_of(name: str) -> int:
    """The same on the driver."""
    return int(hashlib.md5(name.encode(), usedforsecurity=False).hexdigest()[:15], 16)


@cache
def role_words(role: str) -> tuple[int, ...]:
    """The fixed vector of a role."""
    return tuple(expand(np.array([seed_of(ROLES[role])], np.uint64))[0].view(np.int64).tolist())


def role_vector(role) -> Column:
    chosen = F.lit(None).cast("array<bigint>")
    for r in ROLES:
        chosen = F.when(F.col(role) == r, F.array(*map(F.lit, role_words(r)))).otherwise(chosen)
    return chosen


def encoded(parts) -> Column:
    """The majority vector of an array of (role, seed): each seed is expanded, bound to its role's vector, and counted, all in one row."""
    roles = {r: np.array(role_words(r), np.int64).view(np.uint64) for r in ROLES}

    def encode(rows: pa.Array) -> pa.Array:
        out = []
        for own in rows.to_pylist():
            own = own or []
            v = expand(np.array([p["seed"] for p in own], np.int64).view(np.uint64))
            for k, p in enumerate(own):
                if p["role"] is not None:
                    v[k] ^= roles[p["role"]]
            out.append(majority(v).view(np.int64))
        return pa.ListArray.from_arrays(np.arange(len(out) + 1, dtype=np.int32) * WORDS, np.concatenate([np.empty(0, np.int64), *out]))

    return F.arrow_udf(encode, "array<bigint>")(parts)


def bundle(vectors: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """Majority vector of each key.

    A partition's share of a group goes to the next step as the vectors themselves while they
    take less room than counters, else as counters by bit. Large shares are merged by a salted
    key first. So no task gathers the vectors of a large group, and a small one costs no more
    than its vectors.
    """
    spark = vectors.sparkSession
    ship(spark)
    typed = vectors.select(F.col(key).alias("k"), F.col(vector).alias("v"))
    kind = dict(typed.dtypes)["k"]
    row = f"k {kind}, n bigint, raw boolean, data binary"

    def partial(batches):
        held: dict = {}
        size, arrow = 0, None
        for batch in batches:
            arrow = batch.schema.field("k").type
            m = np.array(batch.column("v").flatten().to_numpy(zero_copy_only=False), np.int64).reshape(-1, WORDS)
            for k, own in _groups(batch.column("k").to_pylist()).items():
                before = held.get(k)
                held[k] = _Share(m[own]) if before is None else before.add(m[own])
                size += held[k].size() - (before.size() if before is not None else 0)
            if size >= 64 << 20:
                yield _shares(held, arrow)
                held, size = {}, 0
        if held:
            yield _shares(held, arrow)

    def merged(table) -> _Share:
        share = None
        for raw, n, data in zip(table.column("raw").to_pylist(), table.column("n").to_pylist(), table.column("data").to_pylist(), strict=True):
            own = _Share.read(raw, n, data)
            share = own if share is None else share.merge(own)
        return share

    def merge(k, table):
        return pa.Table.from_batches([_shares({k[0].as_py(): merged(table)}, table.schema.field("k").type)])

    def finish(k, table):
        v = merged(table).majority().view(np.int64)
        return pa.table({"k": pa.array([k[0].as_py()], table.schema.field("k").type), "vector": pa.array([v.tolist()], pa.list_(pa.int64()))})

    # written, as both branches below read it
    parts = materialize(typed.mapInArrow(partial, row).withColumn("salt", F.spark_partition_id() % SALTS), "bundle")
    large = parts.where("not raw").groupBy("k", "salt").applyInArrow(merge, row)
    shares = large.unionByName(parts.where("raw").drop("salt"))
    return shares.groupBy("k").applyInArrow(finish, f"k {kind}, vector array<bigint>").withColumnRenamed("k", key)


#: Vectors that take as much room as counters of 32 bits, and salts of a large group.
MANY, SALTS = 32, 64


class _Share:
    """A part of a group: up to MANY vectors, or how many there were and how many of them have each bit."""

    def __init__(self, vectors: np.ndarray | None, n: int = 0, counts: np.ndarray | None = None):
        self.vectors, self.n, self.counts = vectors, n if vectors is None else len(vectors), counts
        if vectors is not None and len(vectors) > MANY:
            self.vectors, self.counts = None, _bits(vectors)

    def size(self) -> int:
        return 8 * WORDS * self.n if self.vectors is not None else 8 * 64 * WORDS

    def merge(self, other: _Share) -> _Share:
        if self.vectors is not None and other.vectors is not None:
            return _Share(np.concatenate((self.vectors, other.vectors)))
        return _Share(None, self.n + other.n, self.counted() + other.counted())

    def add(self, vectors: np.ndarray) -> _Share:
        return self.merge(_Share(vectors))

    def counted(self) -> np.ndarray:
        return _bits(self.vectors) if self.counts is None else self.counts

    def majority(self) -> np.ndarray:
        if self.vectors is not None:
            return majority(self.vectors.view(np.uint64))
        won = 2 * self.counts > self.n
        won[DIMENSION:] = False
        return np.packbits(won, bitorder="little").view(np.uint64)

    def data(self) -> bytes:
        return (self.vectors if self.vectors is not None else self.counts.astype(np.int32 if self.n < 1 << 31 else np.int64)).tobytes()

    @classmethod
    def read(cls, raw: bool, n: int, data: bytes) -> _Share:
        if raw:
            return cls(np.frombuffer(data, np.int64).reshape(-1, WORDS))
        return cls(None, n, np.frombuffer(data, np.int32 if n < 1 << 31 else np.int64).astype(np.int64))


def _bits(vectors: np.ndarray) -> np.ndarray:
    """How many of the vectors have each bit; in blocks, as bits take eight times the room."""
    out = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(vectors), 1024):
        part = np.ascontiguousarray(vectors[at : at + 1024]).view(np.uint8).reshape(-1, 8 * WORDS)
        out += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return out


def _groups(keys: list) -> dict:
    found: dict = {}
    for i, k in enumerate(keys):
        found.setdefault(k, []).append(i)
    return found


def _shares(shares: dict, kind: pa.DataType) -> pa.RecordBatch:
    own = list(shares.values())
    return pa.RecordBatch.from_arrays([pa.array(list(shares), kind), pa.array([s.n for s in own], pa.int64()), pa.array([s.vectors is not None for s in own], pa.bool_()), pa.array([s.data() for s in own], pa.binary())], ["k", "n", "raw", "data"])
