"""Hypervectors of code units and of queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions.hypervectors import atom_seed, bind, encoded, expand, from_seed, majority, role_vector, role_words, seed_of
from codelode.functions.shipping import ship
from codelode.functions.text import ascii_lower, split_identifier, vector_tokens

# Query words that name a kind.
KIND_WORDS = {**dict.fromkeys(("function", "fn", "def", "func"), "fn"), **dict.fromkeys(("type", "struct", "class", "interface", "enum"), "type"), **dict.fromkeys(("import", "require", "use"), "import")}


def parts() -> Column:
    """The components of a unit as an array of (role, token), a multiset; role null is a bare atom."""
    pair = lambda role, token: F.struct(F.lit(role).cast("string").alias("role"), token.alias("token"))
    each = lambda role, tokens: F.transform(tokens, lambda t: pair(role, t))
    return F.concat(
        F.array(pair("kind", F.col("kind")), pair("name", F.col("name")), pair("module", F.col("module_name"))),
        each("name", F.transform(split_identifier(F.col("name")), ascii_lower)),
        each("file", split_identifier(F.col("file_path"))),
        each(None, vector_tokens(F.col("signature"))),
    )


def components(units: DataFrame, key="unit_id") -> DataFrame:
    """(key, role, token), a row for each component."""
    return units.select(key, F.explode(parts()).alias("p")).select(key, "p.role", "p.token")


def atoms(tokens: DataFrame) -> DataFrame:
    """(role, token, vector): each distinct pair is expanded once."""
    ship(tokens.sparkSession)
    base = tokens.select("role", "token").distinct().withColumn("vector", from_seed(atom_seed("token")))
    return base.withColumn("vector", F.when(F.col("role").isNull(), F.col("vector")).otherwise(bind("vector", role_vector("role"))))


def encode_units(units: DataFrame, key="unit_id") -> DataFrame:
    """(key, vector): majority over a unit's components, in the unit's own row: a seed is expanded where it is needed, and no vector is shuffled."""
    ship(units.sparkSession)
    seeded = F.transform(parts(), lambda p: F.struct(p["role"].alias("role"), atom_seed(p["token"]).alias("seed")))
    return units.select(key, encoded(seeded).alias("vector"))


def encode_query(spark: SparkSession, text: str) -> list[int]:
    """The vector of a query, computed on the driver; a query without tokens gives zeros."""
    tokens = spark.range(1).select(vector_tokens(F.lit(text)).alias("t")).first()["t"]
    wanted = [(None, t) for t in tokens]
    for t in tokens:
        wanted += [("kind", KIND_WORDS[t])] if t in KIND_WORDS else [("name", t), ("module", t)]
    v = expand(np.array([seed_of(t) for _, t in wanted], np.uint64))
    for k, (role, _) in enumerate(wanted):
        if role:
            v[k] ^= np.array(role_words(role), np.int64).view(np.uint64)
    return majority(v).view(np.int64).tolist()
