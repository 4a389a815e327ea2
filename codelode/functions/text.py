"""Tokenisers and identifier splitting as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What separates tokens, as the inside of a character class.
DELIMITERS = r" \t,(){}\[\]<>:;=&*|!?@#$%\^~`'\"\\/"
BREAKS = DELIMITERS + r"\n\r"
# Bytes of a token that count, for hypervectors and for cluster labels, and for ranking.
VECTOR_BYTES, SEARCH_BYTES = 256, 512


def ascii_lower(c) -> Column:
    """Lower case for A-Z only."""
    return F.translate(c, UPPER, LOWER)


def split_identifier(c) -> Column:
    """Parts of an identifier: cut at _ - . and before a capital whose predecessor is none."""
    return F.filter(F.split(F.regexp_replace(c, "(?<=[^A-Z])(?=[A-Z])", "_"), "[_.-]"), lambda p: p != "")


def cut_bytes(c, most: int) -> Column:
    """A token's first ``most`` bytes; a character cut in two becomes the replacement character."""
    return F.when(F.octet_length(c) <= most, c).otherwise(F.decode(F.substring(F.encode(c, "UTF-8"), 1, most), "UTF-8"))


def vector_tokens(c) -> Column:
    """Tokens for hypervectors: lower case, two bytes or more, with . - _ inside, 256 bytes at most."""
    parts = F.filter(F.split(c, "[" + DELIMITERS + "]+"), lambda t: F.octet_length(t) >= 2)
    return F.transform(parts, lambda t: cut_bytes(ascii_lower(t), VECTOR_BYTES))


def search_tokens(c) -> Column:
    """Tokens for ranking, a multiset: whole runs, then the parts of identifiers; plain words count twice.

    The parts come from two passes over the whole text, not one over each word, so that no
    expression runs by token.
    """
    separators = "[" + BREAKS + r"._\-]+"
    # the capital is looked for first, as few characters are one
    cut = F.regexp_replace(c, r"[A-Z](?<=[^A-Z._\-" + BREAKS + "][A-Z])", "_$0")
    return F.array_remove(F.concat(F.split(ascii_lower(c), separators), F.split(ascii_lower(cut), separators)), "")


def search_term(token) -> Column:
    """A token as it stands in postings: 512 bytes at most."""
    return cut_bytes(token, SEARCH_BYTES)


def base_name(path) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def module_name(path) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def token_estimate(c) -> Column:
    """About four bytes to a token."""
    return F.floor((F.octet_length(c) + 3) / 4).cast("long")
