"""The queries that SQL can express against their SQL, on whole tables."""

import duckdb
import pandas as pd
import pytest

from codelode.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def shown(v):
    """Null as empty; whole floats as integers, as pandas makes floats of integers beside nulls."""
    if pd.isna(v):
        return ""
    return str(round(v, 6)).removesuffix(".0") if isinstance(v, float) else str(v)


def rows(df):
    return sorted(tuple(map(shown, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def odd(tmp_path_factory, spark):
    """Null, empty, repeated and short rows, ties, and an extra column that clashes."""
    at = str(tmp_path_factory.mktemp("odd"))
    words = " ".join(f"w{i}" for i in range(120))
    key, other = "Ab3" + "xY7_" * 6, "Zz9" + "qW4-" * 6
    docs = [
        (1, words, "en", "a"), (2, words.upper(), "en", "b"), (3, None, "en", None), (4, "", "fr", "a"), (5, " \t\x0b\n", "fr", "c"),
        (6, "one two", "en", "c"), (7, "ONE  two", "en", None), (8, f"x {key} Token = 'abcdefghijkl123' é\U0001f600 AKIA{'Z' * 14} {'ab12' * 5}", "de", "a"),
        (9, f"api-key: no apikey:{'q' * 12} passWD=short {other} {key[:10]}", "de", "a"), (10, f"{other} {'ab12' * 5} password: {'ab12' * 5}", "de", "b"),
        (11, words + " tail of five more words", "en", "a"), (12, "x y z w", "es", "a"), (13, words[200:] + " " + words[:200], "es", "b"),
    ]
    spark.createDataFrame([(*d, len(d[1] or ""), f"<{d[0]}>") for d in docs], "doc_id long, text string, lang string, source string, n_chars long, component_id string").coalesce(1).write.parquet(f"{at}/documents.parquet")
    chats = [(1, 1, "user", "a~0<|end|>"), (1, 0, "user", None), (1, 2, None, "</s>"), (1, 3, "assistant", "é~"), (1, 3, "assistant", "é~"), (None, None, "assistant", ""), (2, 5, "<|text|>", "[INST]<s>")]
    spark.createDataFrame(chats, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{at}/conversations.parquet")
    pages = [(1, "u", "<p>é"), (2, None, "<p>é"), (3, "v", None), (4, "w", ""), (0, "x y", "<p>é")]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{at}/pages.parquet")
    return at


def compare(spark, name, sf):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet{'' if sf == SF else '/*.parquet'}'")
    got, want = QUERIES[name](spark, sf).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    compare(spark, name, SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_odd_rows_same_as_sql(spark, odd, name):
    compare(spark, name, odd)
