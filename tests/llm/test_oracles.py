"""The operators that SQL can express return the rows of their DuckDB twins, on a given table and on odd rows."""

import duckdb
import pandas as pd
import pytest

from quillgraph.llm import chat, merkle, registry, trie

OPERATORS = {"op11_chat_formatting": chat.format_and_read_back, "op12_conversation_trie": trie.conversation_trie, "op13_merkle_manifest": merkle.manifest}
TABLES = {"op11_chat_formatting": "conversations", "op12_conversation_trie": "conversations", "op13_merkle_manifest": "documents"}


def same(got, want):
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    number = lambda v: int(v) if isinstance(v, float) and v == int(v) else v
    plain = lambda frame: sorted(repr(tuple(None if pd.isna(v) else number(v) for v in r)) for r in frame[cols].astype(object).itertuples(index=False, name=None))
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_given_table(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"create view {TABLES[name]} as select * from '{sf}/{TABLES[name]}.parquet'")
    same(registry.queries()[name](spark, sf).toPandas(), con.execute(registry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(OPERATORS))
@pytest.mark.parametrize("rows", ["odd", "none"])
def test_odd_rows(spark, odd, odd_turns, name, rows):
    table = odd_turns if TABLES[name] == "conversations" else odd
    table = table if rows == "odd" else table.where("false")
    con = duckdb.connect()
    con.register(TABLES[name], table.toArrow())
    same(OPERATORS[name](table).toPandas(), con.execute(registry.oracle_sql()[name]).df())
