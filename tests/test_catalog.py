"""Queries against their SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from canopy.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents conversations pages labels".split()


def rows(df):
    told = lambda v: "" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted("|".join(map(told, r)) for r in df[sorted(df.columns)].itertuples(index=False))


def check(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    assert rows(catalog.QUERIES[name](spark, DATA).toPandas()) == rows(con.execute(catalog.SQL[name]).df())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["heuristic_map", "topic_chunks", "enumeration_sections", "number_anchors", "outline_tree", "subtree_sizes", "merkle_signature", "batch_reuse_diff", "cue_blocks", "missing_anchors", "outline_leaf_text", "md_sections"])
def test_query_equals_sql(spark, name):
    check(spark, name)


def test_entry_has_every_query():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_equals_batch(spark, tmp_path):
    from canopy.streaming.events import window_counts

    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = window_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    run.processAllAvailable()
    run.stop()
    told = lambda df: {(str(r.start), r.event_type): r.n for r in df.collect()}
    assert told(spark.table("windows")) == told(window_counts(events)) and spark.table("windows").count() > 0


@pytest.mark.parametrize("name", ["truncate_titles", "heuristic_map", "markdown_export", "batch_union", "batch_snapshot"])
def test_titles_that_begin_with_letters_of_no_single_upper_case(spark, tmp_path, name):
    import __spark_entry__ as entry

    texts = ["ßung | ein. ßheit ach.\nŉ und.\néa.", "ﬁn ΐ.\nᾳ.", None, "ıx. ǆ."]
    docs = spark.createDataFrame([(i, t, "de", "a", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert rows(entry.queries()[name](spark, str(tmp_path)).toPandas()) == rows(con.execute(entry.oracle_sql()[name]).df())
