"""Text-model stages behind a provider: cached, batched, retried.

A provider is any picklable object with complete_json(system, user) -> dict, name and model. Requests are keyed by the
hash of all they depend on; those the cache has aren't made, the others are made once by tasks and written as a table
before anything reads them, so that a plan that is evaluated twice doesn't pay twice.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .segments import batch_size

PROMPT_VERSION = "1"


class Provider(Protocol):
    name: str
    model: str

    def complete_json(self, system: str, user: str) -> dict: ...


class MockProvider:
    """Answers by task alone: the same request always gets the same reply."""

    name, model = "mock", "mock-1"

    def complete_json(self, system: str, user: str) -> dict:
        first = user.split("\n", 1)[0].strip()
        if system.startswith("TASK: map"):
            return {"topic": first[:40] or "Topic", "type": "concept", "summary": first[:120], "points": [first[:60]] if first else []}
        if system.startswith("TASK: reduce"):
            topics = [t for t in user.split("\n") if t]
            return {"central": "Map", "children": [{"title": t, "type": "topic", "children": []} for t in topics]}
        return {}


def parse_json(content):
    """A reply as a variant: the whole text, else what a fence holds, else from the first brace to the last."""
    fenced = F.regexp_extract(content, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(content, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.try_parse_json(content), F.try_parse_json(F.nullif(fenced, F.lit(""))), F.try_parse_json(F.nullif(braces, F.lit(""))))


def requests(chunks: DataFrame, provider: Provider, task: str, level: str, text_col: str = "text") -> DataFrame:
    """chunks with the key of the request each stands for."""
    parts = (F.lit(PROMPT_VERSION), F.lit(provider.name), F.lit(provider.model), F.lit(task), F.lit(level), F.col(text_col))
    return chunks.withColumn("key", T.content_key(*parts))


def complete(todo: DataFrame, provider: Provider, task: str, text_col: str = "text", attempts: int = 3) -> DataFrame:
    """(key, value: reply as JSON, null if all attempts failed) of distinct keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = []
            for user in batch.column(1).to_pylist():
                value = None
                for _ in range(attempts):
                    try:
                        value = json.dumps(provider.complete_json(f"TASK: {task}", user or ""), ensure_ascii=False, sort_keys=True)
                        break
                    except Exception:  # noqa: BLE001, S112  a provider may fail in any way; the row then tells
                        continue
                values.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.string())], ["key", "value"])

    return todo.select("key", text_col).dropDuplicates(["key"]).mapInArrow(run, "key string, value string")


def run_map(chunks: DataFrame, provider: Provider, cache: DataFrame, save, task: str = "map", level: str = "full") -> DataFrame:
    """chunks with value, from the cache where it has them. save(df) writes new rows to the cache and returns them, read back."""
    asked = requests(chunks, provider, task, level)
    misses = asked.join(cache.select("key"), "key", "left_anti")
    fresh = save(complete(misses, provider, task).filter("value is not null"))
    return asked.join(cache.select("key", "value").unionByName(fresh.select("key", "value")), "key", "left")


def map_nodes(mapped: DataFrame, key: str = "doc_id") -> DataFrame:
    """Nodes of map replies (topic, type, summary, points): a branch for each chunk, its points below."""
    reply = "struct<topic:string,type:string,summary:string,points:array<string>>"
    rows = mapped.select(F.col(key).alias("map_id"), "chunk", F.from_json("value", reply).alias("r")).filter("r is not null")
    topics = rows.select("map_id", F.array("chunk").alias("path"), F.col("r.topic").alias("title"), T.node_type(F.col("r.type")).alias("type"), F.col("r.summary").alias("note"))
    points = rows.select("map_id", "chunk", F.posexplode(F.coalesce("r.points", F.array().cast("array<string>"))).alias("i", "title"))
    points = points.select("map_id", F.array("chunk", "i").alias("path"), "title", F.lit("detail").alias("type"), F.lit(None).cast("string").alias("note"))
    return topics.unionByName(points)


def batches(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, chunk, batch): several chunks go into one request where a source has more than nine."""
    sizes = chunks.groupBy(key).agg(F.count("*").alias("n")).select(key, batch_size(F.col("n")).alias("size"))
    return chunks.join(sizes, key).select(key, "chunk", F.floor(F.col("chunk") / F.col("size")).cast("int").alias("batch"))


def call_estimate(docs: DataFrame, level: str = "full") -> DataFrame:
    """docs (n_chunks) with the number of requests a map takes: chunks, the reduction, and linking for experts."""
    return docs.withColumn("calls", F.col("n_chunks") + 1 + (1 if level == "expert" else 0))
