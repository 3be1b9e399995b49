"""Requests to a text model as a DataFrame operator: asked once, kept in a log, retried at a pace, failures as rows.

A request's key hashes all that its reply depends on. Keys the log has aren't asked again; the others are asked once
each, by tasks, and written before anything reads them, so a plan that is evaluated twice pays once. Equal requests of
different rows are one request.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import prompts
from .provider import Provider
from .store import Log, among, written
from .usage import Paces


class ProviderError(Exception):
    """A request that failed; retryable says whether another try may help, after how many seconds to wait if that is known."""

    def __init__(self, message: str, retryable: bool = False, after: float | None = None):
        super().__init__(message)
        self.retryable, self.after = retryable, after


def delay(attempt: int, after: float | None = None, most: float = 30.0) -> float:
    """Seconds to wait after a failed attempt, counted from 0: what the provider asked for, else 1.5, 3, 6 ...; `most` at most."""
    return min(after if after is not None else 1.5 * 2**attempt, most)


class Pacer:
    """Spaces the requests of one task; a refusal makes the spaces longer, up to 30 seconds."""

    def __init__(self, spacing: float, sleep=time.sleep, clock=time.monotonic):
        self.spacing, self.sleep, self.clock, self.next, self.slowed = spacing, sleep, clock, 0.0, False

    def wait(self) -> None:
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
        self.next = max(now, self.next) + self.spacing

    def slower(self) -> None:
        self.spacing, self.slowed = min(30.0, max(self.spacing, 0.1) * 1.6), True


def answer(provider: Provider, system: str, user: str, attempts: int, pacer: Pacer, sleep=time.sleep) -> tuple[str | None, str | None]:
    """(reply as JSON, None), or (None, what went wrong) when the last attempt failed or another can't help."""
    error = None
    for attempt in range(attempts):
        pacer.wait()
        try:
            reply = provider.complete_json(system, user)
        except Exception as e:
            # By attribute, for a provider's module may have imported the class anew where this function came by value.
            retryable = getattr(e, "retryable", True if isinstance(e, OSError) else None)  # OSError: the network
            if retryable is None:
                raise
            error = str(e) or type(e).__name__
            if not retryable or attempt + 1 == attempts:
                break
            pacer.slower()
            sleep(delay(attempt, getattr(e, "after", None)))
        else:
            if isinstance(reply, dict):
                return json.dumps(reply, ensure_ascii=False), None
            error = "the reply is no object"
            break
    return None, error


class Answers:
    """A provider with its log. lanes tasks ask at a time, pace seconds apart all together; ledger has (task, asked, failed).

    A refusal makes the pace of all later requests slower. With paces, the first one is what earlier runs learned, `pace`
    at least for a provider that wasn't refused in the last of them, and finish() adds what this run learned.
    """

    def __init__(self, provider: Provider, log: Log, purpose: str = "general", attempts: int = 3, lanes: int | None = None, pace: float = 0.0, paces: Paces | None = None):
        self.provider, self.log, self.purpose, self.attempts = provider, log, purpose, attempts
        self.lanes, self.default, self.paces, self.ledger, self.refused = lanes, pace, paces, [], False
        self.pace = paces.start(provider.name, pace) if paces else pace

    def key(self, task: str, *parts: Column) -> Column:
        """Of a request: the prompts' version, provider, model, task, its parts, and the purpose unless it is general."""
        named = [F.lit(x) for x in (prompts.PROMPT_VERSION, self.provider.name, self.provider.model, task)]
        purpose = [] if self.purpose == "general" else [F.lit(f"purpose={self.purpose}")]
        return T.content_key(*named, *parts, *purpose)

    def ask(self, rows: DataFrame, task: str, user: Column, parts: list[Column], level: str = "full", limit: int | None = None, keep: list[str] | None = None) -> DataFrame:
        """rows, or the columns of them to keep, with reply (JSON, null if the request failed) and error (null if it didn't)."""
        keyed = rows.withColumns({"_key": self.key(task, *parts), "_user": user}).select(*(rows.columns if keep is None else keep), "_key", "_user")
        keyed = written(keyed.withColumn("_id", F.monotonically_increasing_id()), f"ask-{task}")
        fresh, others = self.fetch(keyed.select("_key", "_user", "_id"), task, level, limit)
        keyed = keyed.drop("_user", "_id")
        if not others:  # then all replies are fresh, and the log needn't be read
            reply = F.when(F.try_parse_json("value").isNotNull(), F.col("value"))
            return keyed.join(fresh.select(F.col("key").alias("_key"), reply.alias("reply"), "error"), "_key", "left").drop("_key")
        known = self.log.read().select(F.col("key").alias("_key"), F.col("value").alias("reply"))
        errors = fresh.filter("error is not null").select(F.col("key").alias("_key"), "error")
        return keyed.join(known, "_key", "left").join(errors, "_key", "left").drop("_key")

    def fetch(self, keyed: DataFrame, task: str, level: str = "full", limit: int | None = None) -> tuple[DataFrame, bool]:
        """Ask once what the log lacks of keyed (_key, _user, _id), rows of a written table; (key, value, error) of that, and whether the log had others.

        Which rows are asked for is found by keys and ids alone, so requests, which are long, aren't shuffled.
        """
        known = self.log.keys().select(F.col("key").alias("_key"), F.lit(True).alias("_known"))
        ids = keyed.groupBy("_key").agg(F.min("_id").alias("_id")).join(known, "_key", "left")
        ids = written(ids.select("_id", F.coalesce("_known", F.lit(False)).alias("_known")), f"wanted-{task}")
        wanted = among(keyed, ids.filter("not _known").select("_id"))
        fresh = written(self._complete(wanted, prompts.system(task, level, self.purpose, limit)), f"replies-{task}")
        asked, failed, refused, spacing = fresh.agg(F.count("*"), F.count("error"), F.bool_or("slowed"), F.max("spacing")).first()
        self.ledger.append((task, asked, failed))
        if refused:
            self.refused, self.pace = True, max(self.pace, spacing / (self.lanes or 1))
        if asked > failed:
            self.log.append(fresh.filter("value is not null").select("key", "value"))
        return fresh, not ids.filter("_known").isEmpty()

    def _complete(self, wanted: DataFrame, system: str) -> DataFrame:
        provider, attempts, spacing = self.provider, self.attempts, self.pace * (self.lanes or 1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pacer = Pacer(spacing)
            for batch in batches:
                told = [answer(provider, system, user or "", attempts, pacer) for user in batch.column(1).to_pylist()]
                values, errors = zip(*told, strict=True) if told else ((), ())
                n = batch.num_rows
                pace = [pa.array([pacer.slowed] * n, pa.bool_()), pa.array([pacer.spacing] * n, pa.float64())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.string()), pa.array(errors, pa.string()), *pace], ["key", "value", "error", "slowed", "spacing"])

        some = wanted.select(F.col("_key").alias("key"), "_user")
        if self.pace and not self.lanes:
            some = some.coalesce(1)  # one pace for all needs one lane, or a number of lanes to share it
        elif self.lanes:
            some = some.repartition(self.lanes)
        return some.mapInArrow(run, "key string, value string, error string, slowed boolean, spacing double")

    def finish(self) -> None:
        """Remember the pace for the next run."""
        if self.paces:
            self.paces.record(self.provider.name, self.refused, self.pace, self.default)

    def asked(self, task: str | None = None) -> int:
        return sum(n for t, n, _ in self.ledger if task in (None, t))


# -- replies


def points(reply: Column) -> Column:
    """The objects with a title among a reply's points, as (title, type) in their order."""
    told = F.from_json(reply, "points array<string>")["points"]
    parsed = F.transform(F.filter(told, lambda p: p.startswith("{")), lambda p: F.from_json(p, "title string, type string"))
    return F.filter(F.transform(parsed, lambda p: F.struct(T.strip(F.coalesce(p["title"], F.lit(""))).alias("title"), T.node_type(p["type"]).alias("type"))), lambda p: p["title"] != "")


def unnest(replies: DataFrame, deepest: int | None = None) -> DataFrame:
    """Nodes (map_id, path, title, type, note, timestamp) below the roots of nested replies (map_id, reply).

    Replies stay text; each level's children are taken from their parents' text in columns, and written, until a level
    has none. A child that is no object is left out and takes no place; a title is never empty; a type that isn't known
    is topic; of a key that is repeated in an object the last value counts.
    """
    kind = "title string, type string, note string, t double, children array<string>"
    inside = lambda c: F.filter(c, lambda x: x.startswith("{"))
    empty = F.array().cast("array<int>")
    level = replies.select("map_id", empty.alias("path"), inside(F.from_json("reply", "children array<string>")["children"]).alias("below"))
    out, depth = None, 0
    while deepest is None or depth < deepest:
        rows = level.select("map_id", "path", F.posexplode("below").alias("i", "text"))
        rows = rows.select("map_id", F.concat("path", F.array("i")).alias("path"), F.from_json("text", kind).alias("n"))
        title = T.strip(F.coalesce("n.title", F.lit("")))
        nodes = rows.select("map_id", "path", F.when(title == "", "Untitled").otherwise(title).alias("title"), T.node_type(F.col("n.type")).alias("type"),
                            F.nullif("n.note", F.lit("")).alias("note"), F.col("n.t").alias("timestamp"), inside(F.col("n.children")).alias("below"))
        level = written(nodes, "unnest")
        if level.isEmpty() and out is not None:
            break
        out = level.drop("below") if out is None else out.unionByName(level.drop("below"))
        depth += 1
    return out
