"""Trees as node rows with a path of child ordinals; arrays sort prefix first, so ordering by path is the walk."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions import text as T
from .store import written


def stats(nodes: DataFrame) -> DataFrame:
    """(map_id, n_nodes, depth) of each tree."""
    return nodes.groupBy("map_id").agg(F.count("*").alias("n_nodes"), (F.max(F.size("path")) + 1).alias("depth"))


def subtree(nodes: DataFrame) -> DataFrame:
    """(map_id, path, n_nodes, height) of each node's subtree: each node tells all its ancestors, linear in the depths."""
    ancestors = F.transform(F.sequence(F.lit(0), F.size("path")), lambda k: F.slice("path", 1, k))
    told = nodes.select("map_id", F.size("path").alias("d"), F.explode(ancestors).alias("path"))
    return told.groupBy("map_id", "path").agg(F.count("*").alias("n_nodes"), (F.max("d") - F.size("path") + 1).alias("height"))


def walk(nodes: DataFrame) -> DataFrame:
    """nodes with their depth-first position in their map."""
    return nodes.withColumn("position", F.row_number().over(Window.partitionBy("map_id").orderBy("path")) - 1)


def rename(nodes: DataFrame, map_id, path: list[int], title: str) -> DataFrame:
    here = (F.col("map_id") == F.lit(map_id)) & (F.col("path") == F.array(*[F.lit(p) for p in path]).cast("array<int>"))
    return nodes.withColumn("title", F.when(here, F.lit(title)).otherwise(F.col("title")))


def delete(nodes: DataFrame, map_id, path: list[int]) -> DataFrame:
    """Without the subtree at path; later siblings move up by one. The root can't go."""
    if not path:
        raise ValueError("the root can't be deleted")
    k, at = len(path), F.array(*[F.lit(p) for p in path]).cast("array<int>")
    mine = F.col("map_id") == F.lit(map_id)
    kept = nodes.filter(~(mine & (F.slice("path", 1, k) == at)))
    level = F.get("path", F.lit(k - 1))
    parent = F.slice("path", 1, k - 1) == F.slice(at, 1, k - 1)
    moved = F.concat(F.slice("path", 1, k - 1), F.array(level - 1), F.slice("path", k + 1, F.greatest(F.size("path"), F.lit(1))))
    return kept.withColumn("path", F.when(mine & parent & (level > path[-1]), moved).otherwise(F.col("path")))


def insert(nodes: DataFrame, additions: DataFrame, mine: DataFrame | None = None) -> DataFrame:
    """nodes with additions (map_id, parent, seq, title, type, note if there) as the last children of their parents, in the order of seq.

    Several of one parent take the next places one after another; those whose parent isn't there are left out; other
    columns of nodes are null in them. mine are the nodes of the maps that get some, if they are known; the others are
    then only passed on.
    """
    k, mine = F.size("path"), nodes if mine is None else mine
    taken = mine.filter(k > 0).groupBy("map_id", F.slice("path", 1, F.greatest(k - 1, F.lit(0))).alias("parent")).agg((F.max(F.try_element_at("path", F.lit(-1))) + 1).alias("taken"))
    here = additions.join(mine.select("map_id", F.col("path").alias("parent")), ["map_id", "parent"], "left_semi").join(taken, ["map_id", "parent"], "left")
    turn = F.row_number().over(Window.partitionBy("map_id", "parent").orderBy("seq")) - 1
    new = here.withColumn("path", F.concat("parent", F.array((F.coalesce("taken", F.lit(0)) + turn).cast("int"))))
    given = {"map_id", "path", "title", "type"} | ({"note"} & set(additions.columns))
    return nodes.unionByName(new.select(*[F.col(f.name) if f.name in given else F.lit(None).cast(f.dataType).alias(f.name) for f in nodes.schema]))


def valid_links(links: DataFrame, hierarchical: bool = False) -> DataFrame:
    """Links (map_id, seq, a_path, b_path) without self-links, ancestors of each other, and pairs seen before either way."""
    a, b = F.col("a_path"), F.col("b_path")
    apart = a != b
    if not hierarchical:
        apart &= (F.slice(b, 1, F.size(a)) != a) & (F.slice(a, 1, F.size(b)) != b)
    pair = F.array_sort(F.array(a, b))
    first = Window.partitionBy("map_id", "pair").orderBy("seq")
    kept = links.filter(apart).withColumn("pair", pair).withColumn("r", F.row_number().over(first)).filter("r = 1")
    return kept.drop("pair", "r")


def search(nodes: DataFrame, query: str, most: int = 10, exact_case: bool = False) -> DataFrame:
    """(map_id, path, title, note) of the first nodes of each map that hold the query in title and note."""
    if not query:
        return nodes.select("map_id", "path", "title", "note").limit(0)
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("note", F.lit("")))
    found = text.contains(query) if exact_case else F.lower(text).contains(query.lower())
    first = Window.partitionBy("map_id").orderBy("path")
    return nodes.filter(found).withColumn("r", F.row_number().over(first)).filter(F.col("r") <= most).select("map_id", "path", "title", "note")


def union_maps(nodes: DataFrame, items: DataFrame, title: str) -> DataFrame:
    """One tree of many: items (map_id, ordinal, label) become branches of a new root, in their order."""
    under = nodes.join(items, "map_id")
    path = F.concat(F.array(F.col("ordinal").cast("int")), "path")
    top = F.size(nodes["path"]) == 0
    kind = F.when(top, F.lit("topic")).otherwise(F.col("type"))
    rows = under.select(path.alias("path"), F.when(top, F.col("label")).otherwise(F.col("title")).alias("title"), kind.alias("type"), "note")
    root = nodes.sparkSession.range(1).select(F.array().cast("array<int>").alias("path"), F.lit(title).alias("title"), F.lit("root").alias("type"), F.lit(None).cast("string").alias("note"))
    return root.unionByName(rows)


# The tags of node types in Markdown.
TAGS = {"concept": "Concept", "definition": "Definition", "example": "Example", "insight": "Insight", "action": "Action", "warning": "Warning", "question": "Question"}


def markdown(nodes: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(map_id, content): a heading, a bullet for each node, its note in italics below, and the links by title."""
    tags = F.create_map(*[F.lit(x) for k, v in TAGS.items() for x in (k, f"[{v}] ")])
    depth = F.size("path")
    indent = F.repeat(F.lit("  "), F.greatest(depth - 1, F.lit(0)))
    bullet = F.concat(indent, F.lit("- "), F.coalesce(tags[F.col("type")], F.lit("")), F.col("title"))
    told = T.note_with_clock(F.coalesce("note", F.lit("")), F.col("timestamp")) if "timestamp" in nodes.columns else F.coalesce("note", F.lit(""))
    note = T.collapse(told)
    line = F.when(depth == 0, F.concat(F.lit("# "), F.col("title"), F.lit("\n"))).otherwise(F.concat(bullet, F.when(note != "", F.concat(F.lit("\n"), indent, F.lit("  *"), note, F.lit("*"))).otherwise("")))
    body = nodes.select("map_id", F.struct("path", line.alias("line")).alias("l")).groupBy("map_id").agg(F.array_sort(F.collect_list("l")).alias("ls"))
    body = body.select("map_id", F.concat(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), F.lit("\n")).alias("content"))
    if links is None:
        return body
    named = nodes.select("map_id", F.col("path"), F.col("title"))
    both = links.join(named.select("map_id", F.col("path").alias("a_path"), F.col("title").alias("a")), ["map_id", "a_path"], "left")
    both = both.join(named.select("map_id", F.col("path").alias("b_path"), F.col("title").alias("b")), ["map_id", "b_path"], "left")
    raw = lambda p: F.array_join(F.transform(p, lambda x: x.cast("string")), ".")
    suffix = F.when(F.coalesce("label", F.lit("")) != "", F.concat(F.lit(" ("), F.col("label"), F.lit(")"))).otherwise("")
    text = F.concat(F.lit("- **"), F.coalesce("a", raw("a_path")), F.lit("** → **"), F.coalesce("b", raw("b_path")), F.lit("**"), suffix)
    more = both.groupBy("map_id").agg(F.array_sort(F.collect_list(F.struct("seq", text.alias("t")))).alias("r"))
    joined = body.join(more, "map_id", "left")
    tail = F.concat(F.lit("\n## Relationships\n\n"), F.array_join(F.transform("r", lambda x: x["t"]), "\n"), F.lit("\n"))
    return joined.select("map_id", F.concat("content", F.coalesce(tail, F.lit(""))).alias("content"))


def _placed(stack: list, level) -> None:
    """The stack (level, ordinal) of open entries after one more entry: what isn't of a smaller level closes, the last of it being its sibling."""
    if level is None or stack and stack[0][0] is None:  # a null level compares with none
        stack[:] = [(level, 0)]
        return
    sibling = None
    while stack and stack[-1][0] >= level:
        sibling = stack.pop()
    stack.append((level, sibling[1] + 1 if sibling else 0))


def _run_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (_part, source, level), sorted, a row a part (_part, first, last: sources; known, runs, stack).

    stack: the open entries at the part's end. Unless it is known, the part is one source that may have begun before; then
    runs (level, n) are the entries without a parent in the part, and the bottom of the stack is the last of them.
    """
    part, first, last, known, runs, stack = None, None, None, False, [], []

    def told(source: pa.DataType) -> pa.RecordBatch:
        pairs = pa.list_(pa.struct([("level", pa.int64()), ("n", pa.int64())]))
        named = lambda xs: [{"level": x[0], "n": x[1]} for x in xs]
        return pa.RecordBatch.from_arrays([
            pa.array([part], pa.int64()), pa.array([first], source), pa.array([last], source), pa.array([known]), pa.array([named(runs)], pairs), pa.array([named(stack)], pairs),
        ], ["_part", "first", "last", "known", "runs", "stack"])

    for batch in batches:
        for p, source, level in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if p != part:
                if part is not None:
                    yield told(batch.schema.field(1).type)
                part, first, last, known, runs, stack = p, source, source, False, [], []
            elif source != last:
                last, known, runs, stack = source, True, [], []
            known = known or level is None
            _placed(stack, level)
            if not known and len(stack) == 1:
                if runs and runs[-1][0] == level:
                    runs[-1][1] += 1
                else:
                    runs.append([level, 1])
        kind = batch.schema.field(1).type
    if part is not None:
        yield told(kind)


def outline_tree(outline: DataFrame) -> DataFrame:
    """outline (source, seq, level, title, page) with path: an entry's parent is the last before it of a smaller level.

    Entries are dealt by ranges of (source, seq), so a long source is many tasks. What is open where a part begins is told
    by the ends of the parts before, a few numbers each; then each part is walked with a stack of its open entries, which
    grows with the levels alone.
    """
    columns = ["source", "seq", "level", "title", "page"]
    dealt = outline.select(columns).repartitionByRange("source", "seq").sortWithinPartitions(*columns)
    rows = written(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "outline")
    kind = rows.schema["source"].dataType.simpleString()
    walked = lambda *some: rows.repartition("_part").sortWithinPartitions("_part", "_at").select("_part", "source", F.col("level").cast("long"), *some)
    pairs = "array<struct<level:bigint,n:bigint>>"
    ends = walked().mapInArrow(_run_ends, f"_part long, first {kind}, last {kind}, known boolean, runs {pairs}, stack {pairs}").orderBy("_part").collect()  # a row a part
    opened, stack, before = {}, [], None
    for e in ends:
        stack = list(stack) if before is not None and before.last == e.first else []
        opened[e["_part"]] = list(stack)
        if e.known:
            stack = [tuple(x) for x in e.stack]
        else:
            for level, n in e.runs:
                _placed(stack, level)
                stack[-1] = level, stack[-1][1] + n - 1
            stack += [tuple(x) for x in e.stack[1:]]
        before = e

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, stack = None, None, []
        for batch in batches:
            paths = []
            for p, source, level in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if p != part:
                    part, stack = p, list(opened[p])
                elif source != last:
                    stack = []
                last = source
                _placed(stack, level)
                paths.append([ordinal for _, ordinal in stack])
            yield pa.RecordBatch.from_arrays([batch.column(1), *batch.columns[3:], pa.array(paths, pa.list_(pa.int32()))], [*columns, "path"])

    schema = StructType([*(rows.schema[c] for c in columns), StructField("path", ArrayType(IntegerType()))])
    return walked("seq", F.col("level").alias("told"), "title", "page").mapInArrow(run, schema)


def heading_levels(lines: DataFrame) -> DataFrame:
    """(source, seq, title, level, page) of headings among lines (source, seq, page, size, text), by font size.

    Body size is the most common (the first seen of equals); headings are 1.15 times as large, of 1 to 12 words, not
    repeated three times and more; a source has 3 of them on 2 pages at least, else none.
    """
    sizes = lines.groupBy("source", "size").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    by = Window.partitionBy("source").orderBy(F.desc("n"), "first")
    body = sizes.withColumn("r", F.row_number().over(by)).filter("r = 1").select("source", F.col("size").alias("body"))
    words = T.word_count(F.col("text"))
    found = lines.join(body, "source").filter((F.col("size") >= F.col("body") * 1.15) & words.between(1, 12))
    seen = found.groupBy("source", "text").agg(F.count("*").alias("n")).filter("n < 3").select("source", "text")
    found = found.join(seen, ["source", "text"])
    gate = found.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("page").alias("pages")).filter("n >= 3 and pages >= 2")
    rank = F.dense_rank().over(Window.partitionBy("source").orderBy(F.desc("size")))
    found = found.join(gate.select("source"), "source", "left_semi").withColumn("level", F.least(rank, F.lit(3)))
    return found.select("source", "seq", F.col("text").alias("title"), "level", "page")
