"""Maps that a text model fills: parts, reduction, numbered sections, outlines, repairs, takeaways, links, folder labels.

Each stage asks through requests.Answers, so a second run asks nothing. What a provider didn't answer comes back as
rows beside the nodes; a source of which nothing was answered has no nodes, and says so there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import anchors, outlines, structuring, trees
from .requests import Answers, points, unnest
from .segments import batch_size
from .store import MOST, among, written

#: Words of a section that one request carries.
WORDS = {"brief": 2000, "full": 1400, "expert": 1200}
NODES = ["map_id", "path", "title", "type", "note", "timestamp"]
#: How much of a section stands for it where its request failed, and words an introduction needs for a branch of its own.
SNIPPET, LEAST_INTRO = 400, 40


def _known(level: str) -> str:
    return level if level in WORDS else "full"


def _first_words(text: Column, n: int) -> Column:
    """A text as it is, or its first n words if it has more."""
    words = T.words(text)
    return F.when(F.size(words) > n, F.array_join(F.slice(words, 1, n), " ")).otherwise(text)


def _node(df: DataFrame, path: Column, title: Column, kind: Column, note: Column | None = None, at: Column | None = None) -> DataFrame:
    null = F.lit(None)
    return df.select("map_id", path.cast("array<int>").alias("path"), title.alias("title"), kind.alias("type"), (null if note is None else note).cast("string").alias("note"), (null if at is None else at).cast("double").alias("timestamp"))


def _failed(asked: DataFrame, *more: str) -> DataFrame:
    return asked.filter("error is not null").select("map_id", *more, "error")


def _answered(asked: DataFrame) -> DataFrame:
    """(map_id) of the sources that got an answer to something."""
    return asked.filter("reply is not null").select("map_id").distinct()


# -- parts and their reduction


def map_parts(parts: DataFrame, answers: Answers, level: str = "full", passes: int = 2) -> DataFrame:
    """parts (map_id, part, text) with reply, null for those that failed in every pass.

    What the log has isn't asked. Of the others a source's are asked together where they are more than nine; each reply
    is kept by itself, so that a later run finds it however it groups them. What a pass leaves is asked once more.
    """
    keyed = parts.withColumns({"_part_key": answers.key("map", F.lit(level), F.col("text")), "_id": F.monotonically_increasing_id()})
    keyed = written(keyed, "parts")
    replies = lambda: answers.log.read().select(F.col("key").alias("_part_key"), F.col("value").alias("reply"))
    for _ in range(passes):
        lacking = keyed.select("_part_key", "_id").join(answers.log.keys().withColumnRenamed("key", "_part_key"), "_part_key", "left_anti")
        left = among(keyed, written(lacking.select("_id"), "parts-left"))
        if left.isEmpty():
            break
        # Few sources have many parts; the parts of the others stay where they are, for they are asked one by one.
        size = left.groupBy("map_id").agg(batch_size(F.count("*")).alias("_size")).filter("_size > 1")
        size = written(size.withColumnRenamed("map_id", "_of"), "parts-many")
        size = F.broadcast(size) if size.count() <= MOST else size
        mine = F.col("map_id").eqNullSafe(F.col("_of"))
        answers.fetch(left.join(size, mine, "left_anti").select(F.col("_part_key").alias("_key"), F.col("text").alias("_user"), "_id"), "map", level)
        turn = F.row_number().over(Window.partitionBy("map_id").orderBy("part")) - 1
        sized = left.join(size, mine).withColumn("_batch", F.floor(turn / F.col("_size")))
        item = F.struct("part", "_part_key", "text")
        many = sized.groupBy("map_id", "_batch").agg(F.array_sort(F.collect_list(item)).alias("ps"))
        many = many.select(F.transform("ps", lambda p: p["_part_key"]).alias("ks"), F.transform("ps", lambda p: p["text"]).alias("ts"))
        segments = F.to_json(F.struct(F.transform("ts", lambda t, i: F.struct(i.alias("id"), t.alias("text"))).alias("segments")))
        told = answers.ask(many, "map_batch", segments, [F.lit(level), F.array_join("ts", "|")], level, keep=["ks"])
        result = told.select("ks", F.explode(F.from_json("reply", "results array<string>")["results"]).alias("r")).filter(F.col("r").startswith("{"))
        numbered = result.withColumn("id", F.from_json("r", "id int")["id"]).filter((F.col("id") >= 0) & (F.col("id") < F.size("ks")))
        single = F.to_json(F.from_json("r", "topic string, type string, summary string, points array<struct<title:string,type:string>>"))
        answers.log.append(numbered.select(F.get("ks", F.col("id")).alias("key"), single.alias("value")))
    return keyed.join(replies(), "_part_key", "left").drop("_part_key", "_id")


def reduce_parts(mapped: DataFrame, sources: DataFrame, answers: Answers, level: str = "full") -> tuple[DataFrame, DataFrame]:
    """Nodes of one tree a source, and failures (map_id, error), from mapped (map_id, part, reply) and sources (map_id, title).

    A source's replies in order are one request. The root has the source's own title, else the reply's; level brief
    keeps the branches alone, whatever the reply holds. A source without any mapped part, or whose reply has no
    children, fails.
    """
    level = _known(level)
    every = mapped.groupBy("map_id").agg(F.array_sort(F.collect_list(F.when(F.col("reply").isNotNull(), F.struct("part", "reply")))).alias("rs"))
    rows = sources.select("map_id", "title").join(every, "map_id", "left")
    some = rows.filter(F.size("rs") > 0)
    title = F.to_json(F.struct(F.col("title").alias("title"), F.lit(level).alias("level")))
    joined = F.array_join(F.transform("rs", lambda r: r["reply"]), ", ")
    user = F.concat(F.regexp_replace(title, r"\}$", ""), F.lit(', "segments": ['), joined, F.lit("]}"))
    asked = answers.ask(some.withColumn("user", user), "reduce", F.col("user"), [F.lit(level), F.col("user")], level, keep=["map_id", "title"])
    told = written(asked.withColumn("n", F.size(F.from_json("reply", "children array<string>")["children"])), "reduced")
    good = told.filter("n >= 0")
    below = unnest(good, deepest=1 if level == "brief" else None)
    central = F.nullif(T.strip(F.from_json("reply", "central string")["central"]), F.lit(""))
    root = _node(good, F.array(), F.coalesce(F.nullif("title", F.lit("")), central, F.lit("Mind Map")), F.lit("root"))
    silent = rows.filter(F.coalesce(F.size("rs"), F.lit(0)) <= 0).select("map_id", F.lit("no part was mapped").alias("error"))
    shapeless = told.filter("reply is not null and not coalesce(n >= 0, false)").select("map_id", F.lit("the reply has no tree").alias("error"))
    return root.unionByName(below), _failed(told).unionByName(silent).unionByName(shapeless)


# -- numbered sections


def fill_sections(sections: DataFrame, intro: DataFrame, sources: DataFrame, answers: Answers, level: str = "full") -> tuple[DataFrame, DataFrame]:
    """Nodes of sources whose author numbered their parts, and failures (map_id, number, error).

    sections (map_id, number, heading, start, text), intro (map_id, start, text), sources (map_id, title). First one
    request a source tidies the headings; a failure, or another number of headings, leaves them as they are. Then each
    section is a request, and so is an introduction of 40 words or more, as a first branch Overview. Numbers stay as the
    author said them. A failed section keeps the beginning of its text; a source of which all failed has no nodes, and
    a failure without number; level brief has no points.
    """
    level = _known(level)
    plain = F.coalesce(F.nullif("heading", F.lit("")), F.concat(F.lit("Part "), F.col("number").cast("string")))
    rows = written(sections.select("map_id", "number", plain.alias("heading"), "start", F.coalesce("text", F.lit("")).alias("text")), "sections")
    lead = F.struct("number", F.substring("heading", 1, 120).alias("raw_lead_in"), F.array_join(F.slice(T.words(F.col("text")), 1, 40), " ").alias("section_start"))
    heads = rows.groupBy("map_id").agg(F.to_json(F.array_sort(F.collect_list(lead))).alias("user"))
    told = answers.ask(heads, "headings", F.col("user"), [F.col("user")], level)
    given = told.select("map_id", F.from_json("reply", "headings array<string>")["headings"].alias("headings")).filter("headings is not null")
    placed = rows.withColumnRenamed("number", "said").withColumn("number", F.row_number().over(Window.partitionBy("map_id").orderBy("said")))
    named = structuring.polished(placed, given).select("map_id", F.col("said").alias("number"), "heading", "start", "text")
    over = intro.filter(T.word_count(F.col("text")) >= LEAST_INTRO).join(rows.select("map_id").distinct(), "map_id", "left_semi")
    over = over.select("map_id", F.lit(None).cast(rows.schema["number"].dataType).alias("number"), F.lit("Overview").alias("heading"), "start", "text")
    every = named.unionByName(over).withColumn("at", F.row_number().over(Window.partitionBy("map_id").orderBy(F.asc_nulls_first("number"))) - 1)
    user = F.to_json(F.struct(F.col("heading").alias("section_title"), _first_words(F.col("text"), WORDS[level]).alias("transcript")))
    asked = written(answers.ask(every.withColumn("user", user), "section", F.col("user"), [F.lit(level), F.col("user")], level), "section-replies")
    ok = written(_answered(asked), "section-sources")
    good = asked.join(ok, "map_id", "left_semi")
    title = F.when(F.col("number").isNull(), F.col("heading")).otherwise(F.concat(F.col("number").cast("string"), F.lit(". "), F.col("heading")))
    note = F.nullif(T.strip(F.coalesce(F.when(F.col("reply").isNull(), F.substring(T.strip(F.col("text")), 1, SNIPPET)), F.from_json("reply", "note string")["note"], F.lit(""))), F.lit(""))
    nodes = _node(good, F.array("at"), title, F.lit("topic"), note, F.col("start"))
    roots = sources.join(ok, "map_id", "left_semi")
    nodes = _node(roots, F.array(), F.coalesce(F.nullif("title", F.lit("")), F.lit("Mind Map")), F.lit("root")).unionByName(nodes)
    if level != "brief":
        below = good.select("map_id", "at", F.posexplode(points(F.col("reply"))).alias("i", "p"))
        nodes = nodes.unionByName(_node(below, F.array("at", "i"), F.col("p.title"), F.col("p.type")))
    lost = rows.select("map_id").distinct().join(ok, "map_id", "left_anti")
    lost = lost.select("map_id", F.lit(None).cast(rows.schema["number"].dataType).alias("number"), F.lit("all sections failed").alias("error"))
    return nodes, _failed(good, "number").unionByName(lost)


# -- outlines


def enrich_outline(outline: DataFrame, pages: DataFrame, sources: DataFrame, answers: Answers | None, level: str = "full") -> tuple[DataFrame, DataFrame | None]:
    """Nodes of outlined sources whose leaves a model summed up, and failures (map_id, path, error).

    A leaf's text is one request, cut to the level's words; its note is the summary, its children the points. A leaf
    that failed, or got no summary, keeps its note of the bare outline. Without a provider, or at level brief, nothing
    is asked and failures are None. A source of which all leaves failed has no nodes, and a failure without path; one
    without text in its leaves is as it stands.
    """
    level, named = _known(level), F.coalesce(F.nullif("title", F.lit("")), F.lit("Document"))
    root = _node(sources, F.array(), named, F.lit("root"))
    rows = written(outlines.leaf_texts(outline, pages).withColumnRenamed("source", "map_id"), "outline-leaves")
    told = F.when(F.coalesce("text", F.lit("")) != "", F.concat(F.lit("(p. "), (F.col("page") + 1).cast("string"), F.lit(") "), T.truncate(F.col("text"), 500)))
    bare = sources.join(rows.select("map_id").distinct(), "map_id", "left_anti")
    empty = _node(bare, F.array(F.lit(0)), F.lit("(no structure detected)"), F.lit("detail"))
    if answers is None or level == "brief":
        return root.unionByName(_node(rows, F.col("path"), F.col("title"), F.lit("topic"), told)).unionByName(empty), None
    leaves = rows.filter(F.coalesce("text", F.lit("")) != "")
    text = _first_words(F.col("text"), WORDS[level])
    asked = answers.ask(leaves.select("map_id", "path", text.alias("text")), "map", F.col("text"), [F.lit(level), F.col("text")], level)
    asked = written(asked.drop("text"), "outline-replies")
    lost = written(asked.select("map_id").distinct().join(_answered(asked), "map_id", "left_anti"), "outline-lost")
    good = asked.join(lost, "map_id", "left_anti")
    summary = F.nullif(T.strip(F.from_json("reply", "summary string")["summary"]), F.lit(""))
    kept = rows.join(lost, "map_id", "left_anti").join(good.select("map_id", "path", summary.alias("summary")), ["map_id", "path"], "left")
    nodes = root.join(lost, "map_id", "left_anti").unionByName(_node(kept, F.col("path"), F.col("title"), F.lit("topic"), F.coalesce("summary", told))).unionByName(empty)
    below = good.select("map_id", "path", F.posexplode(points(F.col("reply"))).alias("i", "p"))
    nodes = nodes.unionByName(_node(below, F.concat("path", F.array("i")), F.col("p.title"), F.col("p.type")))
    none = F.lit(None).cast("array<int>").alias("path")
    return nodes, _failed(good, "path").unionByName(lost.select("map_id", none, F.lit("all sections failed").alias("error")))


# -- what is asked about a whole map


def _listing(nodes: DataFrame, sections: bool = False) -> DataFrame:
    """(map_id, listing, n): a map's nodes but the root, numbered from 0 in the order of the walk, as JSON objects."""
    placed = trees.walk(nodes).filter("position > 0").withColumn("id", F.col("position") - 1)
    entry = [F.col("id"), F.col("title"), F.nullif("note", F.lit("")).alias("note")]
    if sections:
        top = nodes.filter(F.size("path") == 1).select("map_id", F.get("path", F.lit(0)).alias("_top"), F.col("title").alias("section"))
        placed = placed.withColumn("_top", F.get("path", F.lit(0))).join(top, ["map_id", "_top"], "left")
        entry.append(F.col("section"))
    listing = F.array_sort(F.collect_list(F.struct(*entry)))
    return placed.groupBy("map_id").agg(listing.alias("listing"), F.count("*").alias("n"))


def repair_anchors(nodes: DataFrame, texts: DataFrame, answers: Answers, level: str = "full") -> tuple[DataFrame, DataFrame]:
    """nodes with the anchors that their source's text (map_id, text) names and they lack, where a model put them; and failures.

    Nothing is asked of a map that lacks none, nor at level brief.
    """
    if level == "brief":
        return nodes, nodes.select("map_id", F.lit("").alias("error")).limit(0)
    nodes = written(nodes, "anchor-nodes")  # what makes them may be long, and they are read at each step
    lost = anchors.missing(texts, nodes).groupBy("map_id").agg(F.array_sort(F.collect_list(F.struct("rank", "anchor"))).alias("a"))
    lost = written(lost, "anchors-lost")
    rows = _listing(nodes.join(lost, "map_id", "left_semi")).join(lost, "map_id")
    user = F.to_json(F.struct(F.col("listing").alias("nodes"), F.transform("a", lambda x: x["anchor"]).alias("candidates")))
    asked = answers.ask(rows.select("map_id", user.alias("user")), "anchors", F.col("user"), [F.lit(level), F.col("user")], level)
    told = asked.select("map_id", F.posexplode(F.from_json("reply", "repairs array<string>")["repairs"]).alias("seq", "r")).filter(F.col("r").startswith("{"))
    told = told.select("map_id", "seq", F.from_json("r", "to int, title string, type string").alias("r")).select("map_id", "seq", "r.*")
    return anchors.repair(nodes, told), _failed(asked)


def take_away(nodes: DataFrame, answers: Answers, level: str = "full", least: int = 3) -> tuple[DataFrame, DataFrame]:
    """nodes with a last branch Key Takeaways where a model found some; maps of fewer than `least` nodes aren't asked about."""
    roots = nodes.filter(F.size("path") == 0).select("map_id", "title")
    rows = _listing(nodes).filter(F.col("n") >= least).join(roots, "map_id")
    if level == "brief":
        return nodes, roots.select("map_id", F.lit("").alias("error")).limit(0)
    user = F.to_json(F.struct("title", F.col("listing").alias("map")))
    asked = answers.ask(rows.select("map_id", user.alias("user")), "synthesis", F.col("user"), [F.lit(level), F.col("user")], level)
    told = asked.select("map_id", F.from_json("reply", "takeaways array<string>")["takeaways"].alias("ts"))
    parsed = F.transform(F.filter("ts", lambda t: t.startswith("{")), lambda t: F.from_json(t, "title string, note string, type string"))
    found = told.select("map_id", F.filter(parsed, lambda t: T.strip(F.coalesce(t["title"], F.lit(""))) != "").alias("ts")).filter(F.size("ts") > 0)
    at = nodes.groupBy("map_id").agg((F.coalesce(F.max(F.get("path", F.lit(0))), F.lit(-1)) + 1).alias("at"))
    head = found.join(at, "map_id")
    below = head.select("map_id", "at", F.posexplode("ts").alias("i", "t"))
    branch = _node(head, F.array("at"), F.lit("Key Takeaways"), F.lit("insight"))
    leaves = _node(below, F.array("at", "i"), T.strip(F.col("t.title")), T.node_type(F.col("t.type"), "insight"), F.nullif(T.strip(F.col("t.note")), F.lit("")))
    return nodes.select(NODES).unionByName(branch).unionByName(leaves), _failed(asked)


def draw_links(nodes: DataFrame, answers: Answers, level: str = "expert", cross: bool = False, limit: int = 8, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """Links (map_id, seq, a_path, b_path, label) that a model saw between nodes, and failures.

    Kept are pairs of nodes that exist and differ, once each, none above the other or, if cross, of different top
    branches. How many are asked for is the limit; how many come is the model's doing.
    """
    rows = _listing(nodes, sections=True).filter(F.col("n") >= least)
    user = F.to_json("listing")
    parts = [F.lit(level), F.lit(f"cross={cross}"), F.lit(f"limit={limit}"), F.col("user")]
    asked = answers.ask(rows.select("map_id", user.alias("user")), "link", F.col("user"), parts, level, limit)
    told = asked.select("map_id", F.posexplode(F.from_json("reply", "relationships array<string>")["relationships"]).alias("seq", "r")).filter(F.col("r").startswith("{"))
    told = written(told.select("map_id", "seq", F.from_json("r", "`from` int, to int, label string").alias("r")).select("map_id", "seq", F.col("r.from").alias("a"), F.col("r.to").alias("b"), F.col("r.label").alias("label")), "links")
    drawn = structuring.links_by_number(nodes, told, cross)
    labels = told.select("map_id", "seq", T.strip(F.coalesce("label", F.lit(""))).alias("label"))
    return drawn.join(labels, ["map_id", "seq"]).select("map_id", "seq", "a_path", "b_path", "label"), _failed(asked)


def label_folders(nodes: DataFrame, wanted: DataFrame, answers: Answers, most: int = 25) -> tuple[DataFrame, DataFrame]:
    """nodes whose wanted (map_id, path) folders have a model's label as their note, and failures (map_id, path, error).

    A request has the folder's name and its first `most` entries; a folder that failed, or got no label, keeps its note.
    """
    inside = nodes.filter(F.size("path") > 0).select("map_id", F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))).alias("path"), F.struct(F.try_element_at("path", F.lit(-1)).alias("at"), "title").alias("c"))
    first = Window.partitionBy("map_id", "path").orderBy("c.at")
    some = inside.join(wanted.select("map_id", "path"), ["map_id", "path"], "left_semi").withColumn("r", F.row_number().over(first)).filter(F.col("r") <= most)
    listed = some.groupBy("map_id", "path").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    rows = nodes.join(wanted.select("map_id", "path"), ["map_id", "path"], "left_semi").select("map_id", "path", "title").join(listed, ["map_id", "path"], "left")
    names = F.coalesce(F.transform("cs", lambda c: c["title"]), F.array().cast("array<string>"))
    user = F.to_json(F.struct(F.col("title").alias("folder"), names.alias("contents")))
    asked = answers.ask(rows.select("map_id", "path", user.alias("user")), "label", F.col("user"), [F.col("user")])
    label = F.nullif(T.strip(F.from_json("reply", "label string")["label"]), F.lit(""))
    told = nodes.join(asked.select("map_id", "path", label.alias("_label")), ["map_id", "path"], "left")
    return told.withColumn("note", F.coalesce("_label", "note")).select(nodes.columns), _failed(asked, "path")


# -- providers one after another


def fail_over(sources: DataFrame, attempts: list[tuple[str, Callable[[DataFrame], DataFrame]]], otherwise: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes of sources (map_id, ...), and (map_id, engine, used_fallback): who made each.

    Each attempt gets the sources that those before it gave no nodes, and is written before the next begins; what all
    leave goes to otherwise, by the name of heuristic and with used_fallback. With no attempts nothing fell back.
    """
    left, nodes, engines = written(sources, "sources"), None, None

    def add(name: str, made: DataFrame, fallback: bool) -> None:
        nonlocal nodes, engines
        who = made.select("map_id").distinct().select("map_id", F.lit(name).alias("engine"), F.lit(fallback).alias("used_fallback"))
        nodes = made if nodes is None else nodes.unionByName(made)
        engines = who if engines is None else engines.unionByName(who)

    for name, build in attempts:
        if left.isEmpty():
            break
        made = written(build(left), f"made-{name}")
        add(name, made, False)
        left = written(left.join(made.select("map_id").distinct(), "map_id", "left_anti"), "sources-left")
    if nodes is None or not left.isEmpty():
        add("heuristic", written(otherwise(left), "made-heuristic"), bool(attempts))
    return nodes, engines
