"""Queries of maps that a model fills; the model is one that answers with the request's own words."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import anchors, heuristic, modelled
from ..operators.echo import EchoProvider
from ..operators.requests import Answers
from ..operators.store import Log
from .catalog import CHUNKS, REGIONS, _regions, dotted, query, table, topic_chunks


def _answers(spark, **options) -> Answers:
    return Answers(EchoProvider(**options), Log(spark))


SPLIT = r"list_filter(regexp_split_to_array({}, '\s+'), lambda x: x <> '')"
FEW = "array_to_string(w[{}:{}], ' ')"


@query(rf"""WITH RECURSIVE {CHUNKS}, p AS (SELECT doc_id AS map_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk) - 1 AS i, {SPLIT.format('text')} AS w FROM chunk),
  q AS (SELECT *, {FEW.format(1, 3)} AS topic, {FEW.format(1, 12)} AS summary FROM p)
  SELECT map_id, '' AS path, coalesce(nullif(topic, ''), 'Mind Map') AS title, 'root' AS type, NULL AS note FROM q WHERE i = 0
  UNION ALL SELECT map_id, CAST(i AS VARCHAR), coalesce(nullif(topic, ''), 'Untitled'), 'concept', nullif(summary, '') FROM q
  UNION ALL SELECT map_id, i || '.0', coalesce(nullif({FEW.format(1, 2)}, ''), 'Untitled'), 'example', NULL FROM q
  UNION ALL SELECT map_id, i || '.1', coalesce(nullif({FEW.format(3, 4)}, ''), 'Untitled'), 'topic', NULL FROM q
  UNION ALL SELECT map_id, i || '.' || j || '.0', trim('of ' || topic), 'detail', NULL FROM q, (VALUES (0), (1)) v(j)""")
def nested_reduce(spark, sf_dir):
    """The chunks of all documents, mapped in batches, and reduced to trees of three levels."""
    parts = topic_chunks(spark, sf_dir).select(F.col("doc_id").alias("map_id"), F.col("chunk").alias("part"), "text")
    answers = _answers(spark)
    mapped = modelled.map_parts(parts, answers)
    sources = mapped.select("map_id", F.lit("").alias("title")).distinct()
    nodes, _ = modelled.reduce_parts(mapped, sources, answers)
    return nodes.select("map_id", dotted().alias("path"), "title", "type", "note")


def _turns(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return rows.select(F.col("conv_id").alias("map_id"), k.alias("number"), F.col("role").alias("heading"), (F.col("turn") * 5).cast("double").alias("start"), T.collapse(F.coalesce("text", F.lit(""))).alias("text"))


@query(rf"""WITH t AS (SELECT conv_id AS map_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, role, turn * 5 AS s, {SPLIT.format("coalesce(text, '')")} AS w FROM conversations),
  e AS (SELECT map_id, n, CASE WHEN n % 2 = 1 THEN 'Heading ' || n ELSE role END AS h, s, w FROM t UNION ALL SELECT map_id, NULL, 'Overview', s, w FROM t WHERE n = 1 AND len(w) >= 40),
  p AS (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY n NULLS FIRST) - 1 AS i FROM e)
  SELECT DISTINCT map_id, '' AS path, 'Talk ' || map_id AS title, 'root' AS type, NULL AS note, CAST(NULL AS DOUBLE) AS timestamp FROM t
  UNION ALL SELECT map_id, CAST(i AS VARCHAR), CASE WHEN n IS NULL THEN h ELSE n || '. ' || h END, 'topic', nullif({FEW.format(1, 8)}, ''), CAST(s AS DOUBLE) FROM p
  UNION ALL SELECT map_id, i || '.0', h, 'insight', NULL, NULL FROM p""")
def section_fill(spark, sf_dir):
    """Conversations as numbered sections, their first turn being the introduction too."""
    turns = _turns(spark, sf_dir)
    sources = turns.select("map_id", F.concat(F.lit("Talk "), F.col("map_id").cast("string")).alias("title")).distinct()
    nodes, _ = modelled.fill_sections(turns, turns.filter("number = 1").select("map_id", "start", "text"), sources, _answers(spark))
    return nodes.select("map_id", dotted().alias("path"), "title", "type", "note", "timestamp")


@query(rf"""WITH f AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS page, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS text FROM conversations),
  l AS (SELECT o.conv_id AS map_id, o.page // 2 AS k, o.page, coalesce(string_agg(f.text, ' ' ORDER BY f.page) FILTER (WHERE f.text <> ''), '') AS text
    FROM f o JOIN f ON f.conv_id = o.conv_id AND f.page >= o.page AND f.page < o.page + 2 WHERE o.page % 2 = 0 GROUP BY ALL),
  w AS (SELECT *, {SPLIT.format('text')} AS w FROM l)
  SELECT DISTINCT map_id, '' AS path, 'Document' AS title, 'root' AS type, NULL AS note FROM l
  UNION ALL SELECT map_id, CAST(k AS VARCHAR), 'T' || page, 'topic', nullif({FEW.format(1, 12)}, '') FROM w
  UNION ALL SELECT map_id, k || '.0', {FEW.format(1, 2)}, 'example', NULL FROM w WHERE len(w) > 0
  UNION ALL SELECT map_id, k || '.1', {FEW.format(3, 4)}, 'topic', NULL FROM w WHERE len(w) > 2""")
def outline_enriched(spark, sf_dir):
    """Conversations as documents of a page a turn, every second one beginning an entry."""
    turns = _turns(spark, sf_dir).select(F.col("map_id").alias("source"), (F.col("number") - 1).alias("seq"), "text")
    heads = turns.filter("seq % 2 = 0").select("source", F.floor(F.col("seq") / 2).cast("int").alias("seq"), F.lit(1).alias("level"), F.concat(F.lit("T"), F.col("seq").cast("string")).alias("title"), F.col("seq").alias("page"))
    sources = turns.select(F.col("source").alias("map_id"), F.lit("").alias("title")).distinct()
    nodes, _ = modelled.enrich_outline(heads, turns, sources, _answers(spark))
    return nodes.select("map_id", dotted().alias("path"), "title", "type", "note")


@query(f"""WITH {REGIONS}, r AS (SELECT s_suppkey % 5 AS map_id, s_suppkey AS seq, s_suppkey * 13 % 90 - 3 AS t, s_name AS title, s_nationkey FROM supplier),
  g AS (SELECT r.map_id, seq, path AS parent, r.title, CASE WHEN s_nationkey % 2 = 0 THEN 'example' ELSE 'topic' END AS type FROM r JOIN walk ON walk.map_id = r.map_id AND pos = t),
  below AS (SELECT map_id, path[1:len(path) - 1] AS parent, max(path[len(path)]) + 1 AS taken FROM node WHERE len(path) > 1 GROUP BY ALL)
  SELECT map_id, array_to_string(path, '.') AS path, title, CASE WHEN len(path) = 1 THEN 'topic' ELSE 'detail' END AS type FROM node
  UNION ALL SELECT r_regionkey, '', 'Region', 'root' FROM region
  UNION ALL SELECT g.map_id, array_to_string(g.parent || [CAST(coalesce(taken, 0) + row_number() OVER (PARTITION BY g.map_id, g.parent ORDER BY seq) - 1 AS INTEGER)], '.'), title, type FROM g LEFT JOIN below b ON b.map_id = g.map_id AND b.parent = g.parent""")
def anchors_repaired(spark, sf_dir):
    """Leaves for every supplier below the node that its key points at, where there is one."""
    key = F.col("s_suppkey")
    kind = F.when(F.col("s_nationkey") % 2 == 0, "example").otherwise("no such type")
    repairs = table(spark, sf_dir, "supplier").select((key % 5).cast("int").alias("map_id"), key.alias("seq"), (key * 13 % 90 - 3).alias("to"), F.col("s_name").alias("title"), kind.alias("type"))
    return anchors.repair(_regions(spark, sf_dir), repairs).select("map_id", dotted().alias("path"), "title", "type")


@query(r"""WITH c AS (SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE contains(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), 'rr')) AS a,
    count(*) FILTER (WHERE contains(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), 'ou')) AS b FROM conversations GROUP BY 1)
  SELECT conv_id AS map_id, CASE WHEN a = 0 THEN 'one' WHEN b = 0 THEN 'two' ELSE 'heuristic' END AS engine, a > 0 AND b > 0 AS used_fallback, CASE WHEN a > 0 AND b > 0 THEN 1 ELSE n END AS n_nodes FROM c""")
def provider_failover(spark, sf_dir):
    """A provider after another for the conversations that the one before didn't answer whole."""
    turns = _turns(spark, sf_dir)

    def by(name: str, fails_on: str):
        answers = _answers(spark, name=name, fails_on=fails_on)

        def build(left):
            mapped = modelled.map_parts(turns.join(left, "map_id", "left_semi").select("map_id", F.col("number").alias("part"), "text"), answers, passes=1)
            holes = mapped.filter("reply is null").select("map_id").distinct()
            return mapped.join(holes, "map_id", "left_anti").select("map_id", F.array("part").alias("path"), F.from_json("reply", "topic string")["topic"].alias("title"))

        return name, build

    plain = lambda left: left.select("map_id", F.array(F.lit(1)).alias("path"), F.lit("(heuristic)").alias("title"))
    nodes, engines = modelled.fail_over(turns.select("map_id").distinct(), [by("one", "rr"), by("two", "ou")], plain)
    return engines.join(nodes.groupBy("map_id").agg(F.count("*").alias("n_nodes")), "map_id").select("map_id", "engine", "used_fallback", "n_nodes")


@query(f"""WITH {REGIONS}, l AS (SELECT map_id, arg_max(path, pos) AS last, max(pos) + 1 AS n FROM walk GROUP BY 1)
  SELECT map_id, '0' AS a, array_to_string(last, '.') AS b, 'first and last' AS label FROM l WHERE n >= 3 AND last[1] <> 0""")
def drawn_links(spark, sf_dir):
    links, _ = modelled.draw_links(_regions(spark, sf_dir), _answers(spark))
    return links.select("map_id", dotted("a_path").alias("a"), dotted("b_path").alias("b"), "label")


@query(f"""WITH {REGIONS}, t AS (SELECT map_id, max(path[1]) + 1 AS k, count(*) AS n FROM node GROUP BY 1)
  SELECT map_id, CAST(k AS VARCHAR) AS path, 'Key Takeaways' AS title, 'insight' AS type, NULL AS note FROM t WHERE n >= 3
  UNION ALL SELECT map_id, k || '.0', 'All of Region', 'insight', CAST(n AS VARCHAR) FROM t WHERE n >= 3""")
def takeaways(spark, sf_dir):
    nodes = _regions(spark, sf_dir).withColumn("timestamp", F.lit(None).cast("double"))
    more, _ = modelled.take_away(nodes, _answers(spark))
    return more.filter("type = 'insight'").select("map_id", dotted().alias("path"), "title", "type", "note")


@query()
def anchor_requests(spark, sf_dir):
    """The heuristic maps of all documents, with the anchors that they had lost put back where the model says."""
    docs = table(spark, sf_dir, "documents")
    nodes, _ = modelled.repair_anchors(heuristic.flat_map(docs), docs.select(F.col("doc_id").alias("map_id"), "text"), _answers(spark))
    return nodes.select("map_id", dotted().alias("path"), "title", "type")
