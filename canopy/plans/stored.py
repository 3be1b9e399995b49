"""Queries over what outlives a run: logs, snapshots of batches and of folder trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batches, foldertrees, heuristic, store
from .catalog import HEURISTIC, dotted, query, table


@query("""WITH l AS (SELECT event_id AS version, CASE WHEN event_id % 7919 = 0 THEN NULL ELSE 'user ' || user_id END AS key,
    CASE event_type WHEN 'error' THEN '{"event": ' || event_id WHEN 'signup' THEN NULL ELSE '{"event": ' || event_id || ', "type": "' || event_type || '"}' END AS value, event_type FROM events),
  live AS (SELECT * FROM l WHERE key IS NOT NULL AND version > coalesce((SELECT max(version) FROM l WHERE key IS NULL), -1) AND event_type <> 'error')
  SELECT key, value FROM live QUALIFY row_number() OVER (PARTITION BY key ORDER BY version DESC) = 1 AND value IS NOT NULL""")
def cache_log(spark, sf_dir):
    event = F.col("event_id").cast("string")
    told = F.concat(F.lit('{"event": '), event, F.lit(', "type": "'), F.col("event_type"), F.lit('"}'))
    value = F.when(F.col("event_type") == "error", F.concat(F.lit('{"event": '), event)).when(F.col("event_type") != "signup", told)
    key = F.when(F.col("event_id") % 7919 != 0, F.concat(F.lit("user "), F.col("user_id").cast("string")))
    return store.latest(table(spark, sf_dir, "events").select(key.alias("key"), value.alias("value"), F.col("event_id").alias("version")))


_BUILT = HEURISTIC.replace("FROM documents", "FROM cur")


@query(rf"""WITH cur AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'As it was. ' || coalesce(text, '') ELSE text END AS text FROM documents), {_BUILT},
  item AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)
  SELECT '' AS path, 'All' AS title, 'root' AS type, NULL AS note
  UNION ALL SELECT i || CASE WHEN path = '' THEN '' ELSE '.' || path END, CASE WHEN path = '' THEN 'Document ' || map_id ELSE title END, CASE WHEN path = '' THEN 'topic' ELSE type END, note FROM nodes JOIN item ON doc_id = map_id""")
def batch_snapshot(spark, sf_dir):
    """A second run of a batch: every fifth document had other text and no fingerprint in the first, every seventh another one."""
    docs = table(spark, sf_dir, "documents")
    was = docs.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("As it was. "), F.coalesce("text", F.lit("")))).otherwise(F.when(F.col("doc_id") % 7 == 0, "Gone.").otherwise(F.col("text"))))
    mark = F.when(F.col("doc_id") % 5 == 0, F.lit(None)).when(F.col("doc_id") % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    item = lambda mark: docs.select(F.col("doc_id").alias("source"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("label"), F.col("doc_id").alias("ordinal"), mark.cast("long").alias("fingerprint"))
    build = lambda texts: lambda todo: (heuristic.flat_map(texts.join(todo.select(F.col("source").alias("doc_id")), "doc_id", "left_semi")), None)
    kept = store.Store(spark)
    batches.run(kept, sf_dir, item(mark), build(was), "All")
    second = batches.run(kept, sf_dir, item(F.col("n_chars")), build(docs), "All")
    return second.nodes.select(dotted().alias("path"), "title", "type", "note")


def _listing(spark, sf_dir):
    """Regions, nations and customers as folders, orders as files, five levels with the root."""
    region, nation, customer, orders = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    path = lambda *parts: F.concat(*[x for p in parts for x in (F.lit("/"), p)])
    n = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    c = customer.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    o = orders.join(c, F.col("o_custkey") == F.col("c_custkey")).withColumn("name", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")))
    r_path, n_path = path(F.col("r_name")), path(F.col("r_name"), F.col("n_name"))
    c_path = path(F.col("r_name"), F.col("n_name"), F.col("c_name"))
    row = lambda df, at, parent, name, is_dir, size, depth: df.select(at.alias("path"), parent.cast("string").alias("parent"), name.alias("name"), F.lit(is_dir).alias("is_dir"), size.cast("long").alias("size"), F.lit(0.0).alias("mtime"), F.lit(depth).alias("depth"))
    files = row(spark.range(1), F.lit("/"), F.lit(None), F.lit("World"), True, F.lit(0), 0).unionByName(row(region, r_path, F.lit("/"), F.col("r_name"), True, F.lit(0), 1))
    files = files.unionByName(row(n, n_path, r_path, F.col("n_name"), True, F.lit(0), 2)).unionByName(row(c, c_path, n_path, F.col("c_name"), True, F.lit(0), 3))
    return files.unionByName(row(o, F.concat(c_path, F.lit("/"), "name"), c_path, F.col("name"), False, F.col("o_orderkey"), 4))


LISTING = """n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY lower(n_name), n_name) - 1 AS j FROM nation JOIN (SELECT *, row_number() OVER (ORDER BY lower(r_name), r_name) - 1 AS i FROM region) ON r_regionkey = n_regionkey),
  c AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY lower(c_name), c_name) - 1 AS k FROM customer JOIN n ON c_nationkey = n_nationkey),
  o AS (SELECT *, 'order ' || o_orderkey AS name, row_number() OVER (PARTITION BY o_custkey ORDER BY 'order ' || o_orderkey) - 1 AS l, count(*) OVER (PARTITION BY o_custkey) AS m FROM orders JOIN c ON o_custkey = c_custkey),
  tree AS (
  SELECT '' AS path, 'World' AS title, 'root' AS type, (SELECT count(*) FROM region) || ' folder(s), 0 file(s)' AS note
  UNION ALL SELECT DISTINCT CAST(i AS VARCHAR), r_name, 'topic', count(*) OVER (PARTITION BY r_regionkey) || ' folder(s), 0 file(s)' FROM n
  UNION ALL SELECT i || '.' || j, n_name, 'topic', nullif((SELECT count(*) FROM customer x WHERE x.c_nationkey = n.n_nationkey), 0) || ' folder(s), 0 file(s)' FROM n
  {deep})"""
SHALLOW = """UNION ALL SELECT i || '.' || j || '.' || k, c_name, 'topic', NULL FROM c
  UNION ALL SELECT DISTINCT i || '.' || j || '.' || k || '.0', '+' || m || ' more item(s)', 'detail', NULL FROM o"""
DEEP = """UNION ALL SELECT i || '.' || j || '.' || k, c_name, 'topic', '0 folder(s), ' || nullif((SELECT count(*) FROM orders x WHERE x.o_custkey = c.c_custkey), 0) || ' file(s)' FROM c
  UNION ALL SELECT i || '.' || j || '.' || k || '.' || l, name, 'detail', NULL FROM o WHERE l < 4
  UNION ALL SELECT DISTINCT i || '.' || j || '.' || k || '.4', '+' || (m - 4) || ' more file(s)', 'detail', NULL FROM o WHERE m > 4"""


@query(f"WITH {LISTING.format(deep=SHALLOW)} SELECT * FROM tree")
def folder_tree_capped(spark, sf_dir):
    return foldertrees.build(_listing(spark, sf_dir), max_depth=3).select(dotted().alias("path"), "title", "type", "note")


@query(f"WITH {LISTING.format(deep=DEEP)} SELECT * FROM tree")
def folder_tree(spark, sf_dir):
    return foldertrees.build(_listing(spark, sf_dir), max_files=4).select(dotted().alias("path"), "title", "type", "note")


# In the first run every folder got a label; then the orders of every ninth customer changed, which their nation, region and the root notice.
@query(f"""WITH {LISTING.format(deep=DEEP)}, hit AS (SELECT DISTINCT i, j, k FROM o WHERE o_custkey % 9 = 0)
  SELECT path, title, CASE WHEN type <> 'topic' THEN note
    WHEN path IN (SELECT CAST(i AS VARCHAR) FROM hit UNION ALL SELECT i || '.' || j FROM hit UNION ALL SELECT i || '.' || j || '.' || k FROM hit) THEN 'new ' || title ELSE 'old ' || title END AS note FROM tree""")
def tree_snapshot(spark, sf_dir):
    now = _listing(spark, sf_dir)
    ninth = F.regexp_extract("parent", "#0*([0-9]+)$", 1).try_cast("int") % 9 == 0
    was = now.withColumn("size", F.when(ninth & ~F.col("is_dir"), F.col("size") + 1).otherwise(F.col("size")))
    named = lambda word: lambda nodes, wanted: nodes.join(wanted.withColumn("_w", F.lit(word)), "path", "left").withColumn("note", F.when(F.col("_w").isNotNull(), F.concat("_w", "title")).otherwise(F.col("note"))).drop("_w")
    kept = store.Store(spark)
    foldertrees.run(kept, sf_dir, was, max_files=4, label=named("old "))
    second = foldertrees.run(kept, sf_dir, now, max_files=4, label=named("new "))
    return second.nodes.select(dotted().alias("path"), "title", "note")
