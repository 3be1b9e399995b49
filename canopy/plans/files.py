"""Queries over map files that are written from the given tables and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merging, store
from ..sources import mapfiles
from .catalog import LINKS, REGIONS, _numbered_links, _regions, dotted, query, table


def _files(spark, sf_dir):
    """A file a region, XMind with links where its key is even, else OPML; roots are named by their region."""
    names = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("map_id"), "r_name")
    nodes = _regions(spark, sf_dir).join(names, "map_id").withColumn("title", F.when(F.size("path") == 0, F.col("r_name")).otherwise(F.col("title")))
    nodes = nodes.withColumn("note", F.when(F.size("path") == 1, F.concat(F.lit("In "), "r_name"))).drop("r_name")
    links = _numbered_links(spark, sf_dir).withColumn("label", F.concat(F.lit("link "), F.col("seq").cast("string")))
    even = F.col("map_id") % 2 == 0
    xmind = mapfiles.render(nodes.filter(even), "xmind", links.filter(even), names.select("map_id", F.concat(F.lit("https://example.org/"), "r_name").alias("source")))
    opml = mapfiles.render(nodes.filter(~even), "opml")
    name = lambda form: F.concat(F.lit("maps/"), F.col("map_id").cast("string"), F.lit(f".{form}")).alias("path")
    files = xmind.select(name("xmind"), "content", F.col("map_id").alias("ordinal")).unionByName(opml.select(name("opml"), "content", F.col("map_id").alias("ordinal")))
    return store.written(files, "map-files")


@query(f"""WITH {REGIONS} SELECT '' AS path, 'Merged' AS title, 'root' AS type, NULL AS note
  UNION ALL SELECT CAST(r_regionkey AS VARCHAR), r_name, 'topic', NULL FROM region
  UNION ALL SELECT map_id || '.' || array_to_string(path, '.'), title, CASE WHEN len(path) = 1 THEN 'topic' ELSE 'detail' END, CASE WHEN len(path) = 1 THEN 'In ' || r_name END FROM node JOIN region ON r_regionkey = map_id""")
def merge_map_files(spark, sf_dir):
    tree, _, _ = merging.merge_files(_files(spark, sf_dir), "Merged")
    return tree.select(dotted().alias("path"), "title", "type", "note")


@query(f"""WITH {LINKS} SELECT CAST(map_id AS BIGINT) * 4294967296 + row_number() OVER (PARTITION BY map_id ORDER BY seq) - 1 AS seq, map_id || '.' || array_to_string(p, '.') AS a, map_id || '.' || array_to_string(q, '.') AS b, 'link ' || seq AS label
  FROM pair WHERE k = 1 AND map_id % 2 = 0""")
def merge_map_file_links(spark, sf_dir):
    _, links, _ = merging.merge_files(_files(spark, sf_dir), "Merged")
    return links.select("seq", dotted("a_path").alias("a"), dotted("b_path").alias("b"), "label")


@query(f"""WITH {LINKS} SELECT map_id, n_nodes, 3 AS depth, coalesce(n_links, 0) AS n_links FROM (SELECT map_id, count(*) + 1 AS n_nodes FROM node GROUP BY 1)
  LEFT JOIN (SELECT map_id, count(*) AS n_links FROM pair WHERE k = 1 GROUP BY 1) USING (map_id)""")
def map_counts(spark, sf_dir):
    return merging.counts(_regions(spark, sf_dir), _numbered_links(spark, sf_dir))


@query(f"""WITH {REGIONS} SELECT 'maps/' || map_id || CASE WHEN map_id % 2 = 0 THEN '.xmind' ELSE '.opml' END AS map_id, '0.' || array_to_string(path, '.') AS path, title FROM node
  WHERE contains(lower(title), '1') QUALIFY row_number() OVER (PARTITION BY map_id ORDER BY path) <= 10""")
def search_files(spark, sf_dir):
    found, failed = merging.search(_files(spark, sf_dir).select("path", "content"), "1")
    if some := failed.limit(5).collect():  # they were written just now: one that can't be read is a fault, not a file without a hit
        raise ValueError(f"files can't be searched: {', '.join(f'{r.map_id}: {r.error}' for r in some)}")
    return found.select("map_id", dotted().alias("path"), "title")
