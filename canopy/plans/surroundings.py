"""Queries around the maps: what there is to structure, what providers told of their limits, what is remembered."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import batches, provider, snapshots, store, usage
from ..sources import discovery, subtitles
from .catalog import LINKS, _numbered_links, _regions, query, table

# Which files an order's lesson has, by its number.
FILES = [[".mp4"], [".mp4", ".srt"], [".pdf"], [".srt"], [".MP3", ".srt", ".vtt"], [".docx"], [".mkv", ".m4a", ".txt", ".pdf"]]


@query("""WITH f AS (SELECT o_custkey AS folder, o_orderkey % 7 AS k, o_orderkey % 100 AS a, o_orderkey AS b, 'Part_' || (o_orderkey % 100) || '-' || o_orderkey AS stem FROM orders),
  r(k, ext, waits, rank, lead) AS (VALUES (0, '.mp4', TRUE, 0, '.mp4'), (1, '.srt', FALSE, 0, '.mp4'), (2, '.pdf', FALSE, 2, '.pdf'), (3, '.srt', FALSE, 1, '.srt'), (4, '.vtt', FALSE, 0, '.MP3'),
    (6, '.txt', FALSE, 0, '.m4a'), (6, '.txt', FALSE, 0, '.mkv'), (6, '.pdf', FALSE, 2, '.pdf'))
  SELECT folder, row_number() OVER (PARTITION BY folder ORDER BY a, b, rank, lead) - 1 AS seq, stem || ext AS name, 'Part ' || a || ' ' || b AS title, waits AS needs_transcription FROM f JOIN r USING (k)""")
def course_sources(spark, sf_dir):
    """Customers as course folders, their orders as lessons of one to four files."""
    key = F.col("o_orderkey")
    stem = F.concat(F.lit("Part_"), (key % 100).cast("string"), F.lit("-"), key.cast("string"))
    sets = F.array(*[F.array(*[F.lit(x) for x in some]) for some in FILES])
    files = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("folder"), stem.alias("stem"), F.explode(F.get(sets, (key % 7).cast("int"))).alias("ext"))
    return discovery.course(files.select("folder", F.concat("stem", "ext").alias("name")))


ENTRIES = "e AS (SELECT event_id // 50 AS list_id, event_id, event_id % 5 AS k FROM events)"


def _lists(spark, sf_dir):
    """Fifty events in a row are a list: some entries are null, some lack a title, an id or both; every eleventh list is cut off."""
    event = F.col("event_id").cast("string")
    whole = F.concat(F.lit('{"id": "v'), event, F.lit('", "title": "T '), event, F.lit('"}'))
    bare, elsewhere = F.concat(F.lit('{"id": "v'), event, F.lit('", "title": ""}')), F.concat(F.lit('{"url": "https://example.org/'), event, F.lit('", "title": null}'))
    entry = F.get(F.array(F.lit("null"), whole, bare, elsewhere, F.lit('{"title": "x"}')), (F.col("event_id") % 5).cast("int"))
    rows = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 50).alias("list_id"), F.struct("event_id", entry.alias("e")).alias("e"))
    lists = rows.groupBy("list_id").agg(F.array_sort(F.collect_list("e")).alias("es"))
    title = F.when(F.col("list_id") % 3 == 0, "").otherwise(F.concat(F.lit('"title": "List '), F.col("list_id").cast("string"), F.lit('", ')))
    content = F.concat(F.lit("{"), title, F.lit('"entries": ['), F.array_join(F.transform("es", lambda x: x["e"]), ", "), F.lit("]"), F.when(F.col("list_id") % 11 == 5, "").otherwise("}"))
    return lists.select("list_id", content.alias("content"))


@query(f"""WITH {ENTRIES} SELECT list_id, CASE WHEN list_id % 3 = 0 THEN 'Playlist' ELSE 'List ' || list_id END AS list_title, CAST(row_number() OVER (PARTITION BY list_id ORDER BY event_id) - 1 AS INTEGER) AS seq,
  CASE k WHEN 1 THEN 'T ' || event_id WHEN 2 THEN 'v' || event_id ELSE 'Untitled' END AS title, CASE WHEN k = 3 THEN 'https://example.org/' || event_id ELSE 'https://www.youtube.com/watch?v=v' || event_id END AS url
  FROM e WHERE k IN (1, 2, 3) AND list_id % 11 <> 5""")
def listing_entries(spark, sf_dir):
    return discovery.listing(_lists(spark, sf_dir))[0]


@query(f"WITH {ENTRIES} SELECT DISTINCT list_id, 'no data returned' AS error FROM e WHERE list_id % 11 = 5")
def listing_failures(spark, sf_dir):
    return discovery.listing(_lists(spark, sf_dir))[1]


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\r\n|[\n\r]')) AS line, generate_subscripts(string_split_regex(text, '\r\n|[\n\r]'), 1) AS pos FROM documents),
  s AS (SELECT doc_id, pos, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line FROM l WHERE contains(line, '='))
  SELECT doc_id AS file, regexp_replace(line[:instr(line, '=') - 1], '\s+$', '') AS key, arg_max(trim(trim(regexp_replace(line[instr(line, '=') + 1:], '^\s+', ''), '"'), ''''), pos) AS value
  FROM s WHERE NOT starts_with(line, '#') GROUP BY 1, 2""")
def file_settings(spark, sf_dir):
    """The lines KEY=value of all documents."""
    return discovery.settings(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), "text"))


def _responses(spark, sf_dir):
    """Events as responses: some tell limits in headers, errors are refusals with a daily budget, another limit or nothing."""
    n, text = F.col("event_id"), lambda c: c.cast("string")
    header = F.create_map(F.lit("x-ratelimit-limit-requests"), text(n * 2), F.lit("x-ratelimit-limit-tokens"), text(n * 3),
                          F.lit("x-ratelimit-reset-requests"), F.concat(text(n % 60), F.lit("m"), text(n % 7), F.lit(".5s")))
    more = F.map_concat(header, F.create_map(F.lit("x-ratelimit-remaining-requests"), text(n)))
    headers = F.when(n % 4 == 0, header).when(n % 4 == 1, more)
    daily = F.concat(F.lit("Rate limit reached on tokens per day (TPD): Limit 100000, Used "), text(n))
    other = F.concat(F.lit("Quota exceeded for metric: example.org/requests,\n limit: "), text(n), F.lit(". Please retry."))
    body = F.when(n % 3 == 0, daily).when(n % 3 == 1, other)
    status = F.when(F.col("event_type") == "error", 429).otherwise(200)
    return table(spark, sf_dir, "events").select(text(F.col("user_id") % 7).alias("provider"), F.concat(F.lit("m"), text(n % 2)).alias("model"), F.col("ts").alias("at"), status.alias("status"), headers.alias("headers"), body.alias("body"))


@query("""WITH r AS (SELECT CAST(user_id % 7 AS VARCHAR) AS provider, event_id AS n, ts, event_type = 'error' AS refused, event_id % 4 < 2 AS tells FROM events),
  d AS (SELECT provider, count(*) AS calls_today FROM r JOIN (SELECT provider, max(CAST(ts AS DATE)) AS day FROM r GROUP BY 1) USING (provider) WHERE CAST(ts AS DATE) = day GROUP BY 1)
  SELECT r.provider, arg_max('m' || n % 2, ts) AS model, arg_max(n * 2, ts) FILTER (tells) AS limit_requests, arg_max(CASE WHEN n % 4 = 1 THEN n ELSE n * 2 END, ts) FILTER (tells) AS remaining_requests,
    arg_max(n * 3, ts) FILTER (tells) AS limit_tokens, CAST(NULL AS BIGINT) AS remaining_tokens, CAST(arg_max(n % 60 * 60 + n % 7 + 0.5, ts) FILTER (tells) AS DOUBLE) AS reset_requests_seconds,
    CAST(NULL AS DOUBLE) AS reset_tokens_seconds, max(ts) FILTER (tells) AS observed_at,
    CASE WHEN count(*) FILTER (refused AND n % 3 = 0) > 0 THEN 'tokens per day (TPD)' END AS daily_metric, CASE WHEN count(*) FILTER (refused AND n % 3 = 0) > 0 THEN CAST(100000 AS BIGINT) END AS daily_value,
    arg_max(n, ts) FILTER (refused AND n % 3 = 0) AS daily_used, max(ts) FILTER (refused AND n % 3 = 0) AS daily_at,
    CASE WHEN count(*) FILTER (refused AND n % 3 = 1) > 0 THEN 'example.org/requests' END AS limit_metric, arg_max(n, ts) FILTER (refused AND n % 3 = 1) AS limit_value,
    max(ts) FILTER (refused AND n % 3 = 1) AS limit_at, count(*) AS calls, any_value(calls_today) AS calls_today FROM r JOIN d USING (provider) GROUP BY 1""")
def provider_quota(spark, sf_dir):
    return usage.quota(_responses(spark, sf_dir))


@query("""WITH r AS (SELECT user_id AS provider, event_id AS run, event_type = 'error' AND user_id % 10 <> 3 AS hit, 2.0 + event_id % 28 AS pace FROM events),
  l AS (SELECT provider, max(run) AS last, arg_max(pace, run) AS p FROM r WHERE hit GROUP BY 1),
  a AS (SELECT provider, any_value(p) AS p, count(*) FILTER (run > last) AS k FROM r LEFT JOIN l USING (provider) GROUP BY 1)
  SELECT provider, CAST(round(CASE WHEN p IS NULL THEN 2.0 WHEN k = 0 THEN p ELSE greatest(2.0, p * pow(0.85, k)) END, 6) AS DOUBLE) AS pace FROM a""")
def provider_pace(spark, sf_dir):
    """Events as runs, errors as refused ones; every tenth provider never was refused."""
    runs = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("provider"), F.col("event_id").alias("run"), ((F.col("event_type") == "error") & (F.col("user_id") % 10 != 3)).alias("hit_limit"),
        (F.col("event_id") % 28 + 2).cast("double").alias("pace"), F.lit(2.0).alias("default_pace"),
    )
    return usage.learned_pace(runs).select("provider", F.round("pace", 6).alias("pace"))


@query("""WITH s AS (SELECT o_orderkey, CAST(o_orderkey AS BIGINT) * 128 * CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1024 ELSE 1048576 END AS n, CAST(o_orderkey AS DOUBLE) * 0.125 AS t FROM orders)
  SELECT o_orderkey, CASE WHEN n < 1024 THEN n || 'B' WHEN n < 1048576 THEN printf('%.1fKB', n / 1024) WHEN n < 1073741824 THEN printf('%.1fMB', n / 1048576) ELSE printf('%.1fGB', n / 1073741824) END AS size,
    CASE WHEN t < 1 THEN printf('%.0fms', t * 1000) WHEN t < 60 THEN printf('%.0fs', t) WHEN t < 3600 THEN printf('%dm%02ds', CAST(floor(t) AS BIGINT) // 60, CAST(floor(t) AS BIGINT) % 60)
      ELSE printf('%dh%02dm', CAST(floor(t) AS BIGINT) // 3600, CAST(floor(t) AS BIGINT) // 60 % 60) END AS duration FROM s""")
def readable_sizes(spark, sf_dir):
    key = F.col("o_orderkey").cast("long")
    size = key * 128 * F.when(key % 3 == 0, 1).when(key % 3 == 1, 1024).otherwise(1048576)
    return table(spark, sf_dir, "orders").select("o_orderkey", T.human_size(size).alias("size"), T.duration_text(key * 0.125).alias("duration"))


@query("""SELECT 'documents' AS source, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'labels', 0""")
def remembered(spark, sf_dir):
    """A store with two versions of documents, of which the last counts, pages, a source without rows, and one that was forgotten."""
    kept = store.Store(spark)
    docs, pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source")), table(spark, sf_dir, "pages").select(F.col("url").alias("source"))
    for source, version, rows in (("documents", 1, pages), ("documents", 2, docs), ("pages", 1, pages), ("events", 1, docs)):
        kept.append("items", source, version, rows)
        kept.commit(source, version, "")
    kept.commit("labels", 1, "")
    kept.forget("events")
    return kept.listing("items").select("source", "n")


@query(f"""WITH {LINKS}, o AS (SELECT CASE n_nationkey % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'reused' ELSE 'ok' END AS s FROM nation),
  m AS (SELECT (SELECT count(*) FROM node) + (SELECT count(*) FROM region) + 1 AS nodes, (SELECT count(*) FROM pair WHERE k = 1) AS links, count(*) AS t, count(*) FILTER (s <> 'failed') AS ok, count(*) FILTER (s = 'failed') AS f, count(*) FILTER (s = 'reused') AS r, count(*) FILTER (s = 'ok') AS a FROM o)
  SELECT '{{"ok":true,"title":"World","level":"full","nodes":' || nodes || ',"depth":4,"relationships":' || links || ',"cross_source_relationships":0,"items_total":' || t || ',"items_ok":' || ok
    || ',"items_failed":' || f || ',"reused":' || r || ',"added":' || a || ',"removed":0}}' AS result FROM m""")
def batch_result(spark, sf_dir):
    """Regions as the branches of one map, nations as the items of a batch."""
    items = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("source"), F.col("r_name").alias("label"), F.col("r_regionkey").alias("ordinal"))
    links = _numbered_links(spark, sf_dir).withColumn("label", F.lit("see"))
    nodes, moved = batches.combined(items, _regions(spark, sf_dir), links, "World")
    status = F.when(F.col("n_nationkey") % 4 == 0, "failed").when(F.col("n_nationkey") % 4 == 1, "reused").otherwise("ok")
    outcomes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("source"), F.col("n_name").alias("label"), status.alias("status"))
    diff = outcomes.filter("status <> 'failed'").select("label", F.when(F.col("status") == "ok", "added").otherwise("reused").alias("status"))
    return batches.result(batches.Batch(nodes, moved, outcomes, diff, 1), title="World", level="full")


@query(r"""SELECT p_partkey, coalesce(nullif(substring(replace(trim(regexp_replace(p_type || '/' || p_brand || CASE WHEN p_partkey % 2 = 0 THEN repeat(' long', 20) ELSE '!' END, '[^\w\- ]+', '', 'g')), ' ', '_'), 1, 80), ''), 'mindmap')
  || CASE WHEN p_partkey % 3 = 0 THEN '.xmind' ELSE '.opml' END AS name FROM part""")
def export_names(spark, sf_dir):
    """What files maps of the parts would be written to."""
    key = F.col("p_partkey")
    title = F.concat("p_type", F.lit("/"), "p_brand", F.when(key % 2 == 0, " long" * 20).otherwise("!"))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(T.safe_filename(title), F.when(key % 3 == 0, ".xmind").otherwise(".opml")).alias("name"))


@query(r"""WITH t AS (SELECT doc_id, doc_id % 4 AS k, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[^\x{0}-\x{FF}]', '?', 'g') AS narrow FROM documents),
  d AS (SELECT doc_id, CASE WHEN k = 0 OR (k = 1 AND regexp_full_match(narrow, '[\x{0}-\x{7F}]*')) THEN 'utf-8' WHEN k < 3 THEN 'cp1252' ELSE 'latin-1' END AS encoding,
    CASE k WHEN 0 THEN text WHEN 1 THEN narrow WHEN 2 THEN '“' || narrow ELSE chr(129) || narrow END AS text FROM t)
  SELECT doc_id, encoding, CASE WHEN encoding <> 'utf-8' THEN 'not UTF-8, read as ' || encoding || '; some characters may be wrong' END AS warning, length(text) AS n, md5(text) AS digest FROM d""")
def decoded_texts(spark, sf_dir):
    """Documents as bytes: UTF-8, Latin-1, and that after a byte that only the Windows code page has, or none has."""
    text, k = F.coalesce("text", F.lit("")), F.col("doc_id") % 4
    narrow = F.encode(F.regexp_replace(text, "[^\\x00-\\xff]", "?"), "ISO-8859-1")
    content = F.when(k == 0, F.encode(text, "UTF-8")).when(k == 1, narrow).when(k == 2, F.concat(F.unhex(F.lit("93")), narrow)).otherwise(F.concat(F.unhex(F.lit("81")), narrow))
    rows = table(spark, sf_dir, "documents").select("doc_id", content.alias("c"))
    told = subtitles.decode(F.col("c"))
    return rows.select("doc_id", subtitles.encoding(F.col("c")).alias("encoding"), subtitles.warning(F.col("c")).alias("warning"), F.length(told).cast("long").alias("n"), F.md5(told).alias("digest"))


@query("""SELECT event_id, CASE WHEN event_id % 5 < 4 THEN '{"k":' || event_id || ',"t":["' || event_type || '"]}' END AS reply FROM events""")
def parsed_replies(spark, sf_dir):
    """Events as replies of a model: plain, in a fence, in a fence without a name, amid prose, and cut off."""
    body = F.concat(F.lit('{"t": ["'), "event_type", F.lit('"], "k": '), F.col("event_id").cast("string"), F.lit("}"))
    made = [body, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```")), F.concat(F.lit("```"), body, F.lit("```\n")), F.concat(F.lit("It is: "), body, F.lit(" - done.")), F.rtrim(body, F.lit("}"))]
    reply = provider.parse_json(F.get(F.array(*made), (F.col("event_id") % 5).cast("int")))
    return table(spark, sf_dir, "events").select("event_id", F.to_json(reply).alias("reply"))


@query("""SELECT user_id AS "group", CASE max(CASE event_type WHEN 'error' THEN CASE WHEN value > 150 THEN 2 ELSE 1 END WHEN 'signup' THEN CASE WHEN value > 400 THEN 1 ELSE 0 END ELSE 0 END) WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'ok' END AS worst FROM events GROUP BY 1""")
def worst_checks(spark, sf_dir):
    """Events as checks of their users."""
    error = F.col("event_type") == "error"
    status = F.when(error & (F.col("value") > 150), "fail").when(error | ((F.col("event_type") == "signup") & (F.col("value") > 400)), "warn").otherwise("ok")
    return snapshots.diagnostics(table(spark, sf_dir, "events").select(F.col("user_id").alias("group"), status.alias("status")))
