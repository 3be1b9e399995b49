"""The queries over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import anchors, enumeration, heuristic, outlines, provider, segments, snapshots, structuring, trees
from ..sources import article, markdown, spans, subtitles
from ..streaming import events as streams
from . import maps

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dotted(path="path"):
    return F.array_join(F.transform(path, lambda x: x.cast("string")), ".")


# Cleaned, dense segments of documents; most SQL below begins with them.
SEGS = r"""
raw AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)),
  lambda s: trim(regexp_replace(regexp_replace(s, '[\[(]\s*(?:music|applause|laughter|silence|inaudible|crosstalk|background noise)\s*[\])]', '', 'gi'), '\s+', ' ', 'g'))),
  lambda s: s <> '') AS segs FROM documents),
seg AS (SELECT doc_id, i - 1 AS seq, segs[i] AS text, len(segs) AS n FROM (SELECT doc_id, segs, unnest(range(1, len(segs) + 1)) AS i FROM raw))
"""
WORDS = r"len(list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> ''))"
SENTS = r"list_filter(list_transform(string_split(regexp_replace({}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


def cut_sql(c: str, n: int) -> str:
    head = f"substring({c}, 1, {n})"
    body = f"regexp_replace({head}, ' [^ ]*$', '')"
    return f"CASE WHEN length({c}) <= {n} THEN {c} ELSE regexp_replace(CASE WHEN {body} = '' THEN {head} ELSE {body} END, '[,;:. ]+$', '') || '…' END"


@query(f"WITH {SEGS} SELECT doc_id, CAST(seq AS INTEGER) AS seq, text, CAST(0 AS DOUBLE) AS start, CAST(0 AS DOUBLE) AS duration FROM seg")
def plain_text_segments(spark, sf_dir):
    return segments.segments(table(spark, sf_dir, "documents"))


@query(r"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(CASE WHEN turn % 2 = 0 THEN '[Music] ' ELSE '( applause ) ' END || coalesce(text, ''),
  '[\[(]\s*(?:music|applause|laughter)\s*[\])]', '', 'gi'), '\s+', ' ', 'g')) AS text FROM conversations""")
def caption_noise_clean(spark, sf_dir):
    mark = F.when(F.col("turn") % 2 == 0, "[Music] ").otherwise("( applause ) ")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.clean_caption(F.concat(mark, F.coalesce("text", F.lit("")))).alias("text"))


@query("SELECT event_id, CAST(extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + floor(extract(second FROM ts)) AS DOUBLE) + (extract(millisecond FROM ts) % 1000) / 1000.0 AS seconds FROM events")
def timestamp_parse(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.timestamp_seconds(F.date_format("ts", "HH:mm:ss,SSS")).alias("seconds"))


@query(r"""WITH t AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace('<c>' || trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) || '</c>', '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS text FROM conversations)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS seq, text, CAST(turn * 5 AS DOUBLE) AS start, CAST(4 AS DOUBLE) AS duration FROM t WHERE text <> ''""")
def cue_blocks(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    clock = lambda s: F.format_string("%02d:%02d:%02d.000", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    start = F.col("turn").cast("long") * 5
    cue = F.concat(clock(start), F.lit(" --> "), clock(start + 4), F.lit("\n<c>"), T.collapse(F.col("text")), F.lit("</c>"))
    packed = rows.select("conv_id", F.struct("turn", cue.alias("cue")).alias("c")).groupBy("conv_id").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    text = F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("cs", lambda c: c["cue"]), "\n\n"))
    return subtitles.parse(packed.select("conv_id", text.alias("text")), "conv_id")


@query(f"WITH {SEGS} SELECT doc_id, count(*) AS n_segments, CAST(sum({WORDS.format('text')}) AS BIGINT) AS n_words, CAST(0 AS DOUBLE) AS duration FROM seg GROUP BY doc_id")
def transcript_stats(spark, sf_dir):
    return subtitles.stats(segments.segments(table(spark, sf_dir, "documents")), "doc_id")


@query(f"WITH {SEGS}, s AS (SELECT doc_id, seq, {SENTS.format('text')} AS ss FROM seg) SELECT doc_id, CAST(seq AS INTEGER) AS seq, CAST(i - 1 AS INTEGER) AS i, ss[i] AS sentence FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS i FROM s)")
def sentences(spark, sf_dir):
    segs = segments.segments(table(spark, sf_dir, "documents"))
    return segs.select("doc_id", "seq", F.posexplode(T.sentences(F.col("text"))).alias("i", "sentence"))


@query(f"WITH {SEGS}, c AS (SELECT doc_id, seq, {cut_sql('text', 60)} AS t, {cut_sql('text', 90)} AS note FROM seg) SELECT doc_id, CAST(seq AS INTEGER) AS seq, upper(substring(t, 1, 1)) || substring(t, 2) AS title, note FROM c")
def truncate_titles(spark, sf_dir):
    segs = segments.segments(table(spark, sf_dir, "documents"))
    return segs.select("doc_id", "seq", T.snippet_title(F.col("text")).alias("title"), T.truncate(F.col("text"), 90).alias("note"))


HEURISTIC = rf"""
{SEGS}, per AS (SELECT doc_id, segs, len(segs) AS n, greatest(1, len(segs) // greatest(1, least(9, len(segs)))) AS per FROM raw),
cnt AS (SELECT *, CASE WHEN ceil(n / per) > 1 AND n % per > 0 AND n % per < greatest(1, per // 2) THEN ceil(n / per) - 1 ELSE ceil(n / per) END AS k FROM per),
ch AS (SELECT doc_id, i, array_to_string(CASE WHEN i = k - 1 THEN segs[CAST(i * per + 1 AS BIGINT):] ELSE segs[CAST(i * per + 1 AS BIGINT):CAST((i + 1) * per AS BIGINT)] END, ' ') AS text
  FROM (SELECT *, unnest(range(0, CAST(k AS BIGINT))) AS i FROM cnt WHERE n > 0)),
st AS (SELECT doc_id, i, text, {SENTS.format('text')} AS ss FROM ch),
hd AS (SELECT *, coalesce(ss[1], text) AS head, ss[2:] AS body FROM st),
pt AS (SELECT doc_id, i, list_filter(list_transform(range(1, len(body) + 1), lambda j: CASE WHEN (j - 1) % greatest(1, len(body) // 3) = 0 THEN body[j] END), lambda x: x IS NOT NULL)[1:3] AS ps FROM hd),
px AS (SELECT doc_id, i, j, ps[j] AS p FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS j FROM pt)),
nodes AS (
  SELECT doc_id AS map_id, '' AS path, 'Mind Map' AS title, 'root' AS type, NULL AS note FROM documents
  UNION ALL SELECT doc_id, '0', '(no content extracted)', 'detail', NULL FROM raw WHERE len(segs) = 0
  UNION ALL SELECT doc_id, CAST(i AS VARCHAR), upper(substring(t, 1, 1)) || substring(t, 2), 'topic', note FROM (SELECT doc_id, i, {cut_sql('head', 60)} AS t, {cut_sql('text', 500)} AS note FROM hd)
  UNION ALL SELECT doc_id, i || '.' || (j - 1), {cut_sql('p', 90)}, 'detail', NULL FROM px)
"""


@query(f"WITH {HEURISTIC} SELECT * FROM nodes")
def heuristic_map(spark, sf_dir):
    return heuristic.flat_map(table(spark, sf_dir, "documents")).select("map_id", dotted().alias("path"), "title", "type", "note")


STOP = "[" + ", ".join("'" + w + "'" for w in T.STOPWORDS) + "]"
COHESION = rf"""
{SEGS}, tok AS (SELECT doc_id, list_transform(segs, lambda s: list_distinct(list_filter(regexp_extract_all(lower(s), '[a-z0-9'']+'), lambda w: length(w) > 2 AND NOT list_contains({STOP}, w)))) AS ts, len(segs) AS n FROM raw),
gap AS (SELECT doc_id, i, list_distinct(flatten(ts[i - 2:i])) AS l, list_distinct(flatten(ts[i + 1:i + 3])) AS r FROM (SELECT *, unnest(range(3, n - 2)) AS i FROM tok WHERE n >= 6)),
coh AS (SELECT doc_id, CAST(i AS INTEGER) AS i, CASE WHEN len(list_distinct(l || r)) = 0 THEN 1.0 ELSE CAST(len(list_intersect(l, r)) AS DOUBLE) / len(list_distinct(l || r)) END AS score FROM gap)
"""


@query(f"WITH {COHESION} SELECT doc_id, i, score FROM coh")
def cohesion(spark, sf_dir):
    rows = segments.scored(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.explode_outer("scores").alias("g")).filter("g is not null").select("doc_id", "g.i", "g.score")


@query(f"WITH {COHESION} SELECT r.doc_id, coalesce(t.t, 0.0) AS threshold FROM raw r LEFT JOIN (SELECT doc_id, least(quantile_disc(score, 0.25), 0.5) AS t FROM coh GROUP BY doc_id) t USING (doc_id)")
def boundary_threshold(spark, sf_dir):
    return segments.scored(table(spark, sf_dir, "documents")).select("doc_id", F.col("limit").alias("threshold"))


@query(f"WITH {SEGS} SELECT doc_id, CAST(CASE WHEN w <= 0 THEN 200 ELSE greatest(200, ceil(w / 25.0 / 0.4)) END AS BIGINT) AS budget FROM (SELECT doc_id, {WORDS.format(chr(39) + chr(39) + ' || coalesce(text, ' + chr(39) + chr(39) + ')')} AS w FROM documents)")
def adaptive_budget(spark, sf_dir):
    w = T.word_count(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", segments.adaptive_words(w, F.lit(200)).cast("long").alias("budget"))


CHUNKS = rf"""
{COHESION}, lim AS (SELECT doc_id, least(quantile_disc(score, 0.25), 0.5) AS t FROM coh GROUP BY doc_id),
w AS (SELECT s.doc_id, s.seq, {WORDS.format('s.text')} AS w, coalesce(c.score, 1.0) <= coalesce(lim.t, 0.0) AS b FROM seg s LEFT JOIN coh c ON c.doc_id = s.doc_id AND c.i = s.seq + 1 LEFT JOIN lim ON lim.doc_id = s.doc_id),
f AS (
  SELECT doc_id, seq, 0 AS chunk, w AS total, (w >= 60 OR (w >= 24 AND b)) AS cut FROM w WHERE seq = 0
  UNION ALL SELECT w.doc_id, w.seq, f.chunk + CAST(f.cut AS INTEGER), CASE WHEN f.cut THEN 0 ELSE f.total END + w.w,
    (CASE WHEN f.cut THEN 0 ELSE f.total END + w.w >= 60) OR (CASE WHEN f.cut THEN 0 ELSE f.total END + w.w >= 24 AND w.b)
  FROM f JOIN w ON w.doc_id = f.doc_id AND w.seq = f.seq + 1),
chunk AS (SELECT f.doc_id, CAST(f.chunk AS INTEGER) AS chunk, CAST(min(f.seq) AS INTEGER) AS first_seq, CAST(count(*) AS INTEGER) AS n_segments, CAST(sum(w.w) AS INTEGER) AS n_words, string_agg(seg.text, ' ' ORDER BY f.seq) AS text
  FROM f JOIN w USING (doc_id, seq) JOIN seg USING (doc_id, seq) GROUP BY f.doc_id, f.chunk)
"""


@query(f"WITH RECURSIVE {CHUNKS} SELECT * FROM chunk")
def topic_chunks(spark, sf_dir):
    return segments.topic_chunks(table(spark, sf_dir, "documents"), most=60)


@query(f"WITH RECURSIVE {CHUNKS} SELECT c.doc_id, c.chunk, CAST(floor(c.chunk / CASE WHEN n.n <= 9 THEN 1 ELSE ceil(n.n / 9) END) AS INTEGER) AS batch FROM chunk c JOIN (SELECT doc_id, count(*) AS n FROM chunk GROUP BY 1) n USING (doc_id)")
def map_batches(spark, sf_dir):
    return provider.batches(topic_chunks(spark, sf_dir))


def _spoken(spark, sf_dir) -> DataFrame:
    """Each region's first nations as a numbered list, five seconds apart."""
    order = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    rows = table(spark, sf_dir, "nation").withColumn("k", F.row_number().over(order))
    number = F.element_at(F.array(*[F.lit(w) for w in enumeration.NUMBERS]), F.col("k").cast("int"))
    text = F.concat(F.lit("Step "), number, F.lit(" is the "), F.lower("n_name"), F.lit(", of course."))
    return rows.select(F.col("n_regionkey").alias("source"), (F.col("k") - 1).alias("seq"), text.alias("text"), (F.col("k") * 5.0).alias("start"))


@query("""SELECT n_regionkey AS source, CAST(k AS INTEGER) AS number, list_reduce(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1:1]) || w[2:]), lambda a, b: a || ' ' || b) AS heading, k * 5.0 AS start, CAST(k - 1 AS INTEGER) AS seg_index
  FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation)""")
def enumeration_sections(spark, sf_dir):
    return enumeration.detect(_spoken(spark, sf_dir))


@query("""SELECT n_regionkey AS source, CAST(k AS INTEGER) AS number, 'Step ' || (['one','two','three','four','five','six','seven','eight','nine','ten'])[k] || ' is the ' || lower(n_name) || ', of course.' AS text
  FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation)""")
def enum_section_text(spark, sf_dir):
    spoken = _spoken(spark, sf_dir)
    told, _ = enumeration.spans(spoken, enumeration.detect(spoken))
    return told.select("source", "number", "text")


@query(r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '(?:^|[^\w.])((?:\$\s?\d[\d,]*(?:\.\d+)?|\d[\d,]*(?:\.\d+)?\s?%|\d+\.\d+|\d[\d,]+))', 1)) AS a FROM documents)
  SELECT doc_id, trim(a) AS anchor, regexp_replace(regexp_replace(a, '[^\d.]', '', 'g'), '^\.+|\.+$', '', 'g') AS norm, count(*) AS n FROM m GROUP BY ALL""")
def number_anchors(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.number_anchors(F.coalesce("text", F.lit("")))).alias("anchor"))
    return rows.select("doc_id", "anchor", T.number_key(F.col("anchor")).alias("norm")).groupBy("doc_id", "anchor", "norm").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CAST(i - 1 AS INTEGER) AS i, xs[i] AS item FROM (SELECT *, unnest(range(1, len(xs) + 1)) AS i FROM (SELECT p_partkey, list_filter([array_to_string(string_split(lower(p_type), ' ')[1:2], ' '), replace(lower(p_brand), '#', ' ')], lambda x: length(x) >= 3) AS xs FROM part))")
def list_items(spark, sf_dir):
    text = F.concat(F.lit("There are things such as "), F.lower("p_type"), F.lit(" and "), F.lower("p_brand"), F.lit(". More."))
    plain = F.regexp_replace(text, "#", " ")
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(T.list_items(plain)).alias("i", "item"))


def _listed(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


# Names as rows (doc_id, i, name).
NAMES = rf"""r AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '(?:^|[^\pL\pN_])([A-Z][A-Za-z''’]+(?:\s+[A-Z][A-Za-z''’]+)+)', 1) AS rs FROM documents),
  w AS (SELECT doc_id, list_transform(rs, lambda x: regexp_split_to_array(x, '\s+')) AS ws FROM r),
  t AS (SELECT doc_id, list_transform(ws, lambda w: w[coalesce(nullif(list_position(list_transform(w, lambda x: list_contains({_listed(T.PROPER_LEAD)}, lower(x))), false), 0), 1000000):]) AS ws FROM w),
  k AS (SELECT doc_id, list_filter(ws, lambda w: len(w) >= 2 AND len(list_filter(w, lambda x: NOT list_contains({_listed(T.PROPER_STOP)}, lower(x)))) > 0) AS ws FROM t),
  names AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS i, array_to_string(ws[i], ' ') AS name FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM k))"""


@query(f"WITH {NAMES} SELECT doc_id, i, name FROM names")
def proper_nouns(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.proper_nouns(F.coalesce("text", F.lit("")))).alias("i", "name"))


NUMBERS_IN = r"list_transform(regexp_extract_all({}, '(?:^|[^\w.])((?:\$\s?\d[\d,]*(?:\.\d+)?|\d[\d,]*(?:\.\d+)?\s?%|\d+\.\d+|\d[\d,]+))', 1), lambda x: trim(x))"
NUMBER_KEY = r"regexp_replace(regexp_replace({}, '[^\d.]', '', 'g'), '^\.+|\.+$', '', 'g')"
NORM = r"trim(regexp_replace(lower({}), '[,\s\pZ]+', ' ', 'g'))"


# What documents hold that their maps don't: numbers by key, listed items and names by substring.
@query(rf"""WITH {HEURISTIC}, {NAMES}, d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
  nums AS (SELECT doc_id, i - 1 AS i, xs[i] AS a FROM (SELECT *, unnest(range(1, len(xs) + 1)) AS i FROM (SELECT doc_id, {NUMBERS_IN.format('text')} AS xs FROM d))),
  cues AS (SELECT doc_id, flatten(list_transform(regexp_extract_all(text, '(?i)\b(?:such as|like|including|e\.g\.,?)\s+(.+?)(?:[.!?;]|$)', 1),
    lambda s: regexp_split_to_array(substring(s, 1, 80), '(?i),|\band\b|\bor\b'))) AS ps FROM d),
  plain AS (SELECT doc_id, list_filter(list_transform(ps, lambda p: array_to_string(list_filter(regexp_split_to_array(regexp_replace(p, '[^\pL\pM\pN_\s''’-]', ' ', 'g'), '\s+'), lambda w: w <> '')[1:2], ' ')), lambda p: length(p) >= 3) AS ps FROM cues),
  every AS (SELECT doc_id, 0 AS kind, i AS pos, a, {NUMBER_KEY.format('a')} AS norm FROM nums
    UNION ALL SELECT doc_id, 1, i - 1, ps[i], {NORM.format('ps[i]')} FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM plain)
    UNION ALL SELECT doc_id, 2, i, name, {NORM.format('name')} FROM names),
  found AS (SELECT * FROM every WHERE norm <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, kind = 0, norm ORDER BY kind, pos) = 1),
  told AS (SELECT map_id, path, title || CASE WHEN note IS NULL THEN '' ELSE ' ' || note END AS t FROM nodes),
  kept AS (SELECT DISTINCT map_id, {NUMBER_KEY.format('x')} AS norm FROM (SELECT map_id, unnest({NUMBERS_IN.format('t')}) AS x FROM told)),
  said AS (SELECT map_id, {NORM.format("string_agg(t, ' ' ORDER BY CAST(list_transform(list_filter(string_split(path, '.'), lambda x: x <> ''), lambda x: CAST(x AS INTEGER)) AS INTEGER[]))")} AS said FROM told GROUP BY map_id),
  lost AS (SELECT found.* FROM found LEFT JOIN kept ON kept.map_id = doc_id AND kept.norm = found.norm LEFT JOIN said ON said.map_id = doc_id
    WHERE CASE WHEN kind = 0 THEN kept.norm IS NULL ELSE NOT coalesce(contains(said, found.norm), false) END)
  SELECT doc_id AS map_id, CAST(rank AS INTEGER) AS rank, a AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY kind, pos) AS rank FROM lost) WHERE rank <= 8""")
def missing_anchors(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return anchors.missing(docs.select(F.col("doc_id").alias("map_id"), "text"), heuristic.flat_map(docs))


def _tree(spark, sf_dir) -> DataFrame:
    return maps.star_tree(*(table(spark, sf_dir, t) for t in ("region", "nation", "customer")))


TREE = """
n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS no FROM nation),
c AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS co FROM customer),
tree AS (
  SELECT CAST([] AS INTEGER[]) AS path, 'World' AS title, 'root' AS type
  UNION ALL SELECT [CAST(r_regionkey AS INTEGER)], r_name, 'topic' FROM region
  UNION ALL SELECT [CAST(n_regionkey AS INTEGER), CAST(no AS INTEGER)], n_name, 'concept' FROM n JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT [CAST(n_regionkey AS INTEGER), CAST(no AS INTEGER), CAST(co AS INTEGER)], c_name, 'detail' FROM c JOIN n ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""


@query(f"WITH {TREE} SELECT 'world' AS map_id, count(*) AS n_nodes, CAST(max(len(path)) + 1 AS INTEGER) AS depth FROM tree")
def tree_stats(spark, sf_dir):
    return trees.stats(_tree(spark, sf_dir))


@query(f"WITH {TREE} SELECT array_to_string(a.path, '.') AS path, count(*) AS n_nodes, CAST(max(len(b.path)) - len(a.path) + 1 AS INTEGER) AS height FROM tree a JOIN tree b ON b.path[1:len(a.path)] = a.path GROUP BY a.path")
def subtree_sizes(spark, sf_dir):
    return trees.subtree(_tree(spark, sf_dir)).select(dotted().alias("path"), "n_nodes", "height")


@query(f"WITH {TREE} SELECT CAST(row_number() OVER (ORDER BY path) - 1 AS INTEGER) AS position, array_to_string(path, '.') AS path, title FROM tree")
def dfs_walk(spark, sf_dir):
    return trees.walk(_tree(spark, sf_dir)).select("position", dotted().alias("path"), "title")


@query(f"WITH {TREE} SELECT array_to_string(CASE WHEN len(path) > 0 AND path[1] > 1 THEN [path[1] - 1] || path[2:] ELSE path END, '.') AS path, title FROM tree WHERE len(path) = 0 OR path[1] <> 1")
def edit_delete_subtree(spark, sf_dir):
    return trees.delete(_tree(spark, sf_dir), "world", [1]).select(dotted().alias("path"), "title")


@query(f"WITH {TREE} SELECT array_to_string(path, '.') AS path, CASE WHEN path = [2, 0] THEN 'Renamed' ELSE title END AS title FROM tree")
def edit_rename(spark, sf_dir):
    return trees.rename(_tree(spark, sf_dir), "world", [2, 0], "Renamed").select(dotted().alias("path"), "title")


@query(f"""WITH {TREE}, k AS (SELECT n.*, (n_nationkey * 7) % 25 AS other FROM nation n), p AS (SELECT array_to_string(path, '.') AS p, title, path FROM tree WHERE type = 'concept'),
  l AS (SELECT k.n_nationkey AS seq, a.path AS a, b.path AS b FROM k JOIN nation m ON m.n_nationkey = k.other JOIN p a ON a.title = k.n_name JOIN p b ON b.title = m.n_name
    UNION ALL SELECT 1000 + n_nationkey, a.path, [CAST(n_regionkey * 2 % 5 AS INTEGER)] FROM nation JOIN p a ON a.title = n_name),
  m AS (SELECT * FROM l WHERE a <> b AND b[1:len(a)] <> a AND a[1:len(b)] <> b)
  SELECT CAST(min(seq) AS BIGINT) AS seq FROM m GROUP BY least(a, b), greatest(a, b)""")
def valid_links(spark, sf_dir):
    nation, nodes = table(spark, sf_dir, "nation"), _tree(spark, sf_dir).filter("type = 'concept'")
    other = nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("other"))
    pairs = nation.join(other, (F.col("n_nationkey") * 7) % 25 == F.col("k"))
    a = nodes.select("map_id", F.col("title").alias("n_name"), F.col("path").alias("a_path"))
    b = nodes.select(F.col("title").alias("other"), F.col("path").alias("b_path"))
    links = pairs.join(a, "n_name").join(b, "other").select("map_id", F.col("n_nationkey").cast("long").alias("seq"), "a_path", "b_path")
    # To regions too, of which region 0 is above its nations.
    up = nation.join(a, "n_name").select("map_id", (F.col("n_nationkey") + 1000).cast("long").alias("seq"), "a_path", F.array((F.col("n_regionkey") * 2 % 5).cast("int")).alias("b_path"))
    return trees.valid_links(links.unionByName(up)).select("seq")


@query(f"""WITH {TREE}, o AS (SELECT CAST(row_number() OVER (ORDER BY path) - 1 AS INTEGER) AS seq, len(path) AS level, title, path FROM tree WHERE len(path) > 0)
  SELECT seq, title, array_to_string(path, '.') AS path FROM o""")
def outline_tree(spark, sf_dir):
    flat = trees.walk(_tree(spark, sf_dir)).filter(F.size("path") > 0)
    entries = flat.select(F.lit("world").alias("source"), (F.col("position") - 1).alias("seq"), F.size("path").alias("level"), "title", F.lit(0).alias("page"))
    return trees.outline_tree(entries).select("seq", "title", dotted().alias("path"))


@query(r"""WITH l AS (SELECT p_brand AS source, p_partkey AS seq, length(p_type) % 7 AS page, CAST(p_size % 10 AS DOUBLE) AS size, p_type AS text FROM part),
  body AS (SELECT source, size AS body FROM (SELECT source, size, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, min(seq)) AS r FROM l GROUP BY source, size) WHERE r = 1),
  cand AS (SELECT l.* FROM l JOIN body USING (source) WHERE size >= body * 1.15), rare AS (SELECT source, text FROM cand GROUP BY ALL HAVING count(*) < 3),
  c2 AS (SELECT cand.* FROM cand JOIN rare USING (source, text)), ok AS (SELECT source FROM c2 GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT page) >= 2)
  SELECT source, seq, text AS title, CAST(least(dense_rank() OVER (PARTITION BY source ORDER BY size DESC), 3) AS INTEGER) AS level, CAST(page AS INTEGER) AS page FROM c2 JOIN ok USING (source)""")
def heading_levels(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    lines = part.select(F.col("p_brand").alias("source"), F.col("p_partkey").alias("seq"), (F.length("p_type") % 7).alias("page"), (F.col("p_size") % 10).cast("double").alias("size"), F.col("p_type").alias("text"))
    return trees.heading_levels(lines)


@query(r"""SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS seq, 2 AS level, role || ' ' || turn AS heading, length(text) AS n FROM conversations""")
def md_sections(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    line = F.concat(F.lit("## "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), F.regexp_replace(F.coalesce("text", F.lit("")), "(?m)^#", " #"))
    packed = rows.select("conv_id", F.struct("turn", line.alias("l")).alias("l")).groupBy("conv_id").agg(F.array_sort(F.collect_list("l")).alias("ls"))
    text = F.array_join(F.transform("ls", lambda x: x["l"]), "\n")
    found = markdown.sections(packed.select("conv_id", text.alias("text")), "conv_id")
    size = F.length("text") - F.length("heading") - F.when(F.length("text") > F.length("heading"), 1).otherwise(0)
    return found.select("conv_id", "seq", "level", "heading", size.alias("n"))


@query(f"""WITH {HEURISTIC}, l AS (SELECT map_id, path, CASE WHEN type = 'root' THEN '# ' || title || chr(10)
    ELSE repeat('  ', CAST(contains(path, '.') AS INTEGER)) || '- ' || title || CASE WHEN coalesce(note, '') <> '' THEN chr(10) || repeat('  ', CAST(contains(path, '.') AS INTEGER)) || '  *' || note || '*' ELSE '' END END AS line FROM nodes)
  SELECT map_id, string_agg(line, chr(10) ORDER BY CAST(list_transform(list_filter(string_split(path, '.'), lambda x: x <> ''), lambda x: CAST(x AS INTEGER)) AS INTEGER[])) || chr(10) AS content FROM l GROUP BY map_id""")
def markdown_export(spark, sf_dir):
    return trees.markdown(heuristic.flat_map(table(spark, sf_dir, "documents")))


@query("""SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents WHERE contains(lower(lang || ' ' || coalesce(text, '')), 'stupid')) WHERE r <= 10""")
def search_topk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    nodes = docs.select(F.col("source").alias("map_id"), F.array(F.col("doc_id").cast("int")).alias("path"), F.col("lang").alias("title"), F.col("text").alias("note"))
    return trees.search(nodes, "Stupid", 10).select(F.col("map_id").alias("source"), F.get("path", F.lit(0)).cast("long").alias("doc_id"))


@query(f"""WITH {HEURISTIC}, top AS (SELECT * FROM nodes WHERE type = 'root')
  SELECT '' AS path, 'All' AS title, 'root' AS type UNION ALL SELECT CAST(map_id AS VARCHAR), 'Document ' || map_id, 'topic' FROM top
  UNION ALL SELECT map_id || '.' || path, title, type FROM nodes WHERE type <> 'root'""")
def batch_union(spark, sf_dir):
    return maps.batch_map(table(spark, sf_dir, "documents"), "All", level="full").select(dotted().alias("path"), "title", "type")


# The last time, every third document had another id, every fifth no mark, every seventh another mark.
@query("""WITH o AS (SELECT CASE WHEN doc_id % 3 = 0 THEN doc_id + 10000000 ELSE doc_id END AS doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS f FROM documents)
  SELECT doc_id, CASE WHEN n.n_chars IS NULL THEN 'removed' WHEN o.doc_id IS NOT NULL AND (o.f IS NULL OR o.f = n.n_chars) THEN 'reused' ELSE 'new' END AS status FROM documents n FULL JOIN o USING (doc_id)""")
def batch_reuse_diff(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    mark = F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    was = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") + 10_000_000).otherwise(F.col("doc_id"))
    return snapshots.reuse(docs.select("doc_id", F.col("n_chars").alias("fingerprint")), docs.select(was.alias("doc_id"), mark.alias("fingerprint")), "doc_id")


# The last time, every fifth folder had another name, and every eleventh file another size.
@query("""WITH o AS (SELECT CASE WHEN c_custkey % 5 = 0 THEN c_custkey + 10000000 ELSE c_custkey END AS k, sum(o_orderkey + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END) AS s FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1),
  n AS (SELECT c_custkey AS k, sum(o_orderkey) AS s FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1)
  SELECT k AS relpath, CASE WHEN n.s IS NULL THEN 'deleted' WHEN o.s IS NULL THEN 'added' WHEN o.s = n.s THEN 'reused' ELSE 'changed' END AS status FROM n FULL JOIN o USING (k)""")
def folder_diff(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("relpath"), "o_orderkey")
    files = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("relpath")).join(orders, "relpath")
    sizes = files.groupBy("relpath").agg(F.sum("o_orderkey").alias("new"), F.sum(F.col("o_orderkey") + F.when(F.col("o_orderkey") % 11 == 0, 1).otherwise(0)).alias("old"))
    was = F.when(F.col("relpath") % 5 == 0, F.col("relpath") + 10_000_000).otherwise(F.col("relpath"))
    old = sizes.select(was.alias("relpath"), F.col("old").alias("signature"))
    return snapshots.tree_diff(sizes.select("relpath", F.col("new").alias("signature")), old).select("relpath", "status")


@query("""WITH f AS (SELECT c_nationkey AS k, c_custkey, 'f:' || c_name || ':' || c_custkey || ':0' AS line FROM customer),
  l2 AS (SELECT n_nationkey, n_regionkey, n_name, substring(sha256(coalesce(string_agg(line, chr(10) ORDER BY line), '')), 1, 16) AS s FROM nation LEFT JOIN f ON k = n_nationkey GROUP BY ALL),
  l1 AS (SELECT r_regionkey, r_name, substring(sha256(coalesce(string_agg('d:' || n_name || ':' || s, chr(10) ORDER BY 'd:' || n_name || ':' || s), '')), 1, 16) AS s FROM region LEFT JOIN l2 ON n_regionkey = r_regionkey GROUP BY ALL),
  l0 AS (SELECT substring(sha256(string_agg('d:' || r_name || ':' || s, chr(10) ORDER BY 'd:' || r_name || ':' || s)), 1, 16) AS s FROM l1)
  SELECT '/' AS path, s AS signature FROM l0 UNION ALL SELECT '/' || r_name, s FROM l1 UNION ALL SELECT '/' || r_name || '/' || n_name, l2.s FROM l2 JOIN region ON n_regionkey = r_regionkey""")
def merkle_signature(spark, sf_dir):
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    cols = ["path", "parent", "name", "is_dir", "size", "mtime", "depth"]
    make = lambda df, path, parent, name, d, size, depth: df.select(path.alias("path"), parent.alias("parent"), name.alias("name"), F.lit(d).alias("is_dir"), size.cast("long").alias("size"), F.lit(0).alias("mtime"), F.lit(depth).alias("depth")).select(cols)
    top = make(spark.range(1), F.lit("/"), F.lit(None).cast("string"), F.lit("/"), True, F.lit(0), 0)
    r = F.concat(F.lit("/"), F.col("r_name"))
    rn = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    n = F.concat(r, F.lit("/"), F.col("n_name"))
    cn = customer.join(rn, F.col("c_nationkey") == F.col("n_nationkey"))
    files = top.unionByName(make(region, r, F.lit("/"), F.col("r_name"), True, F.lit(0), 1)).unionByName(make(rn, n, r, F.col("n_name"), True, F.lit(0), 2))
    return snapshots.merkle(files.unionByName(make(cn, F.concat(n, F.lit("/"), F.col("c_name")), n, F.col("c_name"), False, F.col("c_custkey"), 3)))


@query("""WITH r AS (SELECT c_nationkey AS parent, lower(c_name) AS name, row_number() OVER (PARTITION BY c_nationkey ORDER BY lower(c_name)) AS rank FROM customer)
  SELECT parent, CAST(rank AS INTEGER) AS rank, name AS title FROM r WHERE rank <= 5 UNION ALL SELECT parent, 6, '+' || (count(*) - 5) || ' more file(s)' FROM r GROUP BY parent HAVING count(*) > 5""")
def folder_caps(spark, sf_dir):
    files = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("parent"), F.lower("c_name").alias("name"), F.lit(False).alias("is_dir"))
    return snapshots.capped(files, 5)


@query("SELECT n_regionkey AS parent, count(*) || ' folder(s), 0 file(s)' AS note FROM nation GROUP BY 1")
def folder_counts(spark, sf_dir):
    return snapshots.folder_counts(table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("parent"), F.lit(True).alias("is_dir")))


@query("""WITH l AS (SELECT DISTINCT CASE WHEN doc_id % 4 = 0 THEN doc_id + 10000000 ELSE doc_id END AS doc_id FROM labels)
  SELECT d.doc_id AS stem, CASE WHEN l.doc_id IS NULL THEN d.doc_id || '.mp4' ELSE d.doc_id || '.srt' END AS path, l.doc_id IS NULL AS needs_transcription FROM documents d LEFT JOIN l USING (doc_id)
  UNION ALL SELECT doc_id, doc_id || '.srt', FALSE FROM l WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def course_sidecar(spark, sf_dir):
    name = lambda suffix: F.concat(F.col("stem").cast("string"), F.lit(suffix)).alias("path")
    media = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("stem")).select("stem", name(".mp4"))
    stem = F.when(F.col("doc_id") % 4 == 0, F.col("doc_id") + 10_000_000).otherwise(F.col("doc_id"))
    subs = table(spark, sf_dir, "labels").select(stem.alias("stem")).distinct().select("stem", name(".srt"))
    return snapshots.sidecars(media, subs)


@query("SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS rank, 'Order ' || o_orderkey AS name FROM orders")
def natural_sort(spark, sf_dir):
    named = table(spark, sf_dir, "orders").select("o_custkey", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("name"))
    order = Window.partitionBy("o_custkey").orderBy(T.natural_key(F.col("name")))
    return named.select("o_custkey", F.row_number().over(order).alias("rank"), "name")


@query(f"WITH RECURSIVE {CHUNKS} SELECT doc_id, chunk, sha256('1' || chr(0) || 'mock' || chr(0) || 'mock-1' || chr(0) || 'map' || chr(0) || 'full' || chr(0) || text) AS key FROM chunk WHERE doc_id % 2 = 1 AND text NOT IN (SELECT text FROM chunk WHERE doc_id % 2 = 0)")
def llm_cache_misses(spark, sf_dir):
    asked = provider.requests(topic_chunks(spark, sf_dir), provider.MockProvider(), "map", "full")
    # The cache has the odd documents' chunks at another level.
    brief = provider.requests(asked.withColumnRenamed("key", "full"), provider.MockProvider(), "map", "brief")
    cache = brief.select(F.when(F.col("doc_id") % 2 == 0, F.col("full")).otherwise(F.col("key")).alias("key")).distinct()
    return snapshots.cache_misses(asked, cache).select("doc_id", "chunk", "key")


@query(f"""WITH RECURSIVE {CHUNKS} SELECT doc_id AS map_id, CAST(chunk AS VARCHAR) AS path, substring(text, 1, 40) AS title, 'concept' AS type, substring(text, 1, 120) AS note FROM chunk
  UNION ALL SELECT doc_id, chunk || '.0', substring(text, 1, 60), 'detail', NULL FROM chunk""")
def mock_map(spark, sf_dir):
    model, chunks = provider.MockProvider(), topic_chunks(spark, sf_dir)
    asked = provider.requests(chunks, model, "map", "full")
    replies = provider.complete(asked, model, "map")
    nodes = provider.map_nodes(asked.join(replies, "key", "left"))
    return nodes.select("map_id", dotted().alias("path"), "title", "type", "note")


@query("SELECT count(*) AS entries, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS bytes FROM documents")
def cache_stats(spark, sf_dir):
    return snapshots.cache_stats(table(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("value")))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    out = streams.window_counts(table(spark, sf_dir, "events"))
    return out.withColumn("total", F.round("total", 4))


SQL["stream_windows"] = SQL["stream_windows"].replace("sum(value) AS total", "round(sum(value), 4) AS total")


@query("""SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'article' WHEN 1 THEN 'captions' WHEN 2 THEN 'playlist' WHEN 3 THEN 'subtitle' WHEN 4 THEN 'video' WHEN 5 THEN 'pdf' WHEN 6 THEN 'audio' WHEN 7 THEN 'map' ELSE 'unknown' END AS kind FROM pages""")
def source_kinds(spark, sf_dir):
    """The pages' addresses, and what they would be as videos, lists and files."""
    url, name = F.col("url"), F.concat(F.lit("/data/"), F.col("page_id").cast("string"))
    made = [url, F.concat(F.lit("https://youtu.be/"), name), F.concat(F.lit("https://www.YouTube.com/playlist?list="), name), *(F.concat(name, F.lit(x)) for x in (".SRT", ".mkv", ".pdf", ".ogg", ".opml", ".xyz"))]
    return table(spark, sf_dir, "pages").select("page_id", T.source_kind(F.element_at(F.array(*made), (F.col("page_id") % 9 + 1).cast("int"))).alias("kind"))


@query(r"""SELECT page_id, CASE WHEN name = '' THEN url ELSE array_to_string(list_transform(string_split(lower(name), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') END AS title
  FROM (SELECT page_id, url, trim(translate(regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]+)/*$', 1), '\.(html?|php|aspx?)$', '', 'i'), '-_', '  ')) AS name FROM pages)""")
def article_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.url_title(F.col("url")).alias("title"))


@query("""WITH f AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS page, count(*) OVER (PARTITION BY conv_id) AS n, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS text FROM conversations),
  o AS (SELECT conv_id, page AS seq, role_title, page FROM (SELECT f.*, 'T' || page AS role_title FROM f) WHERE page % 2 = 0)
  SELECT o.conv_id AS source, CAST(o.seq // 2 AS INTEGER) AS seq, o.role_title AS title, string_agg(f.text, ' ' ORDER BY f.page) FILTER (WHERE f.text <> '') AS text
  FROM o JOIN f ON f.conv_id = o.conv_id AND f.page >= o.page AND f.page < o.page + 2 GROUP BY ALL""")
def outline_leaf_text(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn")
    pages = rows.select(F.col("conv_id").alias("source"), (F.row_number().over(order) - 1).alias("seq"), T.collapse(F.coalesce("text", F.lit(""))).alias("text"))
    heads = pages.filter("seq % 2 = 0").select("source", F.floor(F.col("seq") / 2).cast("int").alias("seq"), F.lit(1).alias("level"), F.concat(F.lit("T"), F.col("seq").cast("string")).alias("title"), F.col("seq").alias("page"))
    return outlines.leaf_texts(heads, pages).select("source", "seq", "title", F.nullif("text", F.lit("")).alias("text"))


@query("""SELECT o_custkey AS source, CASE WHEN c_custkey % 2 = 0 THEN 'full' ELSE 'brief' END AS level, 'opml' AS format, max(o_orderkey) || '.opml' AS output
  FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL UNION ALL
  SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'full' ELSE 'brief' END, 'opml', NULL FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def manifest_lookup(spark, sf_dir):
    level = F.when(F.col("source") % 2 == 0, "full").otherwise("brief").alias("level")
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source")).select("source", level, F.lit("opml").alias("format"))
    past = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("recorded"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".opml")).alias("output"))
    return snapshots.manifest_lookup(wanted, past.select("*", level, F.lit("opml").alias("format")))


@query("""SELECT count(*) FILTER (WHERE event_type = 'view') AS ok, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type = 'click') AS reused, count(*) FILTER (WHERE event_type = 'signup') AS added,
  count(*) FILTER (WHERE event_type = 'purchase') AS removed, count(*) FILTER (WHERE event_type IN ('view', 'click')) = 0 AND count(*) FILTER (WHERE event_type = 'error') > 0 AS all_failed FROM events""")
def outcome_counts(spark, sf_dir):
    names = {"view": "ok", "error": "failed", "click": "reused", "signup": "added", "purchase": "removed"}
    status = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("event_type")]
    return snapshots.outcome_counts(table(spark, sf_dir, "events").select(status.alias("status")))


@query()
def article_sections(spark, sf_dir):
    return article.sections(table(spark, sf_dir, "pages"))


@query(f"WITH RECURSIVE {CHUNKS} SELECT doc_id, count(*) AS n_chunks, count(*) + 1 AS calls FROM chunk GROUP BY doc_id")
def call_estimate(spark, sf_dir):
    n = topic_chunks(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    return provider.call_estimate(n)


@query("""SELECT n_regionkey AS map_id, CAST(k - 1 AS INTEGER) AS i, k || '. ' || list_reduce(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1:1]) || w[2:]), lambda a, b: a || ' ' || b) AS title, k * 5.0 AS timestamp
  FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation)""")
def enumerated_map(spark, sf_dir):
    spoken = _spoken(spark, sf_dir)
    told, intro = enumeration.spans(spoken, enumeration.detect(spoken))
    nodes = heuristic.enumerated_map(told.withColumnRenamed("source", "map_id"), intro.withColumnRenamed("source", "map_id"))
    return nodes.filter(F.size("path") == 1).select("map_id", F.get("path", F.lit(0)).alias("i"), "title", "timestamp")


# One map a region: its nations, and their customers below, each by key.
REGIONS = """n AS (SELECT n_regionkey AS r, n_nationkey AS nk, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation),
c AS (SELECT r, i, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS j, c_name FROM customer JOIN n ON c_nationkey = nk),
node AS (SELECT r AS map_id, [CAST(i AS INTEGER)] AS path, n_name AS title FROM n UNION ALL SELECT r, [CAST(i AS INTEGER), CAST(j AS INTEGER)], c_name FROM c),
walk AS (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY path) - 1 AS pos FROM node)"""
LINKS = f"""{REGIONS}, l AS (SELECT s_suppkey % 5 AS map_id, s_suppkey AS seq, s_suppkey * 11 % 150 AS a, s_suppkey * 37 % 400 AS b FROM supplier),
pair AS (SELECT l.map_id, seq, x.path AS p, y.path AS q, row_number() OVER (PARTITION BY l.map_id, least(x.path, y.path), greatest(x.path, y.path) ORDER BY seq) AS k
  FROM l JOIN walk x ON x.map_id = l.map_id AND x.pos = a JOIN walk y ON y.map_id = l.map_id AND y.pos = b WHERE x.path[1] <> y.path[1])"""


def _regions(spark, sf_dir):
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    n = nation.withColumn("i", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1)
    c = customer.withColumn("j", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    row = lambda df, path, title, kind: df.select(F.col("n_regionkey").alias("map_id"), path.cast("array<int>").alias("path"), title.alias("title"), F.lit(kind).alias("type"), F.lit(None).cast("string").alias("note"))
    root = row(nation.select("n_regionkey").distinct(), F.array(), F.lit("Region"), "root")
    return root.unionByName(row(n, F.array("i"), F.col("n_name"), "topic")).unionByName(row(c, F.array("i", "j"), F.col("c_name"), "detail"))


def _numbered_links(spark, sf_dir):
    key = F.col("s_suppkey")
    links = table(spark, sf_dir, "supplier").select((key % 5).alias("map_id"), key.alias("seq"), (key * 11 % 150).alias("a"), (key * 37 % 400).alias("b"))
    return structuring.links_by_number(_regions(spark, sf_dir), links, cross=True)


@query(f"WITH {LINKS} SELECT map_id, seq, array_to_string(p, '.') AS a, array_to_string(q, '.') AS b FROM pair WHERE k = 1")
def cross_links(spark, sf_dir):
    return _numbered_links(spark, sf_dir).select("map_id", "seq", dotted("a_path").alias("a"), dotted("b_path").alias("b"))


@query(f"WITH {LINKS} SELECT map_id + 10 AS ordinal, seq, (map_id + 10) || '.' || array_to_string(p, '.') AS a, (map_id + 10) || '.' || array_to_string(q, '.') AS b FROM pair WHERE k = 1")
def merge_maps(spark, sf_dir):
    items = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("map_id"), (F.col("r_regionkey") + 10).alias("ordinal"), F.col("r_name").alias("label"))
    links = _numbered_links(spark, sf_dir).withColumn("label", F.lit("see"))
    _, moved = structuring.merge_maps(_regions(spark, sf_dir), links, items, "Merged")
    return moved.select("ordinal", "seq", dotted("a_path").alias("a"), dotted("b_path").alias("b"))


@query(f"WITH {REGIONS} SELECT map_id, array_to_string(path, '.') AS path, array_to_string(path[1:len(path) - 1], '.') AS parent, path[len(path)] AS index FROM node")
def node_parents(spark, sf_dir):
    return structuring.parent_and_index(_regions(spark, sf_dir)).select("map_id", dotted().alias("path"), dotted("parent").alias("parent"), "index")


@query(f"""WITH {REGIONS} SELECT map_id, array_to_string(path, '.') AS path, '  # ' || title || (SELECT CASE WHEN count(*) > 0 THEN '  (+' || count(*) || ' more)' ELSE '' END FROM c WHERE c.r = map_id AND c.i = path[1]) AS line
  FROM node WHERE len(path) = 1 UNION ALL SELECT r_regionkey, '', '* Region' FROM region""")
def map_preview(spark, sf_dir):
    return structuring.preview(_regions(spark, sf_dir), max_depth=1).select("map_id", dotted().alias("path"), "line")


@query(f"""WITH RECURSIVE {CHUNKS} SELECT DISTINCT doc_id AS map_id, '' AS path, 'Map' AS title, 'root' AS type FROM chunk
  UNION ALL SELECT doc_id, CAST(chunk AS VARCHAR), substring(text, 1, 40), 'topic' FROM chunk""")
def mock_map_reduce(spark, sf_dir):
    model, chunks = provider.MockProvider(), topic_chunks(spark, sf_dir)
    asked = provider.requests(chunks, model, "map", "full")
    replies = provider.complete(asked, model, "map")
    nodes = structuring.reduce_maps(asked.select("doc_id", "chunk", "key").join(replies, "key"), model)
    return nodes.select("map_id", dotted().alias("path"), "title", "type")


@query(r"""WITH s AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) <> ''),
  p AS (SELECT *, greatest(1, n // least(9, n)) AS per FROM s), q AS (SELECT *, CASE WHEN (n + per - 1) // per > 1 AND n % per > 0 AND n % per < greatest(1, per // 2) THEN (n + per - 1) // per - 1 ELSE (n + per - 1) // per END AS k FROM p)
  SELECT conv_id AS map_id, CAST(i // per AS VARCHAR) AS path, CAST(turn * 5 AS DOUBLE) AS timestamp FROM q WHERE i % per = 0 AND i // per < k""")
def timed_topics(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source"), F.col("turn").alias("seq"), T.collapse(F.coalesce("text", F.lit(""))).alias("text"), (F.col("turn") * 5).cast("double").alias("start"), F.lit(4.0).alias("duration"))
    return structuring.timed_topics(rows).select("map_id", dotted().alias("path"), "timestamp")


TIMED = HEURISTIC.replace(SEGS, r"""
heard AS (SELECT conv_id AS doc_id, turn, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS text FROM conversations),
raw AS (SELECT doc_id, coalesce(list(text ORDER BY turn) FILTER (WHERE text <> ''), []) AS segs, coalesce(list(turn ORDER BY turn) FILTER (WHERE text <> ''), []) AS turns FROM heard GROUP BY doc_id)
""").replace("NULL AS note FROM documents", "NULL AS note FROM raw")


@query(f"""WITH {TIMED} SELECT map_id, path, title, type, note, CASE WHEN type = 'topic' THEN CAST(turns[CAST(path AS INTEGER) * greatest(1, len(segs) // greatest(1, least(9, len(segs)))) + 1] * 5 AS DOUBLE) END AS timestamp
  FROM nodes JOIN raw ON doc_id = map_id""")
def timed_map(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source"), F.col("turn").alias("seq"), T.collapse(F.coalesce("text", F.lit(""))).alias("text"), (F.col("turn") * 5).cast("double").alias("start"), F.lit(4.0).alias("duration"))
    nodes = structuring.timed_map(rows, rows.select("source", F.lit("").alias("title")).distinct())
    return nodes.select("map_id", dotted().alias("path"), "title", "type", "note", "timestamp")


# Parts as the spans of lines: a page a size, a line two prices.
@query("""WITH s AS (SELECT p_brand AS source, p_size AS page, p_partkey // 2 AS block, p_partkey % 2 AS line, part.* FROM part),
  l AS (SELECT source, page, block % 3 AS block, line, max(p_retailprice * 7 % 1000 / 80) AS size, trim(string_agg(CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE ' ' || p_name END, '' ORDER BY p_partkey)) AS text FROM s GROUP BY ALL)
  SELECT source, row_number() OVER (PARTITION BY source ORDER BY page, block, line) - 1 AS seq, page, round_even(size * 2, 0) / 2 AS size, text FROM l WHERE text <> ''""")
def span_lines(spark, sf_dir):
    part, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    text = F.when(key % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), "p_name"))
    made = part.select(F.col("p_brand").alias("source"), F.col("p_size").alias("page"), (F.floor(key / 2) % 3).alias("block"), (key % 2).alias("line"), key.alias("span"), (F.col("p_retailprice") * 7 % 1000 / 80).alias("size"), text.alias("text"))
    return spans.lines(made)
