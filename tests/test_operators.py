import pytest
from pyspark.sql import functions as F

from canopy.operators import anchors, enumeration, heuristic, provider, segments, snapshots, trees
from canopy.sources import mapfiles, markdown, subtitles


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def nodes(spark, *rows):
    return spark.createDataFrame([("m", p, t, k, n) for p, t, k, n in rows], "map_id string, path array<int>, title string, type string, note string")


SMALL = [([], "R", "root", None), ([0], "A", "concept", "first  note"), ([0, 0], "A1", "warning", None), ([1], "B", "topic", None), ([2], "C", "topic", "")]


def test_segments_are_dense(spark):
    rows = segments.segments(docs(spark, "a\n\n[Music]\n b ", None, "")).orderBy("doc_id", "seq").collect()
    assert [(r.doc_id, r.seq, r.text) for r in rows] == [(0, 0, "a"), (0, 1, "b")]


def test_even_chunks_fold_a_short_rest(spark):
    for n, target in ((17, 9), (10, 4), (11, 3), (1, 9), (0, 9), (23, 5), (9, 9)):
        per = max(1, n // max(1, min(target, n)))
        want = [list(range(i, min(n, i + per))) for i in range(0, n, per)]
        if len(want) > 1 and len(want[-1]) < max(1, per // 2):
            want[-2] += want.pop()
        df = spark.createDataFrame([([str(i) for i in range(n)],)], "s array<string>").select(segments.even_chunks(F.col("s"), target).alias("c"))
        assert df.first().c == [[str(i) for i in c] for c in want]


def test_two_topics_are_cut_between(spark):
    text = "\n".join(["neural network training gradient descent"] * 6 + ["sourdough bread flour water oven"] * 6)
    scores = segments.scored(docs(spark, text)).first()
    assert min(scores.scores, key=lambda s: s.score).i == 6
    chunks = segments.topic_chunks(docs(spark, text), most=75).orderBy("chunk").collect()
    assert [c.first_seq for c in chunks] == [0, 6]


def test_short_text_has_no_scores(spark):
    row = segments.scored(docs(spark, "a\nb\nc")).first()
    assert row.scores == [] and row.limit == 0.0


def test_budgets(spark):
    df = spark.range(1).select(*[segments.adaptive_words(F.lit(w), F.lit(1200)).alias(f"w{w}") for w in (0, 1000, 30000)], *[segments.batch_size(F.lit(n)).alias(f"b{n}") for n in (0, 5, 9, 20)])
    assert tuple(df.first()) == (1200, 1200, 3000, 1, 1, 1, 3)


def test_flat_map_of_nothing(spark):
    rows = heuristic.flat_map(docs(spark, "")).orderBy("path").collect()
    assert [(r.title, r.type) for r in rows] == [("Mind Map", "root"), ("(no content extracted)", "detail")]


def test_enumeration(spark):
    make = lambda *t: spark.createDataFrame([("s", i, x, i * 5.0) for i, x in enumerate(t)], "source string, seq int, text string, start double")
    found = enumeration.detect(make("welcome", "Tip #1 is to have something bigger, right.", "tip number two is sleep.", "no one knows", "step three: eat well")).orderBy("number").collect()
    assert [(r.number, r.heading, r.start, r.seg_index) for r in found] == [(1, "Have Something Bigger", 5.0, 1), (2, "Sleep", 10.0, 2), (3, "Eat Well", 20.0, 4)]
    assert enumeration.detect(make("tip one is a.", "win something one time", "tip two is b.")).count() == 0


def test_missing_anchors(spark):
    sources = spark.createDataFrame([("m", "We saw 784 and 13,000. As Carl Jung said, things such as dropout, weight decay.")], "map_id string, text string")
    tree = nodes(spark, ([], "R", "root", None), ([0], "13000 and dropout", "topic", None))
    assert [r.anchor for r in anchors.missing(sources, tree).orderBy("rank").collect()] == ["784", "weight decay", "Carl Jung"]


def test_tree_operators(spark):
    tree = nodes(spark, *SMALL)
    assert tuple(trees.stats(tree).first()) == ("m", 5, 3)
    assert {tuple(r.path): (r.n_nodes, r.height) for r in trees.subtree(tree).collect()} == {(): (5, 3), (0,): (2, 2), (0, 0): (1, 1), (1,): (1, 1), (2,): (1, 1)}
    left = trees.delete(tree, "m", [0]).orderBy("path").collect()
    assert [(r.path, r.title) for r in left] == [([], "R"), ([0], "B"), ([1], "C")]
    with pytest.raises(ValueError):
        trees.delete(tree, "m", [])
    assert [r.title for r in trees.search(tree, "a", 2).orderBy("path").collect()] == ["A", "A1"]
    assert trees.search(tree, "").count() == 0


def test_markdown(spark):
    links = spark.createDataFrame([("m", 0, [0, 0], [1], "causes"), ("m", 1, [1], [9], "")], "map_id string, seq int, a_path array<int>, b_path array<int>, label string")
    text = trees.markdown(nodes(spark, *SMALL), links).first().content
    assert text == "# R\n\n- [Concept] A\n  *first note*\n  - [Warning] A1\n- B\n- C\n\n## Relationships\n\n- **A1** → **B** (causes)\n- **B** → **9**\n"


def test_links_are_checked(spark):
    rows = [("m", 0, [0], [1]), ("m", 1, [1], [0]), ("m", 2, [0], [0, 0]), ("m", 3, [2], [2]), ("m", 4, [0, 0], [1])]
    kept = trees.valid_links(spark.createDataFrame(rows, "map_id string, seq int, a_path array<int>, b_path array<int>"))
    assert sorted(r.seq for r in kept.collect()) == [0, 4]


def test_outline_nests_under_the_last_smaller_level(spark):
    rows = [("s", i, level, str(i), 0) for i, level in enumerate((1, 2, 3, 2, 1, 3, 2))]
    out = trees.outline_tree(spark.createDataFrame(rows, "source string, seq int, level int, title string, page int")).orderBy("seq").collect()
    assert [r.path for r in out] == [[0], [0, 0], [0, 0, 0], [0, 1], [1], [1, 0], [1, 1]]


def test_snapshots(spark):
    old = spark.createDataFrame([("a", 1, "la"), ("b", 2, "lb"), ("c", None, "lc"), ("z", 9, "lz")], "relpath string, signature int, label string")
    new = spark.createDataFrame([("a", 1), ("b", 3), ("c", 4), ("d", 5)], "relpath string, signature int")
    assert {r.relpath: (r.status, r.label) for r in snapshots.tree_diff(new, old).collect()} == {"a": ("reused", "la"), "b": ("changed", None), "c": ("changed", None), "d": ("added", None), "z": ("deleted", None)}
    status = {r.relpath: r.status for r in snapshots.reuse(new, old, "relpath", "signature").collect()}
    assert status == {"a": "reused", "b": "new", "c": "reused", "d": "new", "z": "removed"}


def test_merkle_changes_all_the_way_up(spark):
    schema = "path string, parent string, name string, is_dir boolean, size long, mtime int, depth int"
    rows = [("/", None, "/", True, 0, 0, 0), ("/a", "/", "a", True, 0, 0, 1), ("/b", "/", "b", True, 0, 0, 1), ("/a/f", "/a", "f", False, 1, 0, 2)]
    sums = lambda r: {x.path: x.signature for x in snapshots.merkle(spark.createDataFrame(r, schema)).collect()}
    one, two = sums(rows), sums([*rows[:3], ("/a/f", "/a", "f", False, 2, 0, 2)])
    assert one["/b"] == two["/b"] and one["/a"] != two["/a"] and one["/"] != two["/"]


def test_cues(spark):
    text = "WEBVTT\n\n1\n00:00:00,000 --> 00:00:01,500\n<c>Hello</c>\nthere\n\nid\n00:02.000 --> 00:03.000\nlost\n\n00:00:04.000 --> 00:00:05.000\n[Music]\n\n00:00:06.000 --> 00:00:05.000\nend"
    rows = subtitles.parse(spark.createDataFrame([("s", text)], "source string, text string")).orderBy("seq").collect()
    assert [(r.text, r.start, r.duration) for r in rows] == [("Hello there", 0.0, 1.5), ("end", 6.0, 0.0)]


def test_decoding(spark):
    df = spark.createDataFrame([("é€".encode(),), ("é€".encode("cp1252"),), (b"\xe9\x81",)], "b binary").select(subtitles.decode(F.col("b")).alias("t"))
    assert [r.t for r in df.collect()] == ["é€", "é€", "é\x81"]


def test_markdown_sections(spark):
    df = spark.createDataFrame([("s", "# Title\nintro\n## One\nx\n\ny\n### Two\nz", "title")], "source string, text string, t string")
    found = markdown.sections(df, title=F.col("t"))
    assert [(r.level, r.heading, r.text) for r in found.orderBy("seq").collect()] == [(0, "", "intro"), (2, "One", "One\nx\ny"), (3, "Two", "Two\nz")]
    assert markdown.outline(found).count() == 2


@pytest.mark.parametrize("form", ["opml", "xmind"])
def test_map_files_round_trip(spark, form):
    tree = nodes(spark, *SMALL)
    files = mapfiles.render(tree, form).select(F.lit(f"x.{form}").alias("path"), "content")
    back = mapfiles.parse(files).orderBy("path").collect()
    assert [(r.path, r.title, r.type, r.note) for r in back] == [(p, t, k, n or None) for p, t, k, n in sorted(SMALL)]


def test_corrupt_map_files(spark):
    bad = spark.createDataFrame([("x.opml", b"<opml><body/></opml>"), ("y.xmind", b"zip?")], "path string, content binary")
    assert mapfiles.parse(bad, lenient=True).count() == 0
    with pytest.raises(Exception, match="no outline"):
        mapfiles.parse(bad.limit(1)).count()


def test_provider_asks_only_for_what_the_cache_lacks(spark, tmp_path):
    chunks = spark.createDataFrame([(1, 0, "alpha"), (1, 1, "beta"), (2, 0, "alpha")], "doc_id int, chunk int, text string")
    path, asked = str(tmp_path / "cache"), []

    def save(df):
        df.write.mode("append").parquet(path)
        asked.append(spark.read.parquet(path).count())
        return spark.read.parquet(path)

    empty = spark.createDataFrame([], "key string, value string")
    first = provider.run_map(chunks, provider.MockProvider(), empty, save)
    assert first.filter("value is not null").count() == 3 and asked == [2]
    cache = spark.read.parquet(path)
    again = provider.run_map(chunks, provider.MockProvider(), cache, lambda df: cache.limit(0) if df.count() == 0 else pytest.fail("asked twice"))
    assert again.filter("value is not null").count() == 3


def test_replies_are_parsed(spark):
    df = spark.createDataFrame([('{"a":1}',), ('x ```json\n{"a":1}\n``` y',), ('so {"a":1} there',), ("none",)], "t string")
    out = df.select(F.to_json(provider.parse_json(F.col("t"))).alias("j")).collect()
    assert [r.j for r in out] == ['{"a":1}'] * 3 + [None]


def test_links_merge_polish_and_failover(spark):
    from canopy.operators import structuring
    from canopy.sources import mapfiles

    paths = [[], [0], [0, 0], [1], [1, 0]]
    nodes = spark.createDataFrame([("m", p, f"n{p}", "root" if not p else "topic", None) for p in paths], "map_id string, path array<int>, title string, type string, note string")
    links = spark.createDataFrame([("m", 0, 0, 2), ("m", 1, 2, 0), ("m", 2, 0, 1), ("m", 3, 1, 9), ("m", 4, 1, 1), ("m", 5, 1, 3)], "map_id string, seq int, a int, b int")
    told = lambda df: sorted((r.seq, r.a_path, r.b_path) for r in df.collect())
    assert told(structuring.links_by_number(nodes, links, cross=True)) == [(0, [0], [1]), (5, [0, 0], [1, 0])]
    assert told(structuring.links_by_number(nodes, links)) == [(0, [0], [1]), (5, [0, 0], [1, 0])]
    lines = {tuple(r.path): r.line for r in structuring.preview(nodes, max_depth=1).collect()}
    assert lines[(0,)] == "  # n[0]  (+1 more)" and (0, 0) not in lines
    sections = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "map_id string, number int, heading string")
    given = spark.createDataFrame([("a", ["X", " "]), ("b", ["Z", "too many"])], "map_id string, headings array<string>")
    assert sorted((r.map_id, r.number, r.heading) for r in structuring.polished(sections, given).collect()) == [("a", 1, "X"), ("a", 2, "y"), ("b", 1, "z")]
    done = [spark.createDataFrame([("a", "one")], "map_id string, engine string"), spark.createDataFrame([("a", "two"), ("b", "two")], "map_id string, engine string")]
    some = spark.createDataFrame([("a",), ("b",), ("c",)], "map_id string")
    assert sorted(tuple(r) for r in structuring.failover(some, done).collect()) == [("a", "one", False), ("b", "two", True), ("c", "heuristic", True)]
    rows = [{"path": p, "title": f"n{p}", "type": "root" if not p else "action", "note": None} for p in paths]
    raw = mapfiles.to_xmind(rows, [{"from_path": [0], "to_path": [1, 0], "label": "see"}, {"from_path": [0], "to_path": [7], "label": "lost"}], "https://example.org")
    assert mapfiles.xmind_links(raw) == [("n0", "n1-0", "see")]
    assert sorted((x[0], x[2], x[3]) for x in mapfiles.xmind_rows(raw)) == sorted((r["path"], r["title"], r["type"]) for r in rows)


def test_outline_of_one_long_source_over_many_parts(spark):
    import random
    import time

    rnd = random.Random(5)
    rows = [(f"s{rnd.randrange(3)}", i, rnd.choice([1, 1, 2, 3, 3, 5, None] if i % 50 == 0 else [1, 2, 2, 3, 4]), f"t{i}", i) for i in range(2000)]
    rows += [("z", i, 2 if i < 900 else 1, "t", 0) for i in range(1000)]
    want = {}
    for source in {r[0] for r in rows}:
        stack = []
        for _, seq, level, *_ in sorted(r for r in rows if r[0] == source):
            known = [o for o in stack if level is not None and o[0] is not None]
            closed = [o for o in known if o[0] >= level]
            stack = [o for o in known if o[0] < level] + [(level, closed[0][1] + 1 if closed else 0)]
            want[source, seq] = [o[1] for o in stack]
    schema = "source string, seq int, level int, title string, page int"
    for parts, fold in (("16", "false"), ("4", "true")):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", fold)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = trees.outline_tree(spark.createDataFrame(rows, schema)).collect()
        assert len(got) == len(rows) and {(r.source, r.seq): r.path for r in got} == want
    assert trees.outline_tree(spark.createDataFrame([], schema)).collect() == []
    # One source of 100,000 entries: a fold that copies the paths so far for each entry takes minutes.
    begun = time.time()
    many = spark.range(100_000).selectExpr("'s' source", "cast(id as int) seq", "if(id % 100 = 0, 1, 2) level", "'t' title", "0 page")
    out = trees.outline_tree(many)
    assert out.filter("seq = 99999").first().path == [999, 98] and out.count() == 100_000
    assert time.time() - begun < 40


def test_outlines_of_a_large_file_are_read_without_their_tree():
    import tracemalloc

    row = '<outline text="node {}" _note="n"><foo><outline text="no"/></foo><outline text="below"/></outline>'
    raw = ("<opml><head/><body><outline text='R'>" + "".join(row.format(i) for i in range(30_000)) + "</outline><outline text='S'/></body></opml>").encode()
    tracemalloc.start()
    n = sum(1 for _ in mapfiles.opml_rows(raw))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 60_001 and peak < 5_000_000
    rows = sorted(mapfiles.opml_rows(raw, every=True))
    assert rows[0] == ([0], None, "R", "root", None) and rows[-1] == ([1], None, "S", "root", None) and ([0, 29_999, 0], None, "below", "topic", None) in rows
    for broken in (b"<opml><body/></opml>", b"<opml><outline/></opml>", raw[:-9], b""):
        with pytest.raises(Exception):
            list(mapfiles.opml_rows(broken))


def _long_xmind(more: str = "") -> bytes:
    """A file of 100,001 topics in 60 MB of content, its root's own values after its children, two links, and a second sheet."""
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z, z.open("content.json", "w") as stream:
        stream.write(b'[{"rootTopic": {"children": {"detached": [{"title": "no"}], "attached": [')
        for i in range(0, 100_000, 1000):
            topics = (f'{{"id": "t{j}", "title": "node {j}", "notes": {{"plain": {{"content": "{"note " * 110}"}}}}, "children": {{"attached": []}}}}' for j in range(i, i + 1000))
            stream.write(((", " if i else "") + ", ".join(topics)).encode())
        stream.write(b']}, "id": "r", "title": "R", "href": "https://a.org"}, "relationships": [{"end1Id": "t99999", "end2Id": "r", "title": "up"}, {"end1Id": "t0"}, {"end1Id": "t0", "end2Id": "t1"}],')
        stream.write(f'"title": "Long"}}, {{"rootTopic": {{"title": "second"}}}}, {{}}]{more}'.encode())
    return out.getvalue()


def test_long_content_of_a_map_file_is_read_in_pieces(spark):
    import tracemalloc

    from canopy.operators import merging

    raw = _long_xmind()
    tracemalloc.start()
    n = sum(1 for _ in mapfiles.xmind_rows(raw))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 100_001 and peak < 20_000_000
    opml = b'<opml><head><title>Head</title></head><body><outline text="one"/></body></opml>'
    files = spark.createDataFrame([("a.xmind", raw, 0), ("b.opml", opml, 1)], "path string, content binary, ordinal int")
    tree, _, _ = merging.merge_files(files)
    assert tree.count() == 100_003 and tree.filter("title = 'node 99999'").first().path == [0, 99_999]
    assert [r.title for r in tree.filter("size(path) = 1").orderBy("path").collect()] == ["Long", "Head"]
    assert mapfiles.heads(files).filter("map_id = 'a.xmind'").first().source == "https://a.org"


def test_json_is_read_alike_in_pieces_of_any_size(monkeypatch):
    import io
    import json
    import zipfile

    rows = [{"path": p, "title": f"n{p} \"é\" ]}}", "type": "root" if not p else "action", "note": "a\nb" if len(p) == 2 else None} for p in ([], [0], [0, 0], [0, 1], [0, 1, 0], [2], [2, 4])]
    raw = mapfiles.to_xmind(rows, [{"from_path": [0], "to_path": [2, 4], "label": "see"}], "https://a.org")
    want = [(r["title"], r["type"], r["note"]) for r in rows]
    content = zipfile.ZipFile(io.BytesIO(raw)).read("content.json")

    def filed(made: bytes) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("content.json", made)
        return out.getvalue()

    for piece in (4, 30, 1 << 16):
        monkeypatch.setattr(mapfiles, "PIECE", piece)
        for made in (content, json.dumps(json.loads(content), indent=40).encode("utf-16"), b"\xef\xbb\xbf" + content):
            assert sorted(((r[2], r[3], r[4]) for r in mapfiles.xmind_rows(filed(made))), key=str) == sorted(want, key=str)
            assert sorted(r[0] for r in mapfiles.xmind_rows(filed(made))) == [[], [0], [0, 0], [0, 1], [0, 1, 0], [1], [1, 0]]
            assert mapfiles.map_head("x.xmind", filed(made)) == (rows[0]["title"], "https://a.org") and len(mapfiles.xmind_links(filed(made))) == 1
        for broken in (content[:-1], content + b"x", content.replace(b", ", b" ", 1), content.replace(b'{"attached"', b'{attached', 1), b"[]", b"{}", b"", b"[{}]", b'[{"rootTopic": null}]'):
            with pytest.raises(Exception):
                list(mapfiles.xmind_rows(filed(broken)))


def test_maps_are_written_node_by_node(spark):
    import tracemalloc

    for made in (mapfiles._Opml(), mapfiles._Xmind()):
        tracemalloc.start()
        made.add((), None, "R", "root", None)
        for i in range(100_000):
            made.add((i,), None, "node", "detail", None)
        raw = made.close()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 4_000_000 + 2.2 * len(raw)
    nodes = spark.range(30_000).selectExpr("id % 3 map_id", "if(id < 3, array(), array(cast(id as int))) path", "concat('t', id) title", "if(id < 3, 'root', 'topic') type", "cast(null as string) note")
    nodes = nodes.repartition(7, "title")
    links = spark.createDataFrame([(1, 0, [4], [7], "x"), (1, 1, [4], [5], "lost"), (2, 0, [5], [], None)], "map_id long, seq int, a_path array<int>, b_path array<int>, label string")
    for form in ("opml", "xmind"):
        files = mapfiles.render(nodes, form, links, spark.createDataFrame([(2, "https://b.org"), (9, "none")], "map_id long, source string"))
        raw = {r.map_id: bytes(r.content) for r in files.collect()}
        assert sorted(raw) == [0, 1, 2]
        for m, content in raw.items():
            rows = mapfiles.opml_rows(content) if form == "opml" else mapfiles.xmind_rows(content)
            assert sorted((p, t) for p, _, t, _, _ in rows) == [([], f"t{m}")] + [([i], f"t{3 * (i + 1) + m}") for i in range(9_999)]
    assert [mapfiles.xmind_links(raw[m]) for m in range(3)] == [[], [("n4", "n7", "x")], [("n5", "n", "")]]
    assert mapfiles.map_head("x.xmind", raw[2])[1] == "https://b.org"
    # A node whose parent is missing was left out of XMind without a word.
    with pytest.raises(ValueError, match="no parent"):
        mapfiles.to_xmind([{"path": p, "title": "t", "type": "topic", "note": None} for p in ([], [0, 0])])


def test_links_of_long_content_are_merged(spark):
    from canopy.operators import merging

    opml = b'<opml><body><outline text="one"/></body></opml>'
    files = spark.createDataFrame([("b.opml", opml, 0), ("a.xmind", _long_xmind(), 1)], "path string, content binary, ordinal int")
    _, links, lost = merging.merge_files(files)
    assert sorted((r.seq - (1 << 32), r.a_path, r.b_path, r.label) for r in links.collect()) == [(0, [1, 99_999], [1], "up"), (1, [1, 0], [1, 1], "")]
    assert lost.count() == 0


def test_files_that_cannot_be_searched_are_told(spark, monkeypatch):
    from canopy.operators import merging
    from canopy.plans import files as queries

    raw, title = _long_xmind(), "node 9999"
    files = spark.createDataFrame([("a.xmind", raw), ("cut.xmind", _long_xmind("{")), ("c.opml", b"<opml>"), ("e.txt", b""), ("d.opml", b'<opml><body><outline text="R"/></body></opml>')], "path string, content binary")
    want = [("a.xmind", [0, 9_999], title), ("a.xmind", [0, 99_990], f"{title}0"), ("a.xmind", [0, 99_991], f"{title}1")]
    assert [(r.map_id, r.path, r.title) for r in merging.lenient_search(files, title, 3).orderBy("path").collect()] == want
    found, failed = merging.search(files, title, 3)
    assert [(r.map_id, r.path, r.title) for r in found.orderBy("path").collect()] == want
    assert sorted(r.map_id for r in failed.filter("length(error) > 10").collect()) == ["c.opml", "cut.xmind", "e.txt"]
    assert [(r.map_id, r.title) for r in merging.search(files.filter("path = 'a.xmind'"), "SECOND")[0].collect()] == [("a.xmind", "second")]
    with pytest.raises(ValueError):
        merging.search(files, "")
    # The query's files were written by itself: one that can't be read is an error, not a file without a hit.
    monkeypatch.setattr(queries, "_files", lambda *_: files.withColumn("ordinal", F.lit(0)))
    with pytest.raises(ValueError, match="cut.xmind"):
        queries.search_files(spark, "")
    monkeypatch.setattr(queries, "_files", lambda *_: files.filter("path in ('a.xmind', 'd.opml')").withColumn("ordinal", F.lit(0)))
    assert queries.search_files(spark, "").count() == 10
