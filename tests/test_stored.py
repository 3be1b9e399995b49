"""What outlives a run: logs of keyed values, versions of batches."""

import pytest
from pyspark.sql import functions as F

from canopy.operators import batches, store


def test_log_reads_the_newest_valid_value(spark):
    log = store.Log(spark)
    put = lambda *rows: log.append(spark.createDataFrame(list(rows), "key string, value string"))
    read = lambda: {r.key: r.value for r in log.read().collect()}
    assert read() == {}
    put(("a", '{"v": 1}'), ("b", "[1"), ("c", '"x"'))
    assert read() == {"a": '{"v": 1}', "c": '"x"'}  # what isn't JSON is a miss
    put(("a", '{"v": 2}'), ("a", '{"v": 3}'), ("c", None))
    assert read() == {"a": '{"v": 3}'}
    put(("a", "{broken"))
    assert read() == {"a": '{"v": 3}'}  # as if it had never been written
    log.compact()
    assert read() == {"a": '{"v": 3}'} and log.rows().count() == 1
    log.clear()
    assert read() == {}
    put(("a", "4"))
    assert read() == {"a": "4"}


def test_numbers_are_gapless_in_order(spark):
    rows = spark.createDataFrame([(i % 7, i) for i in range(200)], "a int, b int").repartition(5)
    got = [(r.a, r.b) for r in store.numbered(rows, ["a", "b"], "n").orderBy("n").collect()]
    assert got == sorted((i % 7, i) for i in range(200))
    assert [r.n for r in store.numbered(rows, ["a", "b"], "n").select("n").orderBy("n").collect()] == list(range(200))
    assert store.numbered(rows.limit(0), ["a"], "n").count() == 0


ITEMS = "source string, label string, ordinal int, fingerprint string"


def builder(spark, texts, calls):
    """A map of two topics and a link for each source that has a text; others fail."""

    def build(todo):
        asked = sorted(r.source for r in todo.collect())
        calls.append(asked)
        if "boom" in [texts.get(s) for s in asked]:
            raise RuntimeError("provider down")
        some = [s for s in asked if texts.get(s)]
        nodes = [(s, p, t, k, None) for s in some for p, t, k in (([], s, "root"), ([0], texts[s], "topic"), ([1], "second", "topic"))]
        kinds = "map_id string, path array<int>, title string, type string, note string"
        return spark.createDataFrame(nodes, kinds), spark.createDataFrame([(s, 0, [0], [1], "then") for s in some], "map_id string, seq long, a_path array<int>, b_path array<int>, label string")

    return build


def told(batch):
    return {tuple(r.path): (r.title, r.type) for r in batch.nodes.collect()}


def test_a_second_run_restores_what_did_not_change(spark):
    kept, calls = store.Store(spark), []
    items = lambda *rows: spark.createDataFrame(list(rows), ITEMS)
    first = batches.run(kept, "list", items(("x", "X", 1, "1"), ("y", "Y", 0, None), ("z", "Z", 2, "1")), builder(spark, {"x": "old x", "y": "old y"}, calls), "All")
    assert first.diff is None and {r.source: r.status for r in first.outcomes.collect()} == {"x": "ok", "y": "ok", "z": "failed"}
    assert told(first) == {(): ("All", "root"), (0,): ("Y", "topic"), (0, 0): ("old y", "topic"), (0, 1): ("second", "topic"), (1,): ("X", "topic"), (1, 0): ("old x", "topic"), (1, 1): ("second", "topic")}
    second = batches.run(kept, "list", items(("y", "Why", 0, "9"), ("x", "X", 1, "2"), ("w", "W", 3, "1")), builder(spark, {"x": "new x", "y": "new y", "w": "w"}, calls), "All")
    assert calls == [["x", "y", "z"], ["w", "x"]]  # y had no fingerprint: it is taken as it was
    tree = told(second)
    assert tree[(0,)] == ("Why", "topic") and tree[(0, 0)] == ("old y", "topic") and tree[(1, 0)] == ("new x", "topic") and tree[(2, 0)] == ("w", "topic")
    assert sorted((r.a_path, r.b_path, r.label) for r in second.links.collect()) == [([k, 0], [k, 1], "then") for k in range(3)]
    assert sorted((r.label, r.status) for r in second.diff.collect()) == [("W", "added"), ("Why", "reused"), ("X", "added")]
    third = batches.run(kept, "list", items(("w", "W", 0, "1")), builder(spark, {}, calls), "All")
    assert calls[-1] == [] and sorted((r.label, r.status) for r in third.diff.collect()) == [("W", "reused"), ("Why", "removed"), ("X", "removed")]


def test_a_failed_run_leaves_the_last_version(spark):
    kept, calls = store.Store(spark), []
    items = spark.createDataFrame([("x", "X", 0, "1"), ("y", "Y", 1, "1")], ITEMS)
    batches.run(kept, "list", items, builder(spark, {"x": "one", "y": "two"}, calls), "All")
    before = kept.version("list", '{"level": "full"}')
    with pytest.raises(RuntimeError):
        batches.run(kept, "list", items.withColumn("fingerprint", F.lit("2")), builder(spark, {"x": "boom"}, calls), "All")
    assert kept.version("list", '{"level": "full"}') == before
    again = batches.run(kept, "list", items, builder(spark, {}, calls), "All")
    assert calls[-1] == [] and told(again)[(0, 0)] == ("one", "topic")


def test_steps_are_committed_each(spark):
    kept, calls = store.Store(spark), []
    items = spark.createDataFrame([(f"s{i}", f"S{i}", i, "1") for i in range(12)], ITEMS)
    texts = {f"s{i}": "t" for i in range(12)}
    bad = {**texts, "s3": "boom"}
    with pytest.raises(RuntimeError):
        batches.run(kept, "list", items, builder(spark, bad, calls), "All", blocks=4)
    done = {s for c in calls[:-1] for s in c}
    calls.clear()
    out = batches.run(kept, "list", items, builder(spark, texts, calls), "All", blocks=4)
    assert {s for c in calls for s in c} == set(texts) - done and len(told(out)) == 1 + 12 * 3


def test_other_levels_forgetting_and_status(spark):
    kept, calls = store.Store(spark), []
    items = spark.createDataFrame([("x", "X", 0, "1")], ITEMS)
    build = builder(spark, {"x": "one"}, calls)
    assert kept.status().count() == 0 and not kept.forget("list")
    batches.run(kept, "list", items, build, "All")
    assert batches.run(kept, "list", items, build, "All", level="brief").diff is None and calls == [["x"], ["x"]]
    batches.run(kept, "list", items, build, "All", level="brief", incremental=False)
    assert len(calls) == 3
    assert [(r.source, r.params) for r in kept.status().collect()] == [("list", '{"level": "brief"}')]
    assert kept.vacuum(batches.TABLES, "list") == 6 and kept.version("list", '{"level": "brief"}')
    assert kept.forget("list") and kept.status().count() == 0 and kept.version("list", '{"level": "brief"}') is None


def test_nothing_built_says_so(spark):
    items = spark.createDataFrame([("x", "X", 0, "1")], ITEMS)
    out = batches.run(store.Store(spark), "list", items, builder(spark, {}, []), "All")
    assert told(out) == {(): ("All", "root"), (0,): ("(no items processed successfully)", "detail")} and out.links.count() == 0


def test_files_are_merged_with_their_links(spark):
    import io
    import json
    import zipfile

    from canopy.operators import merging
    from canopy.sources import mapfiles

    node = lambda m, path, title, kind, i=None: (m, path, title, kind, None, i)
    nodes = spark.createDataFrame([node("a", [], "Map A", "root"), node("a", [0], "x", "concept", "same"), node("a", [1], "y", "warning", "same"), node("a", [1, 0], "z", "detail")], "map_id string, path array<int>, title string, type string, note string, node_id string")
    links = spark.createDataFrame([("a", 1, [0], [1, 0], "second"), ("a", 0, [1], [0], "first"), ("a", 2, [0], [9], "nowhere")], "map_id string, seq int, a_path array<int>, b_path array<int>, label string")
    made = mapfiles.render(nodes.withColumn("node_id", F.lit(None).cast("string")), "xmind", links, spark.createDataFrame([("a", "https://a.org")], "map_id string, source string")).first().content
    other = json.dumps([{"title": "", "rootTopic": {"id": "r", "title": "", "children": {"attached": [{"id": "q", "title": "k"}, {"id": "q", "title": "l"}]}},
                         "relationships": [{"end1Id": "q", "end2Id": "r"}, {"end1Id": "q", "end2Id": "gone"}, {"end1Id": "q"}]}, {"title": "2", "rootTopic": {"title": "second sheet"}}])
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("content.json", other)
    opml = b'<opml><head><title>Head</title></head><body><outline text="one" kind="warning"/><outline text="two"/></body></opml>'
    files = spark.createDataFrame([("d/a.xmind", made, 0), ("d/stem.b.xmind", raw.getvalue(), 1), ("c.opml", opml, 2)], "path string, content binary, ordinal int")
    tree, drawn, lost = merging.merge_files(files)
    assert {tuple(r.path): (r.title, r.type) for r in tree.collect()} == {
        (): ("Merged Map", "root"), (0,): ("Map A", "topic"), (0, 0): ("x", "concept"), (0, 1): ("y", "warning"), (0, 1, 0): ("z", "detail"),
        (1,): ("stem.b", "topic"), (1, 0): ("k", "topic"), (1, 1): ("l", "topic"), (2,): ("Head", "topic"),
    }
    assert [(r.a_path, r.b_path, r.label) for r in drawn.orderBy("seq").collect()] == [([0, 1], [0, 0], "first"), ([0, 0], [0, 1, 0], "second"), ([1, 0], [1], "")]
    assert [tuple(r) for r in lost.collect()] == [("d/stem.b.xmind", 1)]
    assert {r.map_id: r.source for r in mapfiles.heads(files).collect()} == {"d/a.xmind": "https://a.org", "d/stem.b.xmind": "d/stem.b.xmind", "c.opml": "c.opml"}
    with pytest.raises(ValueError):
        merging.merge_files(files.limit(1))
    # A lenient scan sees every sheet and outline, and passes over what is broken; another attribute may name the types.
    some = files.drop("ordinal").unionByName(spark.createDataFrame([("bad.xmind", b"x"), ("e.txt", b"")], "path string, content binary"))
    assert {(r.map_id, tuple(r.path), r.title) for r in mapfiles.parse(some, lenient=True).filter("map_id <> 'd/a.xmind'").collect()} == {
        ("d/stem.b.xmind", (0,), ""), ("d/stem.b.xmind", (0, 0), "k"), ("d/stem.b.xmind", (0, 1), "l"), ("d/stem.b.xmind", (1,), "second sheet"), ("c.opml", (0,), "one"), ("c.opml", (1,), "two"),
    }
    assert [r.type for r in mapfiles.parse(files.filter("path = 'c.opml'"), type_attribute="kind").collect()] == ["warning"]
    assert [(r.map_id, r.title) for r in merging.lenient_search(some, "SECOND").collect()] == [("d/stem.b.xmind", "second sheet")]
    with pytest.raises(Exception, match="ends in"):
        mapfiles.parse(some.filter("path = 'e.txt'")).count()
    assert merging.counts(nodes, links).first() == ("a", 4, 3, 3)


def test_what_a_root_points_at(spark):
    from canopy.sources import mapfiles

    rows = spark.createDataFrame([("https://a.org/x", False), ("file:///a", False), ("/d/my file.pdf", True), ("gone.pdf", False)], "source string, is_file boolean")
    assert [r[0] for r in rows.select(mapfiles.source_href(F.col("source"), F.col("is_file"))).collect()] == ["https://a.org/x", "file:///a", "file:///d/my%20file.pdf", None]


LISTED = "path string, parent string, name string, is_dir boolean, size long, mtime double, depth int"


def listing(spark, files, root="Root"):
    """Rows of a folder listing from {path: size}, with all folders above them."""
    rows = {"/": ("/", None, root, True, 0, 0.0, 0)}
    for path, size in files.items():
        parts = path.strip("/").split("/")
        for k in range(1, len(parts) + 1):
            at, is_dir = "/" + "/".join(parts[:k]), k < len(parts) or size is None
            rows.setdefault(at, (at, "/" + "/".join(parts[: k - 1]), parts[k - 1], is_dir, 0 if is_dir else size, 0.0, k))
    return spark.createDataFrame(list(rows.values()), LISTED)


def test_folder_maps_show_folders_first_and_cap(spark):
    from canopy.operators import foldertrees

    files = listing(spark, {"/b.txt": 1, "/A.txt": 1, "/README.md": 1, "/z/deep/er/x": 1, "/z/deep/y": 1, "/z/f1": 1, "/empty": None, **{f"/many/{i}.t": 1 for i in range(6)}})
    nodes = foldertrees.build(files, max_depth=2, max_files=3)
    assert {tuple(r.path): (r.title, r.type, r.note) for r in nodes.collect()} == {
        (): ("Root", "root", "3 folder(s), 3 file(s)"), (0,): ("empty", "topic", None), (1,): ("many", "topic", "0 folder(s), 6 file(s)"), (1, 0): ("0.t", "detail", None), (1, 1): ("1.t", "detail", None),
        (1, 2): ("2.t", "detail", None), (1, 3): ("+3 more file(s)", "detail", None), (2,): ("z", "topic", "1 folder(s), 1 file(s)"), (2, 0): ("deep", "topic", None), (2, 0, 0): ("+3 more item(s)", "detail", None),
        (2, 1): ("f1", "detail", None), (3,): ("A.txt", "detail", None), (4,): ("b.txt", "detail", None), (5,): ("README.md", "definition", None),
    }
    every = listing(spark, {"/z/deep/er/x": 1, "/z/deep/y": 1, "/z/deep/.git/config": 1}).select("path")
    assert [r.title for r in foldertrees.build(files, 2, 3, every).filter("title like '%item%'").collect()] == ["+5 more item(s)"]
    bare = listing(spark, {})
    assert [(r.path, r.title, r.note) for r in foldertrees.build(bare).collect()] == [([], "Root", None)] and foldertrees.signatures(bare).count() == 1


def test_folder_labels_stay_where_nothing_changed(spark):
    from canopy.operators import foldertrees, modelled, requests
    from canopy.operators.echo import EchoProvider

    kept, log = store.Store(spark), store.Log(spark)
    answers = requests.Answers(EchoProvider(), log)

    def label(nodes, wanted):
        under = lambda df: df.withColumn("map_id", F.lit("r"))
        out, failures = modelled.label_folders(under(nodes), under(wanted), answers)
        assert failures.count() == 0
        return out.drop("map_id")

    notes = lambda tree: {r.title: r.note for r in tree.nodes.filter("folder is not null").collect()}
    was = {"/a/x": 1, "/a/in/y": 1, "/b/z": 1}
    first = foldertrees.run(kept, "r", listing(spark, was), label=label)
    assert first.diff is None and notes(first) == {"Root": "2 folder(s), 0 file(s)", "a": "a with 2", "in": "in with 1", "b": "b with 1"} and answers.asked() == 3
    second = foldertrees.run(kept, "r", listing(spark, {**was, "/a/x": 2, "/c/w": 1}), label=label)
    assert {(r.folder, r.status) for r in second.diff.collect()} == {("/", "changed"), ("/a", "changed"), ("/a/in", "reused"), ("/b", "reused"), ("/c", "added")}
    assert sorted(tuple(r.path) for r in second.wanted.collect()) == [(0,), (2,)] and answers.asked() == 4  # a's listing is as it was, so its label is known
    assert notes(second)["in"] == "in with 1" and notes(second)["c"] == "c with 1"

    def broken(nodes, wanted):
        raise RuntimeError("provider down")

    with pytest.raises(RuntimeError):
        foldertrees.run(kept, "r", listing(spark, {"/a/x": 9}), label=broken)
    third = foldertrees.run(kept, "r", listing(spark, {"/b/z": 1}))
    assert {(r.folder, r.status) for r in third.diff.collect()} == {("/", "changed"), ("/b", "reused"), ("/a", "deleted"), ("/a/in", "deleted"), ("/c", "deleted")}
    assert notes(third)["b"] == "b with 1" and third.wanted.count() == 0
    assert foldertrees.run(kept, "r", listing(spark, {"/b/z": 1}), max_files=5).diff is None  # other caps
    assert foldertrees.run(kept, "r", listing(spark, {"/b/z": 1}), max_files=5, incremental=False).diff is None


def test_spans_become_lines(spark):
    from canopy.operators import trees
    from canopy.sources import spans

    rows = [("s", 0, 0, 0, 1, 9.0, "lo "), ("s", 0, 0, 0, 0, 10.26, " Hel"), ("s", 0, 0, 1, 0, 10.25, " "), ("s", 0, 1, 0, 0, 10.25, "half"), ("s", 1, 0, 0, 0, None, "none"), ("s", 1, 0, 1, 0, 10.75, None)]
    table = spark.createDataFrame(rows, "source string, page int, block int, line int, span int, size double, text string")
    assert [(r.seq, r.page, r.size, r.text) for r in spans.lines(table).orderBy("seq").collect()] == [(0, 0, 10.5, "Hello"), (1, 0, 10.0, "half"), (2, 1, 0.0, "none")]
    big = [("d", p, b, 0, 0, 18.0 if b == 0 else 10.0, f"{'Head' if b == 0 else 'body'} {p} {b}") for p in range(3) for b in range(4)]
    headings = trees.heading_levels(spans.lines(spark.createDataFrame(big, table.schema)))
    assert sorted((r.title, r.level, r.page) for r in headings.collect()) == [("Head 0 0", 1, 0), ("Head 1 0", 1, 1), ("Head 2 0", 1, 2)]


def test_timed_maps_tell_what_is_silent(spark):
    from canopy.operators import structuring

    rows = spark.createDataFrame([("a", i, f"Sentence {i}. More of it {i}.", float(i * 10), 4.0) for i in range(20)] + [("b", 0, " ", 0.0, 0.0), ("c", 0, "plain", 0.0, 0.0)], "source string, seq int, text string, start double, duration double")
    sources = spark.createDataFrame([("a", "Talk"), ("b", ""), ("c", None)], "source string, title string")
    got = {(r.map_id, tuple(r.path)): (r.title, r.type, r.timestamp) for r in structuring.timed_map(rows, sources).collect()}
    assert got[("a", ())] == ("Talk", "root", None) and got[("a", (1,))] == ("Sentence 2.", "topic", 20.0) and got[("a", (1, 0))] == ("More of it 2.", "detail", None)
    assert got[("b", (0,))] == ("(no content extracted)", "detail", None) and got[("c", (0,))] == ("Plain", "topic", None) and got[("c", ())][0] == "Mind Map"
    assert not any(len(p) > 1 for _, p in {(r.map_id, tuple(r.path)) for r in structuring.timed_map(rows, sources, "brief").collect()})


def test_previews_cut_at_the_root(spark):
    from canopy.operators import structuring

    nodes = spark.createDataFrame([("m", [], "R", "root", None), ("m", [0], "x", "topic", None)], "map_id string, path array<int>, title string, type string, note string")
    assert [r.line for r in structuring.preview(nodes, max_depth=0).collect()] == ["* R  (+1 more)"]
    assert [tuple(r) for r in structuring.failover(nodes.select("map_id").distinct(), []).collect()] == [("m", "heuristic", False)]


def test_routes_single_nodes_and_first_items(spark):
    from canopy.operators import snapshots, structuring

    sources = spark.createDataFrame([("a", 2), ("b", 0)], "map_id string, entries int")
    engines = lambda has: {r.map_id: r.engine for r in structuring.route(sources, F.col("entries") > 0, has).collect()}
    assert engines(True) == {"a": "document", "b": "llm"} and engines(False) == {"a": "document", "b": "heuristic"}
    nodes = spark.createDataFrame([("m", [0], "x"), ("m", [0, 1], "y"), ("n", [0, 1], "z")], "map_id string, path array<int>, title string")
    assert [r.title for r in structuring.node_at(nodes, "m", [0, 1]).collect()] == ["y"] and structuring.node_at(nodes, "m", [7]).count() == 0
    assert [r.title for r in snapshots.first_items(nodes, 2, "title").collect()] == ["x", "y"]


def test_a_listing_is_made_once_a_run(spark):
    from canopy.operators import foldertrees, snapshots

    made = spark.sparkContext.accumulator(0)
    rows = listing(spark, {"/a/x": 1, "/a/in/y": 1, "/b/z": 1})
    n = rows.count()

    def told(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    counted = rows.mapInArrow(told, rows.schema)
    foldertrees.run(store.Store(spark), "r", counted)
    assert made.value == n
    made.value = 0
    assert snapshots.merkle(counted).count() == 4 and made.value == 2 * n  # folders and files are read once each, whatever the depth
