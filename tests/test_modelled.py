"""Requests to a model and the stages around it: asked once, retried, failures as rows, whole trees out of replies."""

import json

import pytest
from pyspark.sql import functions as F

from canopy.operators import modelled, prompts, requests, store, trees
from canopy.operators.echo import EchoProvider
from canopy.operators.store import Log


def made(spark, log=None, **options):
    return requests.Answers(EchoProvider(**options), log or Log(spark))


def told(nodes, *more):
    return {(r.map_id, tuple(r.path)): tuple(r[c] for c in ("title", "type", *more)) for r in nodes.collect()}


class Flaky:
    """Fails as it is told, then answers."""

    name, model = "flaky", "1"

    def __init__(self, *errors):
        self.errors = list(errors)

    def complete_json(self, system, user):
        if self.errors:
            raise self.errors.pop(0)
        return {"user": user}


def test_retries_wait_longer_and_give_up_where_no_try_helps():
    waits = []
    ask = lambda *errors: requests.answer(Flaky(*errors), "s", "u", 3, requests.Pacer(0), waits.append)
    busy = requests.ProviderError("busy", retryable=True)
    assert ask() == ('{"user": "u"}', None) and waits == []
    assert ask(busy, OSError("reset")) == ('{"user": "u"}', None) and waits == [1.5, 3.0]
    assert ask(busy, busy, busy) == (None, "busy") and len(waits) == 4
    assert ask(requests.ProviderError("daily quota")) == (None, "daily quota") and len(waits) == 4
    assert ask(requests.ProviderError("busy", retryable=True, after=99)) == ('{"user": "u"}', None) and waits[-1] == 30
    with pytest.raises(ZeroDivisionError):  # an error of the program isn't the provider's
        ask(ZeroDivisionError())


def test_requests_keep_their_distance():
    now, waits = [0.0], []

    def sleep(seconds):
        waits.append(seconds)
        now[0] += seconds

    pacer = requests.Pacer(2.0, sleep, lambda: now[0])
    for _ in range(3):
        pacer.wait()
    assert waits == [2.0, 2.0]
    pacer.slower()
    assert pacer.spacing == 3.2
    for _ in range(20):
        pacer.slower()
    assert pacer.spacing == 30.0


def test_equal_requests_are_asked_once_and_kept(spark):
    log = Log(spark)
    rows = spark.createDataFrame([(i, f"text {i % 3}") for i in range(9)], "i int, text string")
    first = made(spark, log)
    got = first.ask(rows, "map", F.col("text"), [F.col("text")])
    assert got.count() == 9 and got.filter("reply is null").count() == 0 and first.ledger == [("map", 3, 0)]
    again = made(spark, log)
    again.ask(rows, "map", F.col("text"), [F.col("text")])
    assert again.asked() == 0
    other = requests.Answers(EchoProvider(), log, purpose="study", lanes=2)
    other.ask(rows, "map", F.col("text"), [F.col("text")])
    assert other.asked("map") == 3
    bad = made(spark, log, name="bad", fails_on="1")
    out = bad.ask(rows, "map", F.col("text"), [F.col("text")])
    assert {r.text: r.error for r in out.collect()} == {"text 0": None, "text 1": "bad refused", "text 2": None} and bad.ledger == [("map", 3, 1)]
    assert bad.ask(rows.limit(0), "map", F.col("text"), [F.col("text")]).count() == 0


def test_prompts_name_their_task():
    for task in prompts.REPLIES:
        assert prompts.system(task, "expert", "work", 8).startswith(f"TASK: {task}\n") and "At most 8." in prompts.system(task, limit=8)
    with pytest.raises(ValueError):
        prompts.system("none")


def test_nested_replies_become_rows(spark):
    reply = """{"children": [{"title": "", "type": "odd", "t": 3, "children": [{"title": "first", "title": "last", "note": "n"}, 5, [], "x"]},
      {"title": 7, "note": "", "children": {"not": "a list"}}, {"title": "deep", "children": [{"title": "a", "children": [{"title": "b", "children": []}]}]}]}"""
    replies = spark.createDataFrame([("m", reply), ("none", '{"children": []}'), ("odd", "{}"), ("null", None)], "map_id string, reply string")
    assert told(requests.unnest(replies), "note", "timestamp") == {
        ("m", (0,)): ("Untitled", "topic", None, 3.0), ("m", (0, 0)): ("last", "topic", "n", None), ("m", (1,)): ("7", "topic", None, None),
        ("m", (2,)): ("deep", "topic", None, None), ("m", (2, 0)): ("a", "topic", None, None), ("m", (2, 0, 0)): ("b", "topic", None, None),
    }
    assert len(told(requests.unnest(replies, deepest=1))) == 3 and requests.unnest(replies.limit(0)).count() == 0


def parts(spark, sizes):
    return spark.createDataFrame([(m, i, f"{m} part {i} of the talk") for m, n in sizes.items() for i in range(n)], "map_id string, part int, text string")


def test_parts_are_asked_together_and_found_alone(spark):
    log, some = Log(spark), parts(spark, {"long": 20, "short": 2})
    first = made(spark, log)
    got = modelled.map_parts(some, first)
    assert got.filter("reply is null").count() == 0
    assert first.asked("map") == 2 and first.asked("map_batch") == 7  # three parts a request of twenty
    again = made(spark, log)
    assert modelled.map_parts(some.filter("part <> 5"), again).count() == 21 and again.asked() == 0
    sorted_ = [json.loads(r.reply)["topic"] for r in got.filter("map_id = 'long'").orderBy("part").collect()]
    assert sorted_ == [f"long part {i}" for i in range(20)]


def test_reduction_tells_what_failed(spark):
    some = parts(spark, {"a": 2, "b": 1, "c": 1})
    answers = made(spark, fails_on="b part")
    sources = spark.createDataFrame([("a", "Title of a"), ("b", "B"), ("c", None), ("d", "nothing")], "map_id string, title string")
    nodes, failures = modelled.reduce_parts(modelled.map_parts(some, answers), sources, answers)
    tree = told(nodes)
    assert tree[("a", ())] == ("Title of a", "root") and tree[("c", ())] == ("c part 0", "root") and ("b", ()) not in tree
    assert tree[("a", (1, 1, 0))] == ("of a part 1", "detail") and tree[("a", (0, 1))] == ("0 of", "topic")
    assert {r.map_id: r.error for r in failures.collect()} == {"b": "no part was mapped", "d": "no part was mapped"}
    brief, _ = modelled.reduce_parts(modelled.map_parts(some, answers), sources, answers, "brief")
    assert max(len(p) for _, p in told(brief)) == 1


def test_sections_are_filled_or_fall_back(spark):
    rows = [("a", 1, "one", 5.0, "alpha beta"), ("a", 2, "", 9.0, "BAD text here"), ("b", 1, "x", 1.0, "BAD"), ("c", 1, "only", 0.0, "fine")]
    sections = spark.createDataFrame(rows, "map_id string, number int, heading string, start double, text string")
    intro = spark.createDataFrame([("a", 0.0, "word " * 40), ("c", 0.0, "too short"), ("z", 0.0, "word " * 50)], "map_id string, start double, text string")
    sources = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "")], "map_id string, title string")
    log = Log(spark)
    answers = made(spark, log, fails_on="BAD")
    nodes, failures = modelled.fill_sections(sections, intro, sources, answers)
    # The headings of a and b hold the word, so they stay as they are.
    assert told(nodes, "note", "timestamp") == {
        ("a", ()): ("A", "root", None, None), ("a", (0,)): ("Overview", "topic", " ".join(["word"] * 8), 0.0), ("a", (0, 0)): ("Overview", "insight", None, None),
        ("a", (1,)): ("1. one", "topic", "alpha beta", 5.0), ("a", (1, 0)): ("one", "insight", None, None), ("a", (2,)): ("2. Part 2", "topic", "BAD text here", 9.0),
        ("c", ()): ("Mind Map", "root", None, None), ("c", (0,)): ("1. Heading 1", "topic", "fine", 0.0), ("c", (0, 0)): ("Heading 1", "insight", None, None),
    }
    assert {(r.map_id, r.number, r.error) for r in failures.collect()} == {("a", 2, "echo refused"), ("b", None, "all sections failed")}
    again = made(spark, log)
    modelled.fill_sections(sections.filter("map_id = 'c'"), intro, sources, again)
    assert again.asked() == 0
    brief, _ = modelled.fill_sections(sections, intro, sources, made(spark), "brief")
    assert max(len(p) for _, p in told(brief)) == 1


def test_outlines_are_enriched_or_fall_back(spark):
    outline = spark.createDataFrame([(s, i, level, t, page) for s in "ab" for i, (level, t, page) in enumerate([(1, "H", 0), (2, "H1", 0), (1, "L", 1), (1, "E", 2)])], "source string, seq int, level int, title string, page int")
    pages = spark.createDataFrame([("a", 0, "alpha beta gamma delta"), ("a", 1, "BAD page"), ("a", 2, ""), ("b", 0, "BAD"), ("b", 1, "BAD too"), ("b", 2, " ")], "source string, seq int, text string")
    sources = spark.createDataFrame([("a", "Doc"), ("b", "B"), ("bare", "")], "map_id string, title string")
    nodes, failures = modelled.enrich_outline(outline, pages, sources, made(spark, fails_on="BAD"))
    assert told(nodes, "note") == {
        ("a", ()): ("Doc", "root", None), ("a", (0,)): ("H", "topic", None), ("a", (0, 0)): ("H1", "topic", "alpha beta gamma delta"), ("a", (0, 0, 0)): ("alpha beta", "example", None),
        ("a", (0, 0, 1)): ("gamma delta", "topic", None), ("a", (1,)): ("L", "topic", "(p. 2) BAD page"), ("a", (2,)): ("E", "topic", None),
        ("bare", ()): ("Document", "root", None), ("bare", (0,)): ("(no structure detected)", "detail", None),
    }
    assert {(r.map_id, r.path and tuple(r.path), r.error) for r in failures.collect()} == {("a", (1,), "echo refused"), ("b", None, "all sections failed")}
    plain, none = modelled.enrich_outline(outline, pages, sources, None)
    assert none is None and told(plain, "note")[("a", (0, 0))] == ("H1", "topic", "(p. 1) alpha beta gamma delta") and len(told(plain)) == 12


NODES = "map_id string, path array<int>, title string, type string, note string, timestamp double"


def tree(spark, name="m", titles=("one", "two")):
    rows = [(name, [], "Root", "root", None, None)] + [(name, [i], t, "topic", None, 1.0) for i, t in enumerate(titles)] + [(name, [0, 0], "below", "detail", "n", None)]
    return spark.createDataFrame(rows, NODES)


def test_lost_anchors_are_put_back(spark):
    nodes = tree(spark).unionByName(tree(spark, "whole", ("784 neurons", "x")))
    texts = spark.createDataFrame([("m", "It has 784 neurons, 13,000 weights and 99.5% recall, 20% less"), ("whole", "784 neurons")], "map_id string, text string")
    answers = made(spark)
    out, failures = modelled.repair_anchors(nodes, texts, answers)
    grown = {k: v for k, v in told(out).items() if k not in told(nodes)}
    # Four candidates for three nodes: the fourth goes below the first again.
    assert sorted(v[0] for v in grown.values()) == ["13,000", "20%", "784", "99.5%"] and set(grown) == {("m", (0, 1)), ("m", (0, 2)), ("m", (0, 0, 0)), ("m", (1, 0))}
    assert answers.asked("anchors") == 1 and failures.count() == 0
    same, _ = modelled.repair_anchors(nodes, texts, answers, "brief")
    assert told(same) == told(nodes) and answers.asked() == 1


def test_additions_take_the_next_places(spark):
    more = spark.createDataFrame([("m", [0], 5, "b", "topic", "x"), ("m", [0], 2, "a", "topic", None), ("m", [], 0, "c", "topic", None), ("m", [7], 0, "lost", "topic", None)], "map_id string, parent array<int>, seq int, title string, type string, note string")
    out = trees.insert(tree(spark), more)
    assert {k: v for k, v in told(out, "note").items() if k not in told(tree(spark))} == {("m", (0, 1)): ("a", "topic", None), ("m", (0, 2)): ("b", "topic", "x"), ("m", (2,)): ("c", "topic", None)}
    assert out.columns == tree(spark).columns


def test_takeaways_and_links(spark):
    nodes = tree(spark).unionByName(tree(spark, "small", ()).filter("size(path) = 0"))
    more, _ = modelled.take_away(nodes, made(spark))
    assert {k: v for k, v in told(more, "note").items() if k not in told(nodes)} == {("m", (2,)): ("Key Takeaways", "insight", None), ("m", (2, 0)): ("All of Root", "insight", "3")}
    links, _ = modelled.draw_links(nodes, made(spark))
    assert [(r.map_id, r.a_path, r.b_path, r.label) for r in links.collect()] == [("m", [0], [1], "first and last")]
    lost, failures = modelled.draw_links(nodes, made(spark, fails_on="below"))
    assert lost.count() == 0 and [tuple(r) for r in failures.collect()] == [("m", "echo refused")]


def test_each_provider_gets_what_is_left(spark):
    sources, calls = spark.createDataFrame([(i,) for i in range(6)], "map_id int"), []

    def by(name, keep):
        def build(left):
            calls.append((name, sorted(r.map_id for r in left.collect())))
            return left.filter(keep).select("map_id", F.lit(name).alias("title"))

        return name, build

    _, last = by("heuristic", "true")
    nodes, engines = modelled.fail_over(sources, [by("one", "map_id < 2"), by("two", "map_id < 5")], last)
    assert calls == [("one", [0, 1, 2, 3, 4, 5]), ("two", [2, 3, 4, 5]), ("heuristic", [5])] and nodes.count() == 6
    assert sorted(tuple(r) for r in engines.collect()) == [(0, "one", False), (1, "one", False), (2, "two", False), (3, "two", False), (4, "two", False), (5, "heuristic", True)]
    calls.clear()
    modelled.fail_over(sources, [by("one", "true"), by("two", "true")], last)
    assert [name for name, _ in calls] == ["one"]
    _, engines = modelled.fail_over(sources, [], last)
    assert {(r.engine, r.used_fallback) for r in engines.collect()} == {("heuristic", False)}


def test_folders_are_labelled(spark):
    nodes = tree(spark, titles=[f"f{i}" for i in range(40)])
    wanted = spark.createDataFrame([("m", []), ("m", [0]), ("m", [3])], "map_id string, path array<int>")
    out, failures = modelled.label_folders(nodes, wanted, made(spark, fails_on='"f3"}'))
    notes = told(out, "note")
    assert notes[("m", ())][2] == "Root with 25" and notes[("m", (0,))][2] == "f0 with 1" and notes[("m", (3,))][2] == "f3 with 0" and notes[("m", (4,))][2] is None and failures.count() == 0
    _, failures = modelled.label_folders(nodes, wanted, made(spark, name="other", fails_on="f3"))
    assert {tuple(r.path) for r in failures.collect()} == {(), (3,)}


def shuffled(spark):
    """Bytes of shuffles that were written so far."""
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}


def test_texts_of_requests_are_not_shuffled(spark, monkeypatch):
    def noise(i):  # text that no codec makes smaller than 32 of its 64 bytes
        return F.concat(i.cast("string"), F.lit(" b c d e f g h i j k l "), *[F.sha2(F.concat(i.cast("string"), F.lit(f" {k}")), 256) for k in range(60)])

    parts = spark.range(2000).select((F.col("id") % 400).alias("map_id"), (F.col("id") / 400).cast("int").alias("part"), noise(F.col("id") % 1900).alias("text"))  # 100 texts twice
    parts = parts.unionByName(spark.range(10).select(F.lit(1000).cast("long").alias("map_id"), F.col("id").cast("int").alias("part"), F.concat(F.lit("long map "), "id").alias("text")))
    before, answers = shuffled(spark), made(spark)
    got = {(r.map_id, r.part): r.reply for r in modelled.map_parts(parts, answers).select("map_id", "part", "reply").collect()}
    moved = sum(n for stage, n in shuffled(spark).items() if stage not in before)
    assert answers.asked("map") == 1900 and answers.asked("map_batch") == 5 and all(got.values()) and len(got) == 2010
    assert moved < 1900 * 60 * 32 / 2
    monkeypatch.setattr(store, "MOST", 0)  # nothing counts as small
    monkeypatch.setattr(modelled, "MOST", 0)
    again = made(spark)
    assert {(r.map_id, r.part): r.reply for r in modelled.map_parts(parts, again).collect()} == got and again.asked("map") == 1900
    # A log with some of the replies: only the rest is asked, whichever side is the smaller.
    some = made(spark, again.log)
    more = parts.unionByName(parts.filter("map_id < 3").withColumn("text", F.concat("text", F.lit(" more"))))
    assert modelled.map_parts(more, some).filter("reply is null").count() == 0 and some.asked("map") == 15
    monkeypatch.undo()
    more = more.unionByName(parts.filter("map_id = 5").withColumn("text", F.concat("text", F.lit(" more"))))
    assert modelled.map_parts(more, some).filter("reply is null").count() == 0 and some.asked("map") == 20


def test_known_keys_are_the_keys_that_are_read(spark):
    log = spark.createDataFrame([("a", "1", 1), ("a", None, 2), ("b", None, 3), ("b", "2", 3), ("c", "{", 4), ("d", "1", 5), ("d", "{", 6), (None, None, 0)], "key string, value string, version long")
    assert {r.key for r in store.known(log).collect()} == {r.key for r in store.latest(log).collect()} == {"b", "d"}


def test_maps_are_made_once_for_their_anchors(spark, monkeypatch):
    from canopy.operators import anchors

    rows = [("m", [], "Root", "root"), ("m", [0], "A", "topic"), ("m", [0, 0], "old", "detail"), ("n", [], "Other", "root"), ("n", [0], "Ann Lee", "topic")]
    plain = spark.createDataFrame(rows, "map_id string, path array<int>, title string, type string").withColumns({"note": F.lit(None).cast("string"), "timestamp": F.lit(None).cast("double")})
    made_rows = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made_rows.add(batch.num_rows)
            yield batch

    nodes = plain.mapInArrow(counted, plain.schema)
    texts = spark.createDataFrame([("m", "It grew by 2048 units in 1999."), ("n", "Nothing here."), ("x", None)], "map_id string, text string")
    out, failures = modelled.repair_anchors(nodes, texts, made(spark))
    got = told(out)
    assert failures.count() == 0 and made_rows.value == len(rows)
    assert {k: v for k, v in got.items() if v[0] in ("2048", "1999")} and len(got) == 7 and {k[0] for k in got} == {"m", "n"}
    monkeypatch.setattr(anchors, "MOST", 0)  # too many maps to pick them
    assert told(modelled.repair_anchors(plain, texts, made(spark))[0]) == got
