"""What there is to structure, what providers told of their limits, what is remembered; with odd rows."""

import os
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from canopy.functions import text as T
from canopy.operators import batches, store, usage
from canopy.operators.requests import Answers, ProviderError
from canopy.plans import surroundings  # noqa: F401  adds its queries
from canopy.sources import discovery

from .test_catalog import DATA, check


def test_course_pairs_recordings_with_subtitles(spark):
    names = ["Lesson 10.mp4", "lesson 9.mp3", "lesson 9.srt", "lesson 9.vtt", "notes.txt", "Lesson 2.PDF", "x.docx", "bare", ".srt", "a.b.mkv", "two.mp4", "two.mp3", "two.mp3", "two.srt", None]
    rows = [("f", n, i) for i, n in enumerate(names)] + [(None, "only.wav", 0)]
    got = discovery.course(spark.createDataFrame(rows, "folder string, name string, seq int")).collect()
    of = lambda folder: [(r.name, r.title, r.needs_transcription) for r in sorted(got, key=lambda r: r.seq) if r.folder == folder]
    assert of("f") == [
        ("a.b.mkv", "A.B", True), ("Lesson 2.PDF", "Lesson 2", False), ("lesson 9.vtt", "Lesson 9", False), ("Lesson 10.mp4", "Lesson 10", True),
        ("notes.txt", "Notes", False), ("two.srt", "Two", False), ("two.srt", "Two", False),
    ]
    assert of(None) == [("only.wav", "Only", True)] and sorted(r.seq for r in got if r.folder == "f") == list(range(7))
    assert discovery.course(spark.createDataFrame([], "folder string, name string")).count() == 0


def test_one_folder_with_most_files_is_many_tasks(spark):
    files = spark.range(20000).select(F.lit("big").alias("folder"), F.concat(F.lit("part "), F.col("id").cast("string"), F.lit(".mp4")).alias("name"))
    plan = discovery.course(files)
    got = plan.orderBy("seq").select("seq", "name").collect()
    assert [r.seq for r in got] == list(range(20000)) and [r.name for r in got] == [f"part {i}.mp4" for i in range(20000)]


def test_listing_names_its_entries(spark):
    lists = [
        ("a", '{"title": "L", "entries": [null, {"id": "x1", "title": "One"}, {"id": "x2"}, {"url": "u"}, {"title": "lost"}, {}, 5, "s", {"id": "", "title": "", "url": "v"}]}'),
        ("b", '{"entries": [{"id": "y"}]}'), ("c", '{"title": "none"}'), ("d", "[1]"), ("e", "{broken"), ("f", None), ("g", '{"entries": null}'), ("b", '{"entries": [{"id": "z"}]}'),
    ]
    entries, failed = discovery.listing(spark.createDataFrame(lists, "list_id string, content string"))
    watch = "https://www.youtube.com/watch?v="
    assert [tuple(r) for r in entries.orderBy("list_id", "seq", "url").collect()] == [
        ("a", "L", 0, "One", watch + "x1"), ("a", "L", 1, "x2", watch + "x2"), ("a", "L", 2, "Untitled", "u"), ("a", "L", 3, "Untitled", "v"),
        ("b", "Playlist", 0, "y", watch + "y"), ("b", "Playlist", 0, "z", watch + "z"),
    ]
    assert sorted(r.list_id for r in failed.collect()) == ["d", "e", "f"]


def test_settings_lines(spark):
    text = "\n# A=1\n A = 1 \r\nB=\"two\"\nB='three'\nno value\nC=\n  #D=4\nE=x=y\x0bF=6\nQ=\"'q'\"\n"
    got = discovery.settings(spark.createDataFrame([("f", text), ("g", None), ("h", "")], "file string, text string")).collect()
    assert {r.key: r.value for r in got} == {"A": "1", "B": "three", "C": "", "E": "x=y", "F": "6", "Q": "q"}


def test_quota_keeps_the_last_of_each_fact(spark):
    t = lambda d, h: datetime(2024, 1, d, h)
    head = lambda **h: {f"x-ratelimit-{k.replace('_', '-')}": str(v) for k, v in h.items()}
    rows = [
        ("p", "m1", t(1, 1), 200, head(limit_requests=10, remaining_requests=4, limit_tokens=7, reset_requests="1m2.5s"), None),
        ("p", "m2", t(2, 1), 200, head(limit_requests=9, reset_requests="soon"), "ok"),
        ("p", "m2", t(2, 2), 429, None, "Rate limit on tokens per day (TPD): Limit 100, Used 99. metric: a, limit: 1"),
        ("p", "m2", t(2, 3), 200, {"x-ratelimit-limit-requests": "many"}, "on requests per day (RPD): Limit 5, Used 5"),
        ("q", None, None, 429, {}, "Quota exceeded for metric: a.b/c_d,\nlimit: 50. Please"), ("q", None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "provider string, model string, at timestamp, status int, headers map<string,string>, body string")
    got = {r.provider: r.asDict() for r in usage.quota(df).collect()}
    p, q = got["p"], got["q"]
    assert (p["limit_requests"], p["remaining_requests"], p["limit_tokens"], p["remaining_tokens"]) == (9, 9, 7, None)
    assert (p["reset_requests_seconds"], p["observed_at"], p["model"], p["calls"], p["calls_today"]) == (62.5, t(2, 1), "m2", 4, 3)
    assert (p["daily_metric"], p["daily_value"], p["daily_used"], p["daily_at"], p["limit_metric"]) == ("tokens per day (TPD)", 100, 99, t(2, 2), None)
    assert (q["limit_metric"], q["limit_value"], q["limit_requests"], q["calls"], q["calls_today"], q["observed_at"]) == ("a.b/c_d", 50, None, 2, 2, None)
    assert usage.quota(df.limit(0)).count() == 0


def test_pace_is_eased_by_clean_runs(spark):
    runs = [("a", i, hit, pace, 2.0) for i, (hit, pace) in enumerate([(False, 2.0), (True, 5.0), (False, 5.0), (None, 4.25)])]
    runs += [("b", 1, False, 9.0, 2.0), ("c", 1, True, 1.5, 2.0), ("d", 1, True, 3.0, 2.0), *[("d", i, False, 3.0, 2.0) for i in range(2, 9)], (None, 1, True, 3.0, 2.0)]
    got = {r.provider: r.pace for r in usage.learned_pace(spark.createDataFrame(runs, "provider string, run int, hit_limit boolean, pace double, default_pace double")).collect()}
    assert got["a"] == pytest.approx(5 * 0.85**2) and (got["b"], got["c"], got["d"], got[None]) == (2.0, 1.5, 2.0, 3.0)


def test_quota_bars(spark):
    df = spark.createDataFrame([(0, 0), (5, 10), (6, 10), (17, 20), (3000, 2000), (None, 10)], "used int, total int")
    got = [tuple(r) for r in df.select(usage.level(F.col("used"), F.col("total")), usage.bar(F.col("used"), F.col("total"), 4)).collect()]
    assert got[:5] == [(None, "n/a"), ("green", "██░░ 5/10 (50%)"), ("yellow", "██░░ 6/10 (60%)"), ("red", "███░ 17/20 (85%)"), ("red", "████ 3,000/2,000 (100%)")]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 2**45) | st.integers(0, 5000).map(lambda n: n * 128), min_size=1, max_size=20))
def test_sizes_and_durations_as_python_prints_them(spark, sizes):
    def size(n):
        x = float(n)
        for unit in ("B", "KB", "MB", "GB"):
            if x < 1024 or unit == "GB":
                return f"{x:.0f}{unit}" if unit == "B" else f"{x:.1f}{unit}"
            x /= 1024

    def duration(s):
        if s < 60:
            return f"{s * 1000:.0f}ms" if s < 1 else f"{s:.0f}s"
        return f"{int(s) // 60}m{int(s) % 60:02d}s" if s < 3600 else f"{int(s) // 3600}h{int(s) // 60 % 60:02d}m"

    df = spark.createDataFrame([(n, n % 20000 / 4) for n in sizes], "n long, s double")
    assert [tuple(r) for r in df.select(T.human_size(F.col("n")), T.duration_text(F.col("s"))).collect()] == [(size(n), duration(n % 20000 / 4)) for n in sizes]


def test_natural_keys_and_titles_as_python_has_them(spark):
    import re

    names = ["abc", "abc0", "abc00", "abc1", "a10b2", "a9b30", "A9b4", "", "7", "07x", "b", "9" * 50, "8" * 51, "x-1", "it's o'neil", "a_b c", "2nd half"]
    key = lambda s: [int(x) if x.isdigit() else x.lower() for x in re.split(r"(\d+)", s)]
    got = [r.v for r in spark.createDataFrame([(n,) for n in names], "v string").orderBy(T.natural_key(F.col("v")), "v").collect()]
    assert got == sorted(sorted(names), key=key)
    titles = spark.createDataFrame([(n,) for n in names], "v string").select("v", T.title_case(F.col("v")).alias("t")).collect()
    assert all(r.t == r.v.title() for r in titles)


def test_listing_of_a_store_counts_last_versions(spark):
    kept = store.Store(spark)
    assert kept.listing("items").count() == 0
    kept.commit("bare", 1, "")
    assert [tuple(r)[::2] for r in kept.listing("items").collect()] == [("bare", 0)]
    kept.append("items", "a", 1, spark.range(5))
    kept.commit("a", 1, "")
    kept.append("items", "a", 2, spark.range(3).select(F.col("id").cast("string").alias("source")))  # columns of another type
    assert {r.source: r.n for r in kept.listing("items").collect()} == {"bare": 0, "a": 5}  # the second isn't committed
    kept.commit("a", 2, "")
    assert {r.source: r.n for r in kept.listing("items").collect()} == {"bare": 0, "a": 3}
    assert kept.forget("a") and not kept.forget("a") and {r.source for r in kept.listing("items").collect()} == {"bare"}


def test_result_of_a_first_run_has_no_changes(spark):
    nodes = spark.createDataFrame([([], "All"), ([0], "a"), ([1], "b"), ([1, 0], "c")], "path array<int>, title string")
    links = spark.createDataFrame([([0], [1]), ([1], [1, 0])], "a_path array<int>, b_path array<int>")
    outcomes = spark.createDataFrame([(1, "a", "ok"), (2, "b", "reused"), (3, "c", "failed")], "source int, label string, status string")
    [row] = batches.result(batches.Batch(nodes, links, outcomes, None, 1), title='a "b"').collect()
    assert row.result == '{"ok":true,"title":"a \\"b\\"","nodes":4,"depth":3,"relationships":2,"cross_source_relationships":1,"items_total":3,"items_ok":2,"items_failed":1,"reused":null,"added":null,"removed":null}'


def test_clean_input(spark):
    assert spark.createDataFrame([("﻿ a​b ⁠",)], "v string").select(T.clean_input(F.col("v"))).first()[0] == "ab"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["course_sources", "listing_entries", "listing_failures", "file_settings", "provider_quota", "provider_pace", "readable_sizes", "remembered", "batch_result", "export_names", "decoded_texts", "parsed_replies", "worst_checks"])
def test_query_equals_sql(spark, name):
    check(spark, name)


class Hurried:
    """Refuses each request once, if told to."""

    name, model = "hurried", "h1"

    def __init__(self, refuse):
        self.refuse, self.seen = refuse, set()

    def complete_json(self, system, user):
        if self.refuse and user not in self.seen:
            self.seen.add(user)
            raise ProviderError("slow down", retryable=True, after=0.0)
        return {"ok": user}


def test_paces_are_kept_from_run_to_run(spark):
    paces, log = usage.Paces(spark), store.Log(spark)
    assert paces.start("hurried", 0.01) == 0.01

    def run(refuse, *users):
        answers = Answers(Hurried(refuse), log, pace=0.01, paces=paces)
        begun = answers.pace
        got = answers.ask(spark.createDataFrame([(u,) for u in users], "u string"), "map", F.col("u"), [F.col("u")])
        assert got.filter("reply is not null").count() == len(users)
        answers.finish()
        return begun, answers.pace

    begun, ended = run(True, "a", "b")
    assert begun == 0.01 and ended == pytest.approx(0.1 * 1.6**2)  # two refusals
    again = run(False, "c")
    assert again == (pytest.approx(ended), pytest.approx(ended))
    assert paces.start("hurried", 0.01) == pytest.approx(ended * 0.85) and paces.start("other", 0.5) == 0.5
    assert run(False, "c")[0] == pytest.approx(ended * 0.85) and paces.start("hurried", 0.25) == 0.25  # never below the default
    assert paces.rows().count() == 3
