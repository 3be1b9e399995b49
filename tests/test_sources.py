from pyspark.sql import functions as F

from canopy.operators import outlines, snapshots
from canopy.sources import article, folders, markdown


def test_ignore_patterns():
    rules = [folders.git_pattern(x) for x in ("# note", "", "*.log", "/top", "deep/", "a/**/z.txt", "!keep.log")]
    cases = {"x.log": True, "a/x.log": True, "keep.log": False, "top": True, "a/top": False, "a/b/z.txt": True, "a/z.txt": True, "b/z.txt": False}
    for path, out in cases.items():
        assert folders.excluded(rules, path, False) == out, path
    assert folders.excluded(rules, "deep", True) and not folders.excluded(rules, "deep", False) and folders.excluded(rules, "x/deep", True)


def test_walk(spark, tmp_path):
    for name in ("src/auth/login.py", "README.md", "node_modules/x.js", "out.log", "src/pkg.egg-info/a"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    (tmp_path / ".gitignore").write_text("*.log\n")
    files = folders.walk(spark, str(tmp_path))
    assert {r.path for r in files.collect()} == {"/", "/src", "/src/auth", "/src/auth/login.py", "/README.md", "/.gitignore"}
    assert [r.name for r in files.filter(folders.notable(F.col("name"))).collect()] == ["README.md"]
    assert {r.path for r in snapshots.merkle(files).collect()} == {"/", "/src", "/src/auth"}


def test_article_sections(spark):
    html = "<html><head><title>T</title></head><body><nav>menu</nav><article><h1>My page</h1><p>Intro &amp; more<h2>One</h2><p>x</p><aside>no</aside><h2>Two</h2><p>y</article><footer>f</footer></body>"
    pages = spark.createDataFrame([(1, "https://a.org/my-page.html", html), (2, None, None)], "page_id int, url string, html string")
    rows = article.sections(pages).orderBy("seq").collect()
    assert [(r.level, r.heading, r.text) for r in rows] == [(0, "", "Intro & more"), (2, "One", "One\nx"), (2, "Two", "Two\ny")]


def test_outline_leaves_own_their_pages(spark):
    outline = spark.createDataFrame([("s", i, level, t, page) for i, (level, t, page) in enumerate([(1, "A", 0), (2, "A1", 0), (2, "A2", 2), (1, "B", 3)])], "source string, seq int, level int, title string, page int")
    pages = spark.createDataFrame([("s", i, f"p{i}") for i in range(5)], "source string, seq int, text string")
    assert [(r.title, r.path, r.text) for r in outlines.leaf_texts(outline, pages).orderBy("seq").collect()] == [("A", [0], None), ("A1", [0, 0], "p0 p1"), ("A2", [0, 1], "p2"), ("B", [1], "p3 p4")]
    assert [r.note for r in outlines.skeleton(outline, pages).orderBy("path").collect()] == [None, "(p. 1) p0 p1", "(p. 3) p2", "(p. 4) p3 p4"]


def test_roll_ups(spark):
    checks = spark.createDataFrame([("a", "ok"), ("a", "warn"), ("b", "fail"), ("b", "ok"), ("c", "ok")], "group string, status string")
    assert {r.group: r.worst for r in snapshots.diagnostics(checks).collect()} == {"a": "warn", "b": "fail", "c": "ok"}
    assert snapshots.outcome_counts(spark.createDataFrame([("failed",)], "status string")).first().all_failed


def test_outline_pages_by_number(spark):
    outline = spark.createDataFrame([("s", 0, 1, "A", 0), ("s", 1, 1, "B", 0), ("s", 2, 1, "C", None), ("s", 3, 1, "D", 9), ("t", 0, 1, "E", 0), ("u", 0, 1, "F", 0)], "source string, seq int, level int, title string, page int")
    pages = spark.createDataFrame([("s", 0, " p0 "), ("s", 1, None), ("s", 2, " "), ("t", 0, "a"), ("t", 1, "b"), ("t", 1, "b"), ("v", 0, "x")], "source string, seq int, text string")
    # Two of one page both have it; a null page and a page beyond the end have none; repeated pages stay.
    got = {(r.source, r.title): r.text for r in outlines.leaf_texts(outline, pages).collect()}
    assert got == {("s", "A"): "p0", ("s", "B"): "p0", ("s", "C"): "", ("s", "D"): "", ("t", "E"): "a b b", ("u", "F"): ""}
    assert outlines.leaf_texts(outline.limit(0), pages).count() == 0 and outlines.leaf_texts(outline, pages.limit(0)).filter("text <> ''").count() == 0


def test_sections_of_odd_texts(spark):
    long = "\n".join(f"## h{i}\nline {i}" for i in range(2000))
    texts = [(0, None), (1, ""), (2, "  \n "), (3, "only text"), (4, "# T\r\nintro\r\n\r\n# T\r\nmore"), (5, "intro\n# t"), (6, long), (7, "#no\n####### no\n###### six"), (8, "# T")]
    found = markdown.sections(spark.createDataFrame(texts, "source int, text string"), title=F.lit("t"))
    got = {}
    for r in found.orderBy("source", "seq").collect():
        got.setdefault(r.source, []).append((r.level, r.heading, r.text))
    assert got.pop(6) == [(2, f"h{i}", f"h{i}\nline {i}") for i in range(2000)]
    assert got == {3: [(0, "", "only text")], 4: [(0, "", "intro"), (1, "T", "T\nmore")], 5: [(0, "", "intro")], 7: [(0, "", "#no\n####### no"), (6, "six", "six")]}
