"""What there is to structure: the lessons of course folders, the entries of listings, settings files.

All are tables of many folders, lists or files at once. Places are counted over ranges of rows, so a folder or a list
that holds much of all rows is many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.store import numbered

#: What of a listing's JSON is read; entries stay text until they are known to be objects.
LISTING = "title string, entries array<string>"
ENTRY = "id string, title string, url string"


def stem_and_suffix(name):
    """(stem, suffix) of a file name: the suffix in lower case with its dot, empty if nothing stands before or after the last dot."""
    has = name.rlike(r"(?s)^.+\.[^.]+$")
    stem = F.when(has, F.regexp_extract(name, r"(?s)^(.+)\.[^.]+$", 1)).otherwise(name)
    return F.struct(stem.alias("stem"), F.when(has, F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))).otherwise("").alias("suffix"))


def placed(rows: DataFrame, group: str, order: list[str], name: str = "seq") -> DataFrame:
    """rows with a gapless number (long) from 0 within each group, in an order; no group is one task."""
    counted = numbered(rows, [group, *order], "_n")
    first = counted.groupBy(group).agg(F.min("_n").alias("_first"))
    same = F.col(f"r.{group}").eqNullSafe(F.col(f"f.{group}"))
    joined = counted.alias("r").join(first.alias("f"), same)
    return joined.select(*[F.col(f"r.{c}") for c in rows.columns], (F.col("r._n") - F.col("f._first")).alias(name))


def course(files: DataFrame) -> DataFrame:
    """(folder, seq, name, title, needs_transcription) of the lessons among the files (folder, name) that lie in each folder.

    A video or audio file is read by the subtitle file of the same stem, of several the last by name, else it needs
    transcription; subtitle files without a recording and PDF files are lessons too, anything else isn't. Two
    recordings of one stem are two lessons. Lessons are in the natural order of their stems ("Lesson 2" before
    "Lesson 10"), equal ones recordings first, then by name. A file that is listed twice counts once, one without a
    name not at all; a null folder is a folder of its own. An empty table has no lessons.
    """
    named = files.select("folder", "name").filter("name is not null").distinct()
    named = named.withColumn("s", stem_and_suffix(F.col("name"))).withColumn("kind", T.file_kind(F.col("s.suffix")))
    named = named.filter(F.col("kind").isin("video", "audio", "subtitle", "pdf")).select("folder", "name", F.col("s.stem").alias("stem"), "kind")
    # A stem of a folder has no more files than there are suffixes in upper and lower case, so its lists are bounded.
    media = F.col("kind").isin("video", "audio")
    each = named.groupBy("folder", "stem").agg(
        F.max(F.when(F.col("kind") == "subtitle", F.col("name"))).alias("subtitle"),
        F.collect_list(F.when(media, F.col("name"))).alias("media"), F.collect_list(F.when(F.col("kind") == "pdf", F.col("name"))).alias("pdfs"),
    )
    lesson = lambda name, waits, rank, by: F.struct(name.alias("name"), F.lit(waits).alias("needs_transcription"), F.lit(rank).alias("rank"), by.alias("by"))
    spoken = F.when(F.col("subtitle").isNull(), F.transform("media", lambda m: lesson(m, True, 0, m)))
    spoken = spoken.otherwise(F.transform("media", lambda m: lesson(F.col("subtitle"), False, 0, m)))
    alone = F.when((F.size("media") == 0) & F.col("subtitle").isNotNull(), F.array(lesson(F.col("subtitle"), False, 1, F.col("subtitle"))))
    none = F.filter(F.transform("media", lambda m: lesson(m, True, 0, m)), lambda m: F.lit(False))
    every = F.concat(spoken, F.coalesce(alone, none), F.transform("pdfs", lambda p: lesson(p, False, 2, p)))
    rows = each.select("folder", "stem", F.explode(every).alias("l")).select("folder", "stem", "l.*").withColumn("key", T.natural_key(F.col("stem")))
    ordered = placed(rows, "folder", ["key", "rank", "by"])
    return ordered.select("folder", "seq", "name", T.lesson_title(F.col("stem")).alias("title"), "needs_transcription")


def listing(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lists of videos as JSON (list_id, content): entries (list_id, list_title, seq, title, url) and failures (list_id, error).

    An entry is named by its title, else its id, else "Untitled", and found at its id's address, else at its url; one
    that has neither, is null or no object is passed over and takes no place. A list without a title is "Playlist".
    A content that is null or no JSON object is a failure; a list without entries is neither. Rows of one list_id are
    lists of their own.
    """
    bare = lambda c: F.nullif(c, F.lit(""))
    told = lists.select("list_id", F.from_json(F.when(F.try_parse_json("content").isNotNull() & F.ltrim("content").startswith("{"), F.col("content")), LISTING).alias("l"))
    failed = told.filter("l is null").select("list_id", F.lit("no data returned").alias("error"))
    entry = F.transform(F.filter("l.entries", lambda e: F.ltrim(e).startswith("{")), lambda e: F.from_json(e, ENTRY))
    address = lambda e: F.coalesce(F.concat(F.lit("https://www.youtube.com/watch?v="), bare(e["id"])), bare(e["url"]))
    name = lambda e: F.coalesce(bare(e["title"]), bare(e["id"]), F.lit("Untitled"))
    kept = F.filter(F.transform(entry, lambda e: F.struct(name(e).alias("title"), address(e).alias("url"))), lambda x: x["url"].isNotNull())
    rows = told.filter("l is not null").select("list_id", F.coalesce(bare(F.col("l.title")), F.lit("Playlist")).alias("list_title"), kept.alias("kept"))
    return rows.select("list_id", "list_title", F.posexplode("kept").alias("seq", "e")).select("list_id", "list_title", "seq", "e.*"), failed


def settings(files: DataFrame) -> DataFrame:
    """(file, key, value) of files (file, text) of lines KEY=value, of a repeated key the last one.

    Blank lines, lines that begin with # and lines without = are passed over; keys and values have no white space at
    their ends, values neither double quotes nor, below them, single ones. A null text has no lines; rows of one file
    are read as one, with lines of equal number in the order of their text.
    """
    lines = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"))
    rows = files.select("file", lines.alias("at", "line")).filter(F.col("line").contains("=")).withColumn("line", T.strip(F.col("line")))
    rows = rows.filter(~F.col("line").startswith("#"))
    value = F.trim(F.trim(T.strip(F.expr("substring(line, instr(line, '=') + 1)")), F.lit('"')), F.lit("'"))
    pairs = rows.select("file", T.strip(F.substring_index("line", "=", 1)).alias("key"), F.struct("at", "line", value.alias("value")).alias("v"))
    return pairs.groupBy("file", "key").agg(F.max("v")["value"].alias("value"))
