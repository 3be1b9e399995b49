"""OPML and XMind files, read and written as node and link rows."""

from __future__ import annotations

import codecs
import io
import json
import re
import zipfile
from collections.abc import Iterator
from itertools import islice
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import NODE_TYPES

#: Bytes of a file that are parsed, and rows that are held as Python's objects, at a time.
PIECE, ROWS = 1 << 16, 4096
NODES = "map_id string, path array<int>, node_id string, title string, type string, note string"
#: The attribute that keeps a node's type in OPML.
TYPE_ATTRIBUTE = "_nodeType"
# The markers that keep a node's type in XMind.
MARKERS = {
    "concept": "star-blue", "definition": "symbol-info", "example": "symbol-plus", "insight": "star-yellow", "action": "symbol-right",
    "warning": "symbol-exclam", "question": "symbol-question", "detail": "star-orange",
}

QUOTED = {'"': "&quot;", "\r": "&#13;", "\n": "&#10;", "\t": "&#09;"}
AS_JSON = json.JSONEncoder(ensure_ascii=False).encode


class _Json:
    """A JSON text that is read from a stream piece by piece; of a value longer than a piece only what is asked for is made."""

    LONG = object()
    SPACE = re.compile(r"[ \t\n\r]*")

    def __init__(self, stream):
        first = stream.read(PIECE)
        self.stream, self.raw_decode, self.decode = stream, json.JSONDecoder().raw_decode, codecs.getincrementaldecoder(json.detect_encoding(first))("surrogatepass").decode
        self.text, self.at, self.ended = self.decode(first), 0, False

    def ahead(self, least: int) -> None:
        """Reads on, if less than that lies ahead."""
        while len(self.text) - self.at < least and not self.ended:
            raw = self.stream.read(max(16 * PIECE, least))
            self.text, self.at, self.ended = self.text[self.at :] + self.decode(raw, not raw), 0, not raw

    def next(self) -> str:
        """The next character but white space, which stays; nothing at the end."""
        while True:
            self.at = self.SPACE.match(self.text, self.at).end()
            if self.at < len(self.text) or self.ended:
                return self.text[self.at : self.at + 1]
            self.ahead(1)

    def take(self, mark: str) -> None:
        if self.next() != mark:
            raise ValueError(f"the JSON lacks a {mark}")
        self.at += 1

    def whole(self, least: int = PIECE):
        """The next value, or LONG if it doesn't end in what was read so far, which is `least` characters or more."""
        self.next()
        self.ahead(least)
        try:
            found, end = self.raw_decode(self.text, self.at)
        except RecursionError:
            return self.LONG
        except json.JSONDecodeError as e:
            # A value that was cut fails where the text ends.
            if self.ended or (e.pos < len(self.text) - 16 and not e.msg.startswith("Unterminated")):
                raise
            return self.LONG
        if end > len(self.text) - 16 and not self.ended:  # a number may go on
            return self.LONG
        self.at = end
        return found

    def value(self):
        """The next value, however long."""
        least = PIECE
        while (found := self.whole(least)) is self.LONG:
            if self.ended:
                raise ValueError("the JSON is nested too deep")
            least = 2 * (len(self.text) - self.at)
        return found

    def _members(self, opens: str, closes: str) -> Iterator[bool]:
        self.take(opens)
        first = True
        while self.next() != closes:
            if not first:
                self.take(",")
            first = False
            yield True
        self.take(closes)

    def items(self) -> Iterator[bool]:
        """Stops before each item of an array, which has to be read then."""
        return self._members("[", "]")

    def keys(self) -> Iterator[str]:
        """Each key of an object, whose value has to be read then."""
        for _ in self._members("{", "}"):
            if self.next() != '"':
                raise ValueError("the JSON lacks a key")
            key = self.value()
            self.take(":")
            yield key

    def skip(self) -> None:
        """Passes over the next value."""
        todo = [iter((True,))]
        while todo:
            if next(todo[-1], None) is None:
                todo.pop()
            elif self.whole() is self.LONG:
                if self.next() in ("[", "{"):
                    todo.append(self.items() if self.next() == "[" else self.keys())
                else:
                    self.value()


def _below(text: _Json, own: dict) -> Iterator[bool]:
    """Stops before each child of a long topic; the topic's own values go to own."""
    for key in text.keys():
        if key == "children" and text.next() == "{":
            for kind in text.keys():
                if kind == "attached" and text.next() == "[":
                    yield from text.items()
                else:
                    text.skip()
        elif key in ("id", "title", "markers", "notes", "href"):
            own[key] = text.value()
        else:
            text.skip()


def _topics(text: _Json, path: tuple) -> Iterator[tuple[tuple, dict]]:
    """(path, topic) of a topic and of all below it, in any order; a topic longer than a piece comes without its children."""
    open_, path = [], path  # of each long topic that is open [path, its children, its own values, children so far]
    while True:
        topic = text.whole()
        if topic is text.LONG:
            own = {}
            open_.append([path, _below(text, own), own, 0])
        else:
            todo = [(path, topic)]
            while todo:
                at, one = todo.pop()
                yield at, one
                todo += [((*at, i), child) for i, child in enumerate((one.get("children") or {}).get("attached") or [])]
        while open_ and next(open_[-1][1], None) is None:
            at, _, own, _ = open_.pop()
            yield at, own
        if not open_:
            return
        path = (*open_[-1][0], open_[-1][3])
        open_[-1][3] += 1


def _xmind(raw: bytes, every: bool = False) -> Iterator[tuple]:
    """What the first sheet of an XMind file holds, or every sheet: ("topic", path, topic), ("link", relationship) and ("sheet", title).

    All of the content is read, of whatever size, a piece at a time. Of several sheets paths begin with the sheet's number.
    """
    with zipfile.ZipFile(io.BytesIO(raw)) as z, z.open("content.json") as stream:
        text, n = _Json(stream), 0
        for _ in text.items():
            if n and not every:
                text.skip()
                continue
            title, rooted = None, False
            for key in text.keys():
                if key == "rootTopic" and text.next() != "n":
                    rooted = True
                    yield from (("topic", *found) for found in _topics(text, (n,) if every else ()))
                elif key == "relationships" and text.next() == "[":
                    yield from (("link", text.value()) for _ in text.items())
                elif key == "title":
                    title = text.value()
                else:
                    text.skip()
            if not rooted and not every:
                raise ValueError("no root topic")
            yield "sheet", title
            n += 1
        if not n:
            raise ValueError("no sheets")
        if text.next():
            raise ValueError("the JSON goes on after its end")


class _Outline:
    """A target of an XML parser that passes on the outlines right below the body, and below each other, as rows; no tree is kept."""

    def __init__(self, type_attribute: str, every: bool):
        self.attribute, self.every, self.rows, self.tops = type_attribute, every, [], 0
        self.open, self.body = [], 0  # of each open element [path or None, outlines below it so far]; the body: 1 open, 2 closed

    def start(self, tag: str, given: dict) -> None:
        path, depth = None, len(self.open)
        if depth == 1 and tag == "body" and not self.body:
            self.body, path = 1, ()
        elif depth > 1 and tag == "outline" and self.open[-1][0] is not None:
            above = self.open[-1]
            path, above[1] = (*above[0], above[1]), above[1] + 1
            self.tops += depth == 2
            told = path if self.every else path[1:]
            if self.every or path[0] == 0:
                kind = given.get(self.attribute)
                self.rows.append((list(told), None, given.get("text") or "", kind if kind in NODE_TYPES else "topic" if depth > 2 else "root", given.get("_note") or None))
        self.open.append([path, 0])

    def end(self, tag: str) -> None:
        self.open.pop()
        if len(self.open) == 1 and self.body == 1:
            self.body = 2

    def close(self) -> None:
        if not self.tops:
            raise ValueError("no outline in the body")


class _Head(_Outline):
    """A target that keeps the head's title, as far as its first element, and the text of the first outline."""

    def __init__(self):
        super().__init__(TYPE_ATTRIBUTE, False)
        self.title = self.root = None
        self.head = self.telling = False

    def start(self, tag: str, given: dict) -> None:
        depth = len(self.open)
        self.head = tag == "head" if depth == 1 else self.head
        self.telling = depth == 2 and self.head and tag == "title" and self.title is None
        if self.telling:
            self.title = ""
        super().start(tag, given)
        if self.rows:
            self.root = self.rows[0][2] if self.root is None else self.root
            self.rows.clear()

    def data(self, text: str) -> None:
        if self.telling:
            self.title += text

    def end(self, tag: str) -> None:
        self.telling = False
        super().end(tag)

    def close(self) -> None:
        if not self.title:
            super().close()


def _fed(target: _Outline, raw: bytes) -> Iterator[list]:
    """The rows so far after each piece of a file, to be taken away."""
    parser = ElementTree.XMLParser(target=target)
    for at in range(0, len(raw), PIECE):
        parser.feed(raw[at : at + PIECE])
        yield target.rows
        target.rows.clear()
    parser.close()
    yield target.rows


def opml_rows(raw: bytes, type_attribute: str = TYPE_ATTRIBUTE, every: bool = False) -> Iterator[tuple]:
    """(path, id, title, type, note) of the first outline of an OPML body; files from elsewhere may name another attribute.

    every: of all outlines, whose paths then begin with the outline's number.
    """
    for rows in _fed(_Outline(type_attribute, every), raw):
        yield from rows


def xmind_rows(raw: bytes, every: bool = False) -> Iterator[tuple]:
    """The same of the first sheet of an XMind file, or of every sheet."""
    kinds = {m: k for k, m in MARKERS.items()}
    for what, *found in _xmind(raw, every):
        if what == "topic":
            path, topic = found
            kind = next((kinds[m["markerId"]] for m in topic.get("markers") or [] if m.get("markerId") in kinds), "topic" if len(path) > every else "root")
            note = topic.get("notes", {}).get("plain", {}).get("content")
            yield list(path), topic.get("id"), topic.get("title") or "", kind, note or None


def map_head(name: str, raw: bytes) -> tuple[str, str]:
    """(title, source) of a map file: its head's or sheet's title, else its root's; the root topic's href, else the file itself."""
    if _form(name) == "opml":
        head = _Head()
        for _ in _fed(head, raw):
            pass
        return head.title or head.root or "", name
    title, root = None, {}
    for what, *found in _xmind(raw):
        if what == "sheet":
            title = found[0]
        elif what == "topic" and not found[0]:
            root = found[1]
    return title or root.get("title") or "", root.get("href") or name


def _form(name: str) -> str:
    form = name.lower().rpartition(".")[2]
    if form not in ("opml", "xmind"):
        raise ValueError("a map file ends in .opml or .xmind")
    return form


def _each(files: DataFrame, rows_of, kinds: list[pa.DataType], schema: str, lenient: bool, told: bool = False) -> DataFrame:
    """rows_of(name, raw) of files (path, content), each row after its file's name; what can't be read is an error, or no rows if lenient.

    told: a column error more; a file that can't be read is one row that says why.
    """
    schema, kinds = (f"{schema}, error string", [*kinds, pa.string()]) if told else (schema, kinds)
    names = [c.split()[0] for c in schema.split(", ")]
    rest = (None,) if told else ()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), (x.as_py() for x in batch.column(1)), strict=True):
                # If lenient, a file's rows are passed on once all of it is read; until then they are columns, a few bytes a row more than the file.
                made = []
                try:
                    rows = iter(rows_of(name, raw))
                    while some := [(*row, *rest) for row in islice(rows, ROWS)]:
                        columns = [pa.array(c, t) for c, t in zip(zip(*some, strict=True), kinds, strict=True)]
                        made.append(pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), *columns], names))
                        if not lenient:
                            yield made.pop()
                except Exception as e:
                    if not lenient:
                        raise ValueError(f"{name}: {e}") from e
                    why = [pa.nulls(1, t) for t in kinds[:-1]] + [pa.array([f"{type(e).__name__}: {e}"], pa.string())]
                    made = [pa.RecordBatch.from_arrays([pa.array([name], pa.string()), *why], names)] if told else []
                while made:
                    yield made.pop(0)

    return files.select("path", "content").mapInArrow(run, schema)


def parse(files: DataFrame, lenient: bool = False, type_attribute: str = TYPE_ATTRIBUTE, told: bool = False) -> DataFrame:
    """Nodes of files (path, content); a file that can't be read is an error, or no rows if lenient.

    A lenient scan reads all outlines and all sheets of a file, their paths beginning with their number. If told, a
    column error says of each file that can't be read why, in one row without a node.
    """

    def rows(name: str, raw: bytes) -> Iterator[tuple]:
        return opml_rows(raw, type_attribute, lenient) if _form(name) == "opml" else xmind_rows(raw, lenient)

    return _each(files, rows, [pa.list_(pa.int32()), *[pa.string()] * 4], NODES, lenient, told)


def heads(files: DataFrame, lenient: bool = False) -> DataFrame:
    """(map_id, title, source) of each of files (path, content)."""
    return _each(files, lambda name, raw: [map_head(name, raw)], [pa.string()] * 2, "map_id string, title string, source string", lenient)


def map_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of all map files below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{opml,xmind}").load(path).select("path", "content")


def read(spark: SparkSession, path: str, lenient: bool = False, type_attribute: str = TYPE_ATTRIBUTE) -> DataFrame:
    """Nodes of all map files below a path."""
    return parse(map_files(spark, path), lenient, type_attribute)


class _Written:
    """A map file that is written node by node, in the order of the walk; only the open nodes are held, one a level."""

    def __init__(self, source: str | None = None):
        self.source, self.begun, self.open, self.parts = source, False, [], []  # of each open node [path, whether it has children]

    def add(self, path: tuple, node_id: str | None, title: str, kind: str, note: str | None) -> None:
        self._close(len(path))
        if self.open[-1][0] != path[:-1] if self.open else path or self.begun:
            raise ValueError(f"a node at {list(path)} has no parent, or the map a second root")
        if not self.begun:
            self._begin(title)
        self._node(path, node_id, title, kind, note)
        if self.open:
            self.open[-1][1] = True
        self.begun = True
        self.open.append([path, False])
        if len(self.parts) >= ROWS:
            self._flush()

    def _close(self, depth: int) -> None:
        while len(self.open) > depth:
            self._end(*self.open.pop())

    def _flush(self) -> None:
        self.out.write("".join(self.parts).encode("utf-8", self.errors))
        self.parts.clear()


class _Opml(_Written):
    errors = "xmlcharrefreplace"

    def _begin(self, title: str) -> None:
        self.out = io.BytesIO()
        element = lambda tag, text: f"    <{tag}>{escape(text)}</{tag}>\n" if text else f"    <{tag} />\n"
        owner = element("ownerName", self.source) if self.source else ""
        self.parts.append(f"<?xml version='1.0' encoding='utf-8'?>\n<opml version=\"2.0\">\n  <head>\n{element('title', title)}{owner}  </head>\n  <body>")

    def _node(self, path: tuple, _, title: str, kind: str, note: str | None) -> None:
        told = [("text", title)] + ([("_note", note)] if note else []) + ([(TYPE_ATTRIBUTE, kind)] if kind not in ("topic", "root") else [])
        above = ">" if self.open and not self.open[-1][1] else ""
        told = "".join(f' {k}="{escape(v, QUOTED)}"' for k, v in told)
        self.parts.append(f"{above}\n{'  ' * (len(path) + 2)}<outline{told}")

    def _end(self, path: tuple, parent: bool) -> None:
        self.parts.append(f"\n{'  ' * (len(path) + 2)}</outline>" if parent else " />")

    def close(self) -> bytes:
        self._close(0)
        self.parts.append("\n  </body>\n</opml>")
        self._flush()
        return self.out.getvalue()


class _Xmind(_Written):
    """links: (from_path, to_path, label) each; one with an end that no node has is not drawn."""

    errors = "strict"

    def __init__(self, source: str | None = None, links: list[tuple] = ()):
        super().__init__(source)
        self.links, self.ids = links, dict.fromkeys(path for x in links for path in x[:2])

    def _begin(self, title: str) -> None:
        self.file = io.BytesIO()
        self.zip = zipfile.ZipFile(self.file, "w", zipfile.ZIP_DEFLATED)
        self.out = self.zip.open("content.json", "w", force_zip64=True)  # how long it gets isn't known yet
        self.parts.append(f'[{{"id": "sheet", "title": {AS_JSON(title)}, "rootTopic": ')

    def _node(self, path: tuple, node_id: str | None, title: str, kind: str, note: str | None) -> None:
        node_id = node_id or "n" + "-".join(map(str, path))
        if path in self.ids:
            self.ids[path] = node_id
        topic = {"id": node_id, "title": title} | ({"notes": {"plain": {"content": note}}} if note else {})
        topic |= {"markers": [{"markerId": MARKERS[kind]}]} if kind in MARKERS else {}
        above = "" if not self.open else ", " if self.open[-1][1] else ', "children": {"attached": ['
        self.parts.append(above + AS_JSON(topic)[:-1])

    def _end(self, path: tuple, parent: bool) -> None:
        href = f', "href": {AS_JSON(self.source)}' if self.source and not path else ""
        self.parts.append(("]}" if parent else "") + href + "}")

    def close(self) -> bytes:
        self._close(0)
        first = True
        for i, (a, b, label) in enumerate(self.links):
            if self.ids[a] and self.ids[b]:
                self.parts.append((', "relationships": [' if first else ", ") + AS_JSON({"id": f"r{i}", "end1Id": self.ids[a], "end2Id": self.ids[b], "title": label or ""}))
                first = False
        self.parts.append("}]" if first else "]}]")
        self._flush()
        self.out.close()
        self.zip.writestr("metadata.json", "{}")
        self.zip.writestr("manifest.json", json.dumps({"file-entries": {"content.json": {}, "metadata.json": {}}}))
        self.zip.close()
        return self.file.getvalue()


def _filled(made: _Written, rows: list[dict]) -> bytes:
    for r in sorted(rows, key=lambda r: r["path"]):
        made.add(tuple(r["path"]), r.get("node_id"), r["title"], r["type"], r["note"])
    return made.close()


def to_opml(rows: list[dict], source: str | None = None) -> bytes:
    return _filled(_Opml(source), rows)


def to_xmind(rows: list[dict], links: list[dict] = (), source: str | None = None) -> bytes:
    """links: (from_path, to_path, label); the root topic points at source."""
    return _filled(_Xmind(source, [(tuple(x["from_path"]), tuple(x["to_path"]), x["label"]) for x in links]), rows)


def xmind_links(raw: bytes) -> list[tuple]:
    """(from_id, to_id, label) of the relationships of the first sheet that have both ends."""
    drawn = (found[0] for what, *found in _xmind(raw) if what == "link")
    return [(r["end1Id"], r["end2Id"], r.get("title") or "") for r in drawn if r.get("end1Id") and r.get("end2Id")]


def parse_links(files: DataFrame, lenient: bool = False) -> DataFrame:
    """(map_id, seq, from_id, to_id, label) of XMind files (path, content); OPML has none."""
    some = files.filter(F.lower("path").endswith(".xmind"))
    kinds = [pa.int32(), pa.string(), pa.string(), pa.string()]
    return _each(some, lambda _, raw: ((i, *x) for i, x in enumerate(xmind_links(raw))), kinds, "map_id string, seq int, from_id string, to_id string, label string", lenient)


def source_href(source: Column, is_file: Column) -> Column:
    """What a root topic points at: a URL as it is, a file (is_file says which) as a file: address, else nothing."""
    absolute = F.concat(F.when(source.startswith("/"), F.lit("file://")).otherwise("file:///"), F.regexp_replace(source, " ", "%20"))
    return F.when(source.rlike("^(?i)(https?|file)://"), source).when(is_file, absolute)


def render(nodes: DataFrame, form: str = "opml", links: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """(map_id, content: bytes) of each map; XMind also has links (map_id, seq, a_path, b_path, label) and sources (map_id, source).

    A map's rows come sorted to one task, which writes them as they come: it holds a map's file and links, not its nodes.
    """
    if form not in ("opml", "xmind"):
        raise ValueError("maps are written as opml or xmind")
    of = nodes.schema["map_id"].dataType.simpleString()
    kinds = {"part": "int", "seq": "bigint", "path": "array<int>", "b_path": "array<int>", "node_id": "string", "title": "string", "type": "string", "note": "string"}

    def part(df: DataFrame, number: int, **given) -> DataFrame:
        given["part"] = F.lit(number)
        return df.select(F.col("map_id").cast(of).alias("map_id"), *[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])

    own = {c: F.col(c) for c in ("path", "node_id", "title", "type", "note") if c in nodes.columns}
    rows = part(nodes, 2, **own)
    if links is not None and form == "xmind":
        rows = rows.unionByName(part(links, 1, seq=F.col("seq"), path=F.col("a_path"), b_path=F.col("b_path"), title=F.col("label")))
    if sources is not None:
        rows = rows.unionByName(part(sources.filter("source is not null"), 0, title=F.col("source")))
    rows = rows.repartition("map_id").sortWithinPartitions("map_id", *kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, at, source, drawn, begun = None, None, None, [], False

        def file() -> Iterator[pa.RecordBatch]:
            nonlocal made
            if made:
                content, made = made.close(), None
                yield pa.RecordBatch.from_arrays([pa.array([at], kind), pa.array([content], pa.binary())], ["map_id", "content"])

        for batch in batches:
            kind = batch.column(0).type
            for start in range(0, batch.num_rows, ROWS):
                for key, number, _, path, to, node_id, title, sort, note in zip(*[c.to_pylist() for c in batch.slice(start, ROWS).columns], strict=True):
                    if not begun or key != at:
                        yield from file()
                        at, source, drawn, begun = key, None, [], True
                    if number == 0:
                        if source not in (None, title):
                            raise ValueError(f"map {key} has two sources")
                        source = title
                    elif number == 1:
                        drawn.append((tuple(path), tuple(to), title))
                    else:
                        made = made or (_Opml(source) if form == "opml" else _Xmind(source, drawn))
                        made.add(tuple(path), node_id, title, sort, note)
        yield from file()

    return rows.mapInArrow(run, f"map_id {of}, content binary")
