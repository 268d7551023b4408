"""Articles in HTML and XML to markdown with pipe tables; one function call a document, over Arrow batches.

External tables of an article are kept in a registry by their ids and numbers. A table is put in after the first block that refers to it;
tables without a reference follow at the end under a heading of their own.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SKIPPED = set("aside footer header nav script style".split())
HEADINGS = {f"h{i}": i for i in range(1, 7)}
CLOSERS = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}


def squeeze(text: str | None) -> str:
    return " ".join((text or "").split())


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []

    def walk(self, skip: frozenset = frozenset()) -> Iterator[Node]:
        """All elements below, in order; however deep, without recursion."""
        for child in self.content(skip):
            if isinstance(child, Node):
                yield child

    def content(self, skip: frozenset = frozenset()) -> Iterator[Node | str]:
        """All elements and strings below, in order."""
        open_ = [iter(self.children)]
        while open_:
            for child in open_[-1]:
                if isinstance(child, str):
                    yield child
                elif child.tag not in skip:
                    yield child
                    open_.append(iter(child.children))
                    break
            else:
                open_.pop()

    def text(self, skip: frozenset = frozenset()) -> str:
        return " ".join(c for c in self.content(skip) if isinstance(c, str))

    def find(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if n.tag in tags), None)

    def own(self, *tags: str) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node) and c.tag in tags]


class _TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("root")
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        while self.stack[-1].tag in CLOSERS.get(tag, ()):
            self.stack.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_endtag(self, tag):
        if any(n.tag == tag for n in self.stack[1:]):
            while self.stack.pop().tag != tag:
                pass

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def html_tree(html: str) -> Node:
    builder = _TreeBuilder()
    builder.feed(html)
    builder.close()
    return builder.root


def xml_tree(data: str) -> Node | None:
    """The tree with local, lower-case names; None where the text is no XML."""
    try:
        root = ET.fromstring(data)
    except ET.ParseError:
        return None

    made = lambda e: Node(str(e.tag).rpartition("}")[2].lower(), {k.rpartition("}")[2].lower(): v for k, v in e.attrib.items()})
    top = made(root)
    waiting = [(root, top)]
    while waiting:
        element, node = waiting.pop()
        if element.text:
            node.children.append(element.text)
        for child in element:
            if isinstance(child.tag, str):
                node.children.append(made(child))
                waiting.append((child, node.children[-1]))
            if child.tail:
                node.children.append(child.tail)
    return top


# tables


def markdown_table(header: list[str], rows: list[list[str]]) -> str:
    width = max([len(header), *map(len, rows)], default=0)
    if not width:
        return ""
    pad = lambda cells: [*cells, *[""] * (width - len(cells))]
    line = lambda cells: "| " + " | ".join(c.replace("|", "\\|") for c in pad(cells)) + " |"
    return "\n".join([line(header), "| " + " | ".join(["---"] * width) + " |", *map(line, rows)])


def merged_header(rows: list[list[str]]) -> list[str]:
    """One header of several header rows: a column's distinct texts, or its number."""
    width = max(map(len, rows), default=0)
    columns = [[r[i] for r in rows if i < len(r) and r[i]] for i in range(width)]
    return [" / ".join(dict.fromkeys(texts)) or f"Column {i}" for i, texts in enumerate(columns, 1)]


def grid(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """Cells (text, column span, row span) laid out; spanned cells repeat their text."""
    carried: dict[tuple[int, int], str] = {}
    out = []
    for r, cells in enumerate(rows):
        line, c = [], 0
        for text, wide, high in cells:
            while (r, c) in carried:
                line.append(carried.pop((r, c)))
                c += 1
            for _ in range(wide):
                line.append(text)
                carried.update({(r + k, c): text for k in range(1, high)})
                c += 1
        while (r, c) in carried:
            line.append(carried.pop((r, c)))
            c += 1
        out.append(line)
    return out


def _number(value: str | None) -> int:
    return max(1, int(value)) if value and value.strip().isdigit() else 1


def html_table(table: Node) -> str:
    """A table with its thead, or its first row, as header."""
    def rows(parts: list[Node]) -> list[list[tuple[str, int, int]]]:
        found = [tr for part in parts for tr in ([part] if part.tag == "tr" else part.own("tr"))]
        return [[(squeeze(c.text()), _number(c.attrs.get("colspan")), _number(c.attrs.get("rowspan"))) for c in tr.own("td", "th")] for tr in found]

    head = grid(rows(table.own("thead")))
    body = grid(rows(table.own("tbody", "tfoot", "tr")))
    if not head and body:
        head, body = body[:1], body[1:]
    return markdown_table(merged_header(head), body)


def cals_table(table: Node) -> str:
    """A CALS table: column names, spans by names and morerows."""
    group = table.find("tgroup") or table
    names = {spec.attrs.get("colname", str(i)): i for i, spec in enumerate(group.own("colspec"))}

    def rows(part: str) -> list[list[tuple[str, int, int]]]:
        out = []
        for section in group.own(part):
            for row in section.own("row"):
                cells = []
                for entry in row.own("entry"):
                    first, last = names.get(entry.attrs.get("namest", "")), names.get(entry.attrs.get("nameend", ""))
                    wide = last - first + 1 if first is not None and last is not None and last >= first else 1
                    more = entry.attrs.get("morerows", "")
                    cells.append((squeeze(entry.text()), wide, 1 + (int(more) if more.isdigit() else 0)))
                out.append(cells)
        return out

    head, body = grid(rows("thead")), grid(rows("tbody"))
    if not head and body:
        head, body = body[:1], body[1:]
    return markdown_table(merged_header(head), body)


def any_table(node: Node) -> str:
    """Label, caption and rows of a table element of any of the dialects."""
    title = [squeeze(part.text()) for name in ("label", "caption") if (part := node.find(name)) is not None]
    inner = node if node.own("thead", "tbody", "tr") else node.find("table") or node
    rows = cals_table(inner) if inner.find("tgroup") is not None or inner.tag == "tgroup" else html_table(inner)
    return "\n\n".join(x for x in [" ".join(t for t in title if t), rows] if x)


def plain_ref(ref: str) -> str:
    return "".join(re.findall("[a-z0-9]+", ref.lower()))


class Tables:
    """Tables of a document by alias; each is given out once."""

    def __init__(self):
        self.tables: list[str] = []
        self.by_alias: dict[str, int] = {}
        self.used: set[int] = set()

    def add(self, key: str, markdown: str, *aliases: str) -> None:
        if not markdown:
            return
        self.tables.append(markdown)
        number = re.search(r"(?i)(?:table|tab|tbl|t)?\D{0,3}(\d+)\D*$", key)
        names = [key, *aliases, *([f"table {number.group(1)}", number.group(1)] if number else [])]
        self.by_alias.update({plain_ref(n): len(self.tables) - 1 for n in names if plain_ref(n)})

    def take(self, ref: str) -> str | None:
        at = self.by_alias.get(plain_ref(ref))
        if at is None or at in self.used:
            return None
        self.used.add(at)
        return self.tables[at]

    def rest(self) -> list[str]:
        return [t for i, t in enumerate(self.tables) if i not in self.used]


def tables_of(name: str, data: str) -> list[tuple[str, str]]:
    """(key, markdown) of all tables of a file."""
    stem = re.sub(r"\.[^.]*$", "", name.rpartition("/")[2])
    tree = html_tree(data) if name.lower().endswith((".html", ".htm")) else xml_tree(data)
    if tree is None:
        return []
    wraps = [n for n in tree.walk() if n.tag in {"table-wrap", "ce:table"}] or [n for n in tree.walk(frozenset()) if n.tag == "table"]
    if tree.tag == "table" and not wraps:
        wraps = [tree]
    keyed = []
    for i, node in enumerate(wraps):
        key = node.attrs.get("id") or (stem if len(wraps) == 1 else f"{stem}-{i + 1}")
        keyed.append((key, any_table(node)))
    return keyed


def _html_refs(node: Node) -> list[str]:
    links = [n.attrs.get("href", "") for n in node.walk() if n.tag == "a"]
    found = [x for href in links for x in ([href.partition("#")[2]] if "#" in href else []) + re.findall(r"(?i)table\D{0,3}\d+", href)]
    return list(dict.fromkeys(found or re.findall(r"(?i)\btable\s+\d+", node.text())))


def html_markdown(html: str, tables: Tables | None = None) -> list[str]:
    """Blocks of the article: headings, paragraphs, items, tables, captions."""
    tree, tables = html_tree(html), tables or Tables()
    marked = next((n for n in tree.walk() if n.attrs.get("data-article-body") == "true"), None)
    body = marked or tree.find("article") or tree.find("main") or tree.find("body") or tree
    skip, blocks = frozenset(SKIPPED), []

    open_ = [iter(body.children)]
    while open_:
        for child in open_[-1]:
            if isinstance(child, str) or child.tag in skip:
                continue
            text = squeeze(child.text(skip)) if child.tag in HEADINGS or child.tag in {"p", "li", "figcaption", "caption"} else ""
            if child.tag == "table":
                blocks.append(html_table(child))
            elif text:
                lead = "#" * HEADINGS[child.tag] + " " if child.tag in HEADINGS else "- " if child.tag == "li" else ""
                blocks.append(lead + text)
            if text:
                blocks.extend(t for ref in _html_refs(child) if (t := tables.take(ref)))
            if child.tag != "table" and child.tag not in HEADINGS:
                open_.append(iter(child.children))
                break
        else:
            open_.pop()
    return [b for b in blocks if b]


def xml_markdown(data: str, tables: Tables | None = None) -> list[str]:
    """Blocks of an article in either publisher's XML; the plain text of any other."""
    tree, tables = xml_tree(data), tables or Tables()
    if tree is None:
        return [squeeze(data)] if squeeze(data) else []
    if tree.tag not in {"article", "full-text-retrieval-response"}:
        return [squeeze(tree.text())] if squeeze(tree.text()) else []
    sections, titles = ("section", "sec"), ("section-title", "title")
    inner = frozenset({"table-wrap", "table"})
    blocks: list[str] = []
    abstract = tree.find("abstract")
    if abstract is not None and squeeze(abstract.text()):
        blocks += ["## Abstract", squeeze(abstract.text())]

    def refs(node: Node) -> list[str]:
        found = [n.attrs.get("rid") or n.attrs.get("refid") or "" for n in node.walk() if n.tag in {"xref", "cross-ref", "float-anchor"} and n.attrs.get("ref-type", "table") == "table"]
        return list(dict.fromkeys(x for f in found for x in f.split()))

    body = tree.find("body")
    open_ = [(iter(body.children), 2)] if body is not None else []
    while open_:
        inside, level = open_[-1]
        for child in inside:
            if isinstance(child, str):
                continue
            if child.tag in sections:
                heading = next((squeeze(t.text()) for t in child.own(*titles)), "")
                if heading:
                    blocks.append("#" * min(level, 6) + " " + heading)
                open_.append((iter(child.children), level + 1))
                break
            if child.tag == "sections":
                open_.append((iter(child.children), level))
                break
            if child.tag in {"p", "para", "simple-para"}:
                if text := squeeze(child.text(inner)):
                    blocks.append(text)
                blocks.extend(any_table(n) for n in child.walk() if n.tag == "table-wrap")
                blocks.extend(t for ref in refs(child) if (t := tables.take(ref)))
            elif child.tag in inner:
                blocks.append(any_table(child))
        else:
            open_.pop()
    return [b for b in blocks if b]


def article_markdown(name: str, data: str, table_files: list[tuple[str, str]] = ()) -> str:
    """Markdown of one article and its external table files (name, content)."""
    tables = Tables()
    for table_name, content in sorted(table_files):
        for key, markdown in tables_of(table_name, content):
            tables.add(key, markdown, table_name.rpartition("/")[2].partition(".")[0])
    suffix = name.lower().rpartition(".")[2]
    if suffix in {"html", "htm"}:
        blocks = html_markdown(data, tables)
    elif suffix == "xml":
        blocks = xml_markdown(data, tables)
    else:
        raise ValueError(f"no reader for {name}")
    if rest := tables.rest():
        blocks += ["## Tables (unreferenced)", *rest]
    return "\n\n".join(blocks)


def markdown_of(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id and markdown of a table of raw pages."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({id_col: frame[id_col], "markdown": ["\n\n".join(html_markdown(h or "")) for h in frame[html_col]]})

    return pages.select(id_col, html_col).mapInPandas(run, f"{id_col} {kind}, markdown string")
