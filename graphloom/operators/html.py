"""Page HTML to components: a table function over a lenient tree of the markup.

Sections hold headings (h2-h6), paragraphs, tables, figures and lists; containers in between are
looked through. The parser gives these elements only; paths of headings, which go on over sections, and the closing headings
such as "References", which end theirs, are a fold over a page's elements in the JVM. A page that can't be read gives an error row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import FILE_PATH
from ..tables import give_back, small_batches

# Tags and headings of the page format.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
KEPT = {"p", "table", "figure", "ul", "ol", "h2", "h3", "h4", "h5", "h6"}
CONTAINERS = {"div", "section", "center"}
CLOSING = ["references", "see also", "external links", "notes", "further reading", "sources"]
BOXES = {"ambox", "mbox", "cmbox", "metadata"}
_IMPLIED_END = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Characters of markup whose elements are handed on together.
PIECE = 1 << 20
_BLOCKS = KEPT | CONTAINERS | {"article", "nav", "footer", "h1"}

class Node:
    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs or {}, parent, []

    @property
    def classes(self) -> set[str]:
        return set(self.attrs.get("class", "").split())

    def find_all(self, *tags: str) -> Iterator[Node]:
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            if n.tag in tags:
                yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]


class Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("root")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        ends = _IMPLIED_END.get(tag, set()) | ({"p"} if tag in _BLOCKS else set())
        if ends and self.at.tag in ends | {"b", "i", "a", "span"}:
            n = self.at
            while n.parent and n.tag in {"b", "i", "a", "span"}:  # unclosed inline tags end with their block
                n = n.parent
            if n.tag in ends and n.parent:
                self.at = n.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n.parent and n.tag != tag:
            n = n.parent
        if n.parent:
            self.at = n.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Node:
    tree = Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def raw_text(node: Node | str) -> str:
    """All text of a node as it stands, images as their links."""
    if isinstance(node, str):
        return node
    if node.tag == "img":
        return f"[[{url}]]" if (url := image_url(node)) else ""
    return "".join(map(raw_text, node.children))


def wiki_link(node: Node) -> str | None:
    """The page that a link names: `rel` has mw:WikiLink, or href begins with ./; files and special pages are none."""
    href = node.attrs.get("href", "")
    if not (href.startswith("./") or "mw:WikiLink" in node.attrs.get("rel", "").split()) or "File:" in href or "Special:" in href:
        return None
    return unquote(href.replace("./", "").replace("/wiki/", "")).split("?")[0]


def _file(name: str) -> str:
    return FILE_PATH + unquote(name.replace("./File:", "").replace("File:", ""))


def image_url(node: Node) -> str | None:
    """Where the original file of an image is; an address outside the upload server as it stands."""
    if node.attrs.get("resource"):
        return _file(node.attrs["resource"])
    src = node.attrs.get("src", "").strip()
    src = "https:" + src if src.startswith("//") else src
    if "upload.wikimedia.org" not in src:
        return src or None
    parts = src.split("/")
    return FILE_PATH + unquote(parts[-2] if "/thumb/" in src else parts[-1])


def text_of(node: Node, edges: list[str]) -> str:
    """Text joined by spaces and collapsed; references and links without text are dropped, the others' pages
    noted, images written as [[url]]."""
    out: list[str] = []
    stack: list = [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
            continue
        if n.tag in ("style", "script") or n.tag in ("sup", "span") and "reference" in n.classes:
            continue
        if n.tag == "a":
            label = raw_text(n).strip()
            if not label:
                continue
            if (title := wiki_link(n)) is not None:
                edges.append(title)
                out.append(label)
                continue
        if n.tag == "img":
            out.append(raw_text(n))
        stack += reversed(n.children)
    return " ".join(" ".join(out).split())


def _list_parts(node: Node | str, edges: list[str]) -> list[str]:
    if isinstance(node, str) or node.tag in ("img", "a"):
        if not isinstance(node, str) and node.tag == "a":
            href = node.attrs.get("href", "")
            if href.startswith("/wiki/") and ":" not in href:
                edges.append(href.replace("/wiki/", "").replace("_", " "))
        words = raw_text(node).split()
        return [" ".join(words)] if words else []
    if node.tag in ("sup", "style", "script"):
        return []
    parts = [p for c in node.children for p in _list_parts(c, edges)]
    return ["- " + " ".join(parts).strip() + "\n"] if node.tag == "li" else parts


def list_text(node: Node, edges: list[str]) -> str:
    """A list with an item a line; an item holds the items of its own lists on its line or the next ones."""
    return re.sub(r" ?\n ?", "\n", " ".join(_list_parts(node, edges))).strip()


def table_rows(node: Node, edges: list[str]) -> list[list[str]]:
    """Direct rows of the first tbody (of the table itself without one), direct cells."""
    body = next(node.find_all("tbody"), node)
    rows = [[text_of(c, edges) for c in tr.children if isinstance(c, Node) and c.tag in ("td", "th")] for tr in body.children if isinstance(tr, Node) and tr.tag == "tr"]
    return [r for r in rows if r]


def flattened(node: Node) -> Iterator[Node]:
    for c in node.children:
        if isinstance(c, Node):
            if c.tag in KEPT:
                yield c
            elif c.tag in CONTAINERS:
                yield from flattened(c)


def sections(root: Node, fallback: tuple[str, ...] = ("article",)) -> list[Node]:
    """Sections directly under body, else under #mw-content-text, else the fallback tags."""
    body = next(root.find_all("body"), root)
    for holder in (body, *(n for n in body.find_all("div") if n.attrs.get("id") == "mw-content-text")):
        found = [c for c in holder.children if isinstance(c, Node) and c.tag == "section"]
        if found:
            return found
    return list(body.find_all(*fallback))


def plain_text(node: Node | str) -> str:
    """All text of a node as it stands, scripts and styles left out."""
    if isinstance(node, str):
        return node
    return "".join(plain_text(c) for c in node.children if isinstance(c, str) or c.tag not in ("style", "script"))


def elements(html: str) -> Iterator[dict]:
    """The headings (`level`, `title`) and components of a page in their order, each with the number of its section."""
    for number, section in enumerate(sections(parse(html))):
        if "shortdescription" in section.classes:
            continue
        for e in flattened(section):
            edges: list[str] = []
            made: dict = {}
            if e.tag[0] == "h":
                yield {"section": number, "level": int(e.tag[1]), "title": plain_text(e).strip()}
            elif e.tag == "p":
                made = {"type": "paragraph", "paragraph": text_of(e, edges)}
            elif e.tag in ("ul", "ol"):
                made = {"type": "paragraph", "paragraph": list_text(e, edges)}
            elif e.tag == "table" and not e.classes & BOXES:
                made = {"type": "table", "table": table_rows(e, edges)}
            elif e.tag == "figure":
                link, cap = next(e.find_all("a"), None), next(e.find_all("figcaption"), None)
                href = link.attrs.get("href", "") if link else ""
                made = {"type": "image", "src": _file(href), "caption": text_of(cap, edges) if cap else ""} if href else {}
            if made and (made["type"] != "paragraph" or made["paragraph"].strip()):
                yield {**made, "section": number, "edge": list(dict.fromkeys(edges))}


def heading_paths(elements_: Column) -> Column:
    """Of elements (`section`, `level`, `title`; a heading has a level from 2 on), an array of (`at`, `heading_path`) with the places of those that
    are no headings. A heading of level n follows the first n - 2 titles of the path; levels that are left out aren't filled, and
    the path goes on over sections. A closing heading ends its section: all behind it in the section is left out, and so is
    the heading itself."""
    closing = "(?i)" + "|".join(re.escape(c) for c in CLOSING)

    def step(acc: Column, e: Column) -> Column:
        heading, out_of = e["level"].isNotNull(), acc["closed"] == e["section"]
        ends = heading & F.regexp_like(F.coalesce(e["title"], F.lit("")), F.lit(closing))
        longer = F.concat(F.slice(acc["path"], F.lit(1), F.greatest(e["level"] - 2, F.lit(0))), F.array(e["title"]))
        found = F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), acc["path"].alias("heading_path"))))
        return F.struct(
            F.when(heading & ~ends & ~out_of, longer).otherwise(acc["path"]).alias("path"),
            F.when(ends & ~out_of, e["section"]).otherwise(acc["closed"]).alias("closed"),
            (acc["at"] + 1).alias("at"),
            F.when(~heading & ~out_of, found).otherwise(acc["out"]).alias("out"),
        )

    none = F.array().cast("array<struct<at: int, heading_path: array<string>>>")
    zero = F.struct(F.array().cast("array<string>").alias("path"), F.lit(-1).alias("closed"), F.lit(0).alias("at"), none.alias("out"))
    return F.aggregate(elements_, zero, step, lambda acc: acc["out"])


ELEMENT = "section int, level int, title string, type string, edge array<string>, paragraph string, src string, caption string, table array<array<string>>"


def page_elements(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(`page_id`, `elements`, `error`): one row per page. Pages come in small batches, and their elements leave after
    each `PIECE` characters of markup, so a task holds one piece's elements, whatever the number of pages."""
    small_batches(pages.sparkSession)
    names = [c.split()[0] for c in re.sub(r"<[^>]*>+", "", ELEMENT).split(", ")]

    def made(out: list[tuple], pdf: pd.DataFrame) -> pd.DataFrame:
        some = pd.DataFrame(out, columns=["page_id", "elements", "error"])
        some["page_id"] = some["page_id"].astype(pdf["page_id"].dtype)
        return some

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, size = [], 0
            for page, html in zip(pdf["page_id"], pdf["html"]):
                try:
                    out.append((page, [{n: e.get(n) for n in names} for e in elements(html or "")], None))
                except Exception as e:  # noqa: BLE001  one bad page must not end the batch
                    out.append((page, None, f"{type(e).__name__}: {e}"))
                size += len(html or "")
                if size >= PIECE:
                    yield made(out, pdf)
                    out, size = [], 0
            if out:
                yield made(out, pdf)
        give_back()

    kind = "string" if dict(pages.dtypes)[id_col] == "string" else "long"
    fields = ", ".join(f"{a}: {b}" for a, b in (f.split(" ", 1) for f in ELEMENT.split(", ")))
    return pages.select(F.col(id_col).cast(kind).alias("page_id"), F.col(html_col).alias("html")).mapInPandas(rows, f"page_id {kind}, elements array<struct<{fields}>>, error string")


def page_components(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per component; a page without any, or one that can't be read, is a row with `error`."""
    found = page_elements(pages, id_col, html_col).withColumn("_p", heading_paths(F.col("elements")))
    one = found.select("page_id", "elements", "error", F.posexplode_outer("_p").alias("idx", "_c"))
    e = F.get("elements", F.col("_c.at"))
    fields = {c: e[c].alias(c) for c in ("type", "edge", "paragraph", "src", "caption", "table")}
    error = F.when(F.col("idx").isNull(), F.coalesce("error", F.lit("no components")))
    return one.select(
        "page_id", "idx", fields["type"], F.col("_c.heading_path").alias("heading_path"), *(fields[c] for c in ("edge", "paragraph", "src", "caption", "table")), error.alias("error")
    )


def page_links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(`page_id`, `pos`, `href`) of all links, from the markup itself and in the JVM."""
    hrefs = F.regexp_extract_all(F.col(html_col), F.lit(r"(?i)<a\s[^>]*?href=[\"']([^\"']*)[\"']"), F.lit(1))
    return pages.select(F.col(id_col).alias("page_id"), F.posexplode(hrefs).alias("pos", "href"))
