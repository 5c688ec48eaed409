"""Web pages as nodes: elements and the texts between them, in reading order, like the nodes of packages.

Pages needn't be well-formed. A paragraph ends where a block begins, an item where the next one of its list does, a cell
where the next cell or row does, and an end tag of an inline element never ends a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.package import by_document, with_above

NODES = "doc_id string, part string, node_id long, end_id long, parent_id long, depth int, tag string, attrs map<string, string>, path string, text string, above_ids array<long>, above_tags array<string>"
#: Elements without content, and elements that end an open paragraph.
EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: Elements that end another one of these when they begin, up to the element that holds them.
ENDED = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr", "td", "th"), ("table",)), "option": (("option",), ("select", "datalist"))}
#: Elements that hold others, which end tags of inline elements don't close.
HOLDERS = BLOCKS | frozenset("html head body li dt dd td th tr thead tbody tfoot caption".split())
#: A text between elements.
TEXT = "#text"
#: Elements whose text is nobody's to read.
HIDDEN = ("head", "title", "script", "style", "template", "noscript")


class PageReader(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.rows: list[dict] = []
        self.open: list[int] = []
        self.seen: list[dict[str, int]] = [{}]

    def add(self, tag: str, attrs=(), text: str | None = None) -> None:
        names = self.seen[-1]
        names[tag] = names.get(tag, 0) + 1
        path = self.rows[self.open[-1]]["path"] if self.open else ""
        self.rows.append({
            "node_id": len(self.rows), "end_id": len(self.rows), "parent_id": self.open[-1] if self.open else None, "depth": len(self.open), "tag": tag, "attrs": list({k: v for k, v in attrs if v is not None}.items()), "path": f"{path}/{tag}[{names[tag]}]", "text": text,
            "above_ids": self.open[:], "above_tags": [self.rows[i]["tag"] for i in self.open],
        })

    def close_from(self, place: int) -> None:
        for i in self.open[place:]:
            self.rows[i]["end_id"] = len(self.rows) - 1
        del self.open[place:]
        del self.seen[place + 1 :]

    def end_open(self, tags: tuple[str, ...], holders: frozenset | tuple) -> None:
        """Ends the outermost open element of the tags that no holder stands above."""
        found = None
        for place in range(len(self.open) - 1, -1, -1):
            tag = self.rows[self.open[place]]["tag"]
            if tag in tags:
                found = place
            elif tag in holders:
                break
        if found is not None:
            self.close_from(found)

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in BLOCKS:
            self.end_open(("p",), ("table", "td", "th", "button"))
        if tag in ENDED:
            self.end_open(*ENDED[tag])
        self.add(tag, attrs)
        if tag not in EMPTY:
            self.open.append(len(self.rows) - 1)
            self.seen.append({})

    def handle_endtag(self, tag: str) -> None:
        for place in range(len(self.open) - 1, -1, -1):
            own = self.rows[self.open[place]]["tag"]
            if own == tag:
                self.close_from(place)
                return
            if tag not in HOLDERS and own in HOLDERS:
                return

    def handle_data(self, data: str) -> None:
        self.add(TEXT, text=data)


def page_rows(doc_id: str, html: str) -> Iterator[dict]:
    reader = PageReader()
    reader.feed(html)
    reader.close()
    reader.close_from(0)
    for row in reader.rows:
        yield {"doc_id": doc_id, "part": "html"} | row


def page_nodes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Elements and texts (`#text`) of each page. A null page has no nodes."""
    rows = pages.where(F.col(html).isNotNull()).select(F.col(key).alias("doc_id"), F.col(html).cast("binary").alias("content"))
    return with_above(by_document(rows, lambda doc_id, content: page_rows(doc_id, content.decode("utf-8", "replace")), NODES))
