"""HTML and Markdown as items with structure: a stack of open blocks over tags, or over lines.

Every visible text is in exactly one item. Lists and tables are items themselves and parents of their items and cells; a list
within a list item is a child of that item; what stands under a heading names it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What the text of a block tag is; tags in neither table are inline, and do not end a text.
BLOCKS = {
    "title": "title", "h1": "section_header", "h2": "section_header", "h3": "section_header", "h4": "section_header", "h5": "section_header", "h6": "section_header", "li": "list_item", "dt": "text", "dd": "list_item",
    "pre": "code", "td": "table_cell", "th": "table_cell", "figcaption": "caption", "caption": "caption", "p": "text", "div": "text", "blockquote": "text", "address": "text", "article": "text", "section": "text",
    "main": "text", "aside": "text", "header": "text", "footer": "text", "nav": "text", "body": "text", "html": "text", "head": "text", "form": "text", "fieldset": "text", "figure": "text", "details": "text",
    "summary": "text", "tr": "text", "thead": "text", "tbody": "text", "tfoot": "text", "option": "text", "button": "text",
}
GROUPS = {"ul": "list", "ol": "ordered_list", "dl": "list", "table": "table"}
#: Tags whose content is not shown, and tags that have none.
HIDDEN, VOID = ("script", "style", "template", "noscript"), ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
#: An open block of the first kind ends where one of the second begins, unless one of the third lies between.
ENDS = {
    "p": (("p", "div", "ul", "ol", "dl", "table", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "article", "section", "nav", "aside", "header", "footer", "main", "form", "figure", "hr", "li", "address"), ("td", "th", "button")),
    "li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "tbody", "tfoot"), ("table",)), "td": (("td", "th", "tr", "tbody", "tfoot"), ("table",)),
    "th": (("td", "th", "tr", "tbody", "tfoot"), ("table",)), "option": (("option",), ("select",)),
}
FIELDS = ("ord", "parent", "heading", "type", "level", "layer", "row", "col", "row_span", "col_span", "text")
SCHEMA = "ord int, parent int, heading int, type string, level int, layer string, row int, col int, row_span int, col_span int, text string"


class Builder:
    """Items in order; ``parent`` and ``heading`` are positions of other items or None."""

    def __init__(self) -> None:
        self.items: list[dict] = []
        self.headings: list[tuple[int, int]] = []  # level and position of the headings that are open

    def add(self, kind: str, text: str = "", parent: int | None = None, level: int | None = None, layer: str = "body", **where: int) -> int:
        own = len(self.items)
        if kind in ("section_header", "title"):
            level = level or 0
            self.headings = [h for h in self.headings if h[0] < level]
        heading = self.headings[-1][1] if self.headings and parent is None else None
        if kind in ("section_header", "title") and parent is None:
            self.headings.append((level, own))
        self.items.append({"ord": own, "parent": parent, "heading": heading, "type": kind, "level": level, "layer": layer, "text": text} | where)
        return own


class HtmlItems(HTMLParser):
    """One pass over the tags. ``open`` is the stack: tag, item of a group or list item (or None), and a table's place."""

    def __init__(self, markup: str):
        super().__init__(convert_charrefs=True)
        self.out, self.open, self.held, self.hidden = Builder(), [], [], []
        self.feed(markup)
        self.close()
        self._flush()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in HIDDEN:
            self.hidden.append(tag)
        if self.hidden:
            return
        for own in list(reversed(self.open)):
            ends, walls = ENDS.get(own["tag"], ((), ()))
            if tag in ends and not any(o["tag"] in walls for o in self.open[self.open.index(own) + 1 :]):
                self._end(self.open.index(own))
                break
        if tag == "img":
            self._flush()
            self.out.add("picture", (dict(attrs).get("alt") or "").strip(), self._parent(), layer=self._layer())
        elif tag == "br":
            self.held.append("\n")
        elif tag in BLOCKS or tag in GROUPS:
            self._flush()
            own = {"tag": tag, "item": None}
            if tag in GROUPS:
                own["item"] = self.out.add(GROUPS[tag], "", self._parent(), layer=self._layer())
                own |= {"row": -1, "col": 0, "taken": {}}
            elif tag == "tr" and (table := self._inner("table")):
                table["row"], table["col"] = table["row"] + 1, 0
            elif tag in ("td", "th") and (table := self._inner("table")):
                spans = [int(x) if (x := dict(attrs).get(k) or "").isdigit() and 0 < int(x) < 1000 else 1 for k in ("rowspan", "colspan")]
                table["row"] = max(table["row"], 0)
                while (table["row"], table["col"]) in table["taken"]:
                    table["col"] += 1
                own["cell"] = {"row": table["row"], "col": table["col"], "row_span": spans[0], "col_span": spans[1]}
                table["taken"] |= {(table["row"] + r, table["col"] + c): True for r in range(spans[0]) for c in range(spans[1])}
                table["col"] += spans[1]
            self.open.append(own)

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            if tag == self.hidden[-1]:
                self.hidden.pop()
            return
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at]["tag"] == tag:
                self._end(at)
                return

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.held.append(data)

    def _end(self, at: int) -> None:
        """Close the block at this place of the stack and all within it, the innermost first."""
        while len(self.open) > at:
            self._flush()
            own = self.open.pop()
            if "cell" in own and own["item"] is None:
                self._cell(own, "")

    def _inner(self, *tags: str) -> dict | None:
        return next((o for o in reversed(self.open) if o["tag"] in tags), None)

    def _parent(self) -> int | None:
        return next((o["item"] for o in reversed(self.open) if o["item"] is not None), None)

    def _layer(self) -> str:
        return "furniture" if self._inner("nav", "footer", "header") else "body"

    def _cell(self, own: dict, text: str) -> None:
        table = next((o["item"] for o in reversed(self.open[: self.open.index(own)] if own in self.open else self.open) if o["tag"] == "table"), None)
        own["item"] = self.out.add("table_cell", text, table, layer=self._layer(), **own["cell"])

    def _flush(self) -> None:
        """What has been read since the last block began or ended is a text of the innermost block."""
        whole = "".join(self.held)
        self.held = []
        block = next((o for o in reversed(self.open) if o["tag"] in BLOCKS and BLOCKS[o["tag"]] != "text"), None)
        inner = self.open[-1] if self.open else None
        pre = self._inner("pre") is not None
        text = whole.strip("\n") if pre else re.sub(r"\s+", " ", whole).strip()
        if not text.strip():
            return
        kind = "text" if block is None else BLOCKS[block["tag"]]
        if block is not None and kind in ("list_item", "table_cell") and block["item"] is not None:
            self.out.add("code" if pre else "text", text, block["item"], layer=self._layer())  # more text of an item that has begun
        elif kind == "table_cell" and "cell" in block:
            self._cell(block, text)
        elif kind == "list_item":
            block["item"] = self.out.add("list_item", text, self._parent(), layer=self._layer())
        elif kind in ("section_header", "title"):
            self.out.add(kind, text, self._parent(), int(block["tag"][1]) if kind == "section_header" else 0, self._layer())
        else:
            self.out.add("code" if pre else "text" if inner is None else kind, text, self._parent(), layer=self._layer())


_LIST = re.compile(r"(\s*)([-*+•]|\d{1,9}[.)])(\s+)(.*)$")
_ROW_RULE = re.compile(r"\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")


def markdown_items(text: str) -> list[dict]:
    """Headings, lists by indentation, fenced code, tables and paragraphs of Markdown; inline marks stay in the texts."""
    out, held, lists = Builder(), [], []  # lists: (indent, list item's list, its last item)
    rows = text.replace("\r\n", "\n").split("\n")

    def close(deep: int = -1) -> None:
        if held:
            body = " ".join(x.strip() for x in held)
            if lists:
                out.items[lists[-1][2]]["text"] += " " + body
            else:
                out.add("text", body)
            held.clear()
        while lists and lists[-1][0] > deep:
            lists.pop()

    at = 0
    while at < len(rows):
        row = rows[at]
        at += 1
        if fence := re.match(r"\s*(```+|~~~+)", row):
            close()
            body = []
            while at < len(rows) and not rows[at].strip().startswith(fence[1]):
                body.append(rows[at])
                at += 1
            at += 1
            out.add("code", "\n".join(body))
        elif head := re.match(r"(#{1,6})\s+(.*?)\s*#*$", row):
            close()
            out.add("section_header", head[2], level=len(head[1]))
        elif held and not lists and re.match(r"(=+|-+)\s*$", row):
            out.add("section_header", " ".join(x.strip() for x in held), level=1 if row[0] == "=" else 2)
            held.clear()
        elif re.match(r"\s*([-*_])(\s*\1){2,}\s*$", row):
            close()
        elif item := _LIST.match(row):
            indent = len(item[1].expandtabs(4))
            close(indent)
            kind = "ordered_list" if item[2][0].isdigit() else "list"
            if not lists or lists[-1][0] < indent:
                lists.append((indent, out.add(kind, "", lists[-1][2] if lists else None), -1))
            lists[-1] = (lists[-1][0], lists[-1][1], out.add("list_item", item[4].strip(), lists[-1][1]))
        elif "|" in row and at < len(rows) and "-" in rows[at] and _ROW_RULE.match(rows[at]):
            close()
            table, line = out.add("table"), 0
            while "|" in row:
                for col, cell in enumerate(re.split(r"(?<!\\)\|", row.strip().strip("|"))):
                    out.add("table_cell", cell.strip().replace("\\|", "|"), table, row=line, col=col, row_span=1, col_span=1)
                line += 1
                at += line == 1
                row = rows[at] if at < len(rows) else ""
                at += "|" in row
        elif not row.strip():
            close(lists[-1][0] if lists else -1)
        elif lists and not row.startswith(" ") and not held and at > 1 and not rows[at - 2].strip():
            close()
            held.append(row)
        else:
            held.append(re.sub(r"^\s*>\s?", "", row))
    close()
    return [x for x in out.items if x["text"] or x["type"] not in ("text",)]


_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|([A-Za-z][A-Za-z0-9]*))(;?)")


def _closed(m: re.Match) -> str:
    """The reference as it is if a semicolon ends it, else as text that reads like it."""
    return m[0] if m[2] and (m[1] is None or m[1] + ";" in html5) else "&amp;" + m[0][1:]


def html_items(markup: str, closed_references: bool = False) -> list[dict]:
    """closed_references: ``&amp`` without a semicolon is text; else it is read as browsers do."""
    return HtmlItems(_REFERENCE.sub(_closed, markup) if closed_references else markup).out.items


READERS = {"html": html_items, "md": markdown_items}


def items(docs: DataFrame, id_col: str, content_col: str, format_col: str | None = None, fmt: str = "html", closed_references: bool = False) -> DataFrame:
    """``(id_col, error, ord, parent, ...)``: items of every row; formats other than HTML and Markdown are an error row.

    Null and empty contents have no items. closed_references: as in ``html_items``. A text that its reader cannot take is an error row with no item, and never ends the job.
    """

    readers = READERS | {"html": partial(html_items, closed_references=closed_references)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                text, own = batch.column(1)[row].as_py(), batch.column(2)[row].as_py()
                try:
                    found, error = readers[own](text) if text else [], None
                except Exception as e:  # whatever a text provokes belongs to its row
                    found, error = [{}], f"{type(e).__name__}: {e}"
                if found:
                    columns = [pa.array([x.get(k) for x in found], pa.string() if k in ("type", "layer", "text") else pa.int32()) for k in FIELDS]
                    ids = pa.array([0] * len(found))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([row] * len(found))), pa.array([error] * len(ids), pa.string()), *columns], names=[id_col, "error", *FIELDS])

    kind = F.col(f"`{format_col}`") if format_col else F.lit(fmt)
    source = docs.select(F.col(f"`{id_col}`"), F.col(f"`{content_col}`").cast("string").alias("own content"), kind.alias("own format"))
    return source.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, error string, {SCHEMA}")
