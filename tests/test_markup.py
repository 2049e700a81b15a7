"""Structure of HTML and Markdown, and that no visible text is lost."""

from __future__ import annotations

import html
import random
import re

import pytest

from leafmill.plans.engine import Engine
from leafmill.sources.markup import html_items, items, markdown_items


def outline(found: list[dict]) -> list[tuple]:
    return [(x["type"], x["text"], x["parent"]) for x in found]


def test_html_blocks_lists_and_headings():
    found = html_items("<title>T</title><body>bare <b>bold</b><h1>A</h1><p>one<p>two &eacute;&#8212;<h2>B</h2><div>x<ul><li>a<li>b<ol><li>c</ol>tail</ul>y</div><pre>  k\n  l</pre><nav>n</nav><script>no()</script>")
    assert outline(found) == [
        ("title", "T", None), ("text", "bare bold", None), ("section_header", "A", None), ("text", "one", None), ("text", "two é—", None), ("section_header", "B", None), ("text", "x", None), ("list", "", None),
        ("list_item", "a", 7), ("list_item", "b", 7), ("ordered_list", "", 9), ("list_item", "c", 10), ("text", "tail", 9), ("text", "y", None), ("code", "  k\n  l", None), ("text", "n", None),
    ]
    assert [x["heading"] for x in found[2:7]] == [0, 2, 2, 2, 5] and found[-1]["layer"] == "furniture" and found[5]["level"] == 2


def test_html_tables_with_spans():
    found = html_items("<table><caption>c</caption><tr><th colspan=2>h<th>i<tr><td rowspan=2>a<td>b<td>c</tr><tr><td><p>d</p><p>e</p><td></table>after")
    cells = [(x["row"], x["col"], x["row_span"], x["col_span"], x["text"]) for x in found if x["type"] == "table_cell"]
    assert cells == [(0, 0, 1, 2, "h"), (0, 2, 1, 1, "i"), (1, 0, 2, 1, "a"), (1, 1, 1, 1, "b"), (1, 2, 1, 1, "c"), (2, 1, 1, 1, "d"), (2, 2, 1, 1, "")]
    assert outline(found)[:2] == [("table", "", None), ("caption", "c", 0)] and found[-1]["text"] == "after" and found[-1]["parent"] is None
    assert ("text", "e", [x["ord"] for x in found if x["text"] == "d"][0]) in outline(found)


@pytest.mark.parametrize("seed", range(30))
def test_no_visible_text_is_lost(seed):
    rng = random.Random(seed)
    tags = ["p", "div", "b", "i", "ul", "li", "ol", "table", "tr", "td", "th", "h1", "h3", "nav", "pre", "span", "dl", "dt", "dd", "caption", "title", "footer", "unknown"]
    out, words = [], []
    for k in range(80):
        x = rng.random()
        if x < 0.45:
            out.append(f"<{rng.choice(tags)}>")
        elif x < 0.7:
            out.append(f"</{rng.choice(tags)}>")
        elif x < 0.75:
            out.append("<!-- no --><script>var p = '<p>';</script><br>")
        else:
            words.append(f"w{k}&<ü")
            out.append(html.escape(words[-1]))
    found = html_items("".join(out))
    assert re.sub(r"\s", "", "".join(x["text"] for x in found)) == "".join(words)
    assert all(x["parent"] is None or x["parent"] < x["ord"] for x in found)


def test_markdown():
    found = markdown_items("# A #\n\nfirst\nline\n\nUnder\n===\n\n- one\n  more\n- two\n  1. in\n  2. of\n- three\n\nafter\n\n| a | b |\n|---|---|\n| c \\| d | e |\n\n```py\nx = 1\n\ny\n```\n> quoted\n---\n")
    assert outline(found) == [
        ("section_header", "A", None), ("text", "first line", None), ("section_header", "Under", None), ("list", "", None), ("list_item", "one more", 3), ("list_item", "two", 3), ("ordered_list", "", 5),
        ("list_item", "in", 6), ("list_item", "of", 6), ("list_item", "three", 3), ("text", "after", None), ("table", "", None), ("table_cell", "a", 11), ("table_cell", "b", 11), ("table_cell", "c | d", 11),
        ("table_cell", "e", 11), ("code", "x = 1\n\ny", None), ("section_header", "quoted", None),
    ]


def test_rows(spark):
    rows = [(1, "<p>a", "html"), (2, None, "html"), (3, "", "md"), (4, "x", "docx"), (None, "- b", "md"), (1, "<p>a", "html"), (5, "<p>" * 20_000 + "deep", "html")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, body string, kind string, text string")
    got = sorted((str(r.doc_id), str(r.error), str(r.type), str(r.text)) for r in items(frame, "doc_id", "body", "kind").collect())
    assert got == [("1", "None", "text", "a"), ("1", "None", "text", "a"), ("4", "KeyError: 'docx'", "None", "None"), ("5", "None", "text", "deep"), ("None", "None", "list", ""), ("None", "None", "list_item", "b")]


def test_convert_string(spark):
    rows = spark.createDataFrame([(1, "# T\n\nbody\n\n- a\n- b", "n"), (2, "", "m.md")], "doc_id long, content string, name string")
    made = Engine().convert_string(rows, "content", "md", "name")
    assert sorted((r.doc_id, r.file, r.status) for r in made.results.collect()) == [(1, "n.md", "success"), (2, "m.md", "success")]
    assert [(r.type, r.item_ref, r.parent_ref, r.text) for r in made.items.orderBy("doc_id", "seq").collect()] == [
        ("section_header", "#/0", None, "T"), ("text", "#/1", "#/0", "body"), ("list", "#/2", "#/0", ""), ("list_item", "#/3", "#/2", "a"), ("list_item", "#/4", "#/2", "b"),
    ]
    with pytest.raises(ValueError, match="cannot be converted"):
        Engine().convert_string(rows, "content", "pdf")


def test_references_without_a_semicolon():
    from leafmill.sources.markup import html_items

    text = "<p>a&amp b &lt;c&gt; &#65; &#65 &notit; &copyright &&&amp</p>"
    assert [x["text"] for x in html_items(text)] == ["a& b <c> A A ¬it; ©right &&&"]
    assert [x["text"] for x in html_items(text, closed_references=True)] == ["a&amp b <c> A &#65 &notit; &copyright &&&amp"]
