import random
import time

import pytest

from roadsky.llm.html_text import extract_text, render

CASES = [
    (None, ""),
    ("", ""),
    ("plain &amp; simple", "plain & simple"),
    ("<p>one<p>two", "one\n\ntwo"),
    ("<div>a</div><div>b</div>c", "a\nb\nc"),
    ("a<br>b<br/>c", "a\nb\nc"),
    ("<ul><li>x<li>y<ol><li>1st<li>2nd</ol></ul>z", "- x\n- y\n  1. 1st\n  2. 2nd\n\nz"),
    ("<ol start=9><li>i<li value=20>j<li>k</ol>", "9. i\n20. j\n21. k"),
    ("<table><tr><th>Name<th>Qty<tr><td>Fig<td>12</table>", "Name  Qty\nFig   12"),
    ("<table><tr><td rowspan=2>ab<td>c<tr><td>d</table>", "ab  c\n    d"),
    ("<table><tr><td colspan=2>wide one<td>x<tr><td>a<td>b<td>y</table>", "wide one  x\na  b  y"),
    ("<head><title>t</title></head><body>b", "b"),
    ("<title>t</title>body without a head", "body without a head"),
    ("<script>var a='<p>no</p>'</script><style>p{}</style>yes", "yes"),
    ("<p hidden>no</p><p style='color:red; Display : NONE'>no</p><p style='display:nonesuch'>yes", "yes"),
    ("<pre> a\n   b</pre>", " a\n   b"),
    ("a <!-- no --> b <!-- never closed", "a b"),
    ("1 < 2 <b>bold</b> <i>it", "1 < 2 bold it"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
    ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
    ("a</p>b</nothing>c", "a\n\nbc"),
    ("<td>loose</td> cell", "loose\ncell"),
    ("x<template>no</template><noscript>no</noscript><iframe>no</iframe>y", "xy"),
    ("<select><option>one<option>two</select>", "one\ntwo"),
    ("a\0b\r\nc", "ab c"),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_rendering(page, text):
    assert render(page) == text


@pytest.mark.parametrize("page", ["<" * 100_000, '<a "' * 50_000, "<li>" * 20_000, "<table>" * 3000 + "x", "<td>" * 20_000 + "y", "<!--" * 50_000])
def test_bad_pages_end(page):
    began = time.time()
    render(page)
    assert time.time() - began < 20


def test_deep_text_stays():
    assert "deep" in render("<div>" * 5000 + "deep")


def test_over_a_table(spark):
    rows = [(1, "u", "<p>a"), (None, None, None), (2, "v", "<p>b"), (2, "v", "<p>b")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    found = extract_text(pages).collect()
    assert sorted((str(r["page_id"]), r["text"]) for r in found) == [("1", "a"), ("2", "b"), ("2", "b"), ("None", "")]
    assert extract_text(pages.limit(0)).count() == 0


DEEP = [
    "<script>var secret=1</script>ok", "<p hidden>HID</p>ok", "<ul><li>x<li>y<ol><li>1st<li>2nd</ol></ul>z",
    "<table><tr><th>Name<th>Qty<tr><td>Fig<td>12</table>", "<pre> a\n   b</pre>", "<p>one<p>two", "<style>p{}</style>yes",
    "<details><summary>short</summary>long</details>", "<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b></div>",
]


@pytest.mark.parametrize("page", DEEP)
@pytest.mark.parametrize("around", ["div", "span", "section"])
def test_any_depth_is_laid_out_alike(page, around):
    assert render(f"<{around}>" * 5000 + page) == render(page)
    assert render(f"<{around}>" * 5000 + page + f"</{around}>" * 5000 + "<p>after") == render(page + "<p>after")


def test_deep_lists_hang():
    lines = render("".join(f"<ul><li>n{i}" for i in range(300))).split("\n")
    assert lines == ["  " * i + f"- n{i}" for i in range(300)]
    inner = render("<table><tr><td>" * 2000 + "x")
    assert inner == "x"


def test_details_and_visibility():
    assert render("<details><summary>short</summary>long</details>z") == "short\nz"
    assert render("<details open><summary>short</summary>long</details>z") == "short\nlong\nz"
    assert render("a<span style='visibility:hidden'> b <i>c</i><b style='visibility:visible'> d</b></span> e") == "a d e"
    assert render("<p style='visibility:collapse'>no<p>yes") == "yes"


def test_wide_cells_are_aligned():
    wide = "word " * 30 + "end"
    assert render(f"<table><tr><td>{wide}<td>1<tr><td>b<td>2</table>") == f"{wide}  1\n" + "b".ljust(len(wide) + 2) + "2"
    # one very long cell beside very many rows: in proportion to the text
    page = f"<table><tr><td>{'x' * 100_000}<td>1" + "<tr><td>b<td>2" * 20_000 + "</table>"
    text = render(page)
    assert len(text) < 70 * 200_000 and text.count("b") == 20_000 and "x" * 100_000 in text


def plain_lines(node, shown=True):
    """What a node says, as (text) and the borders between lines: 0 none, 1 a new line, 2 apart."""
    if isinstance(node, str):
        return [node]
    tag, children = node
    if tag in ("script", "hidden"):
        return []
    border = {"div": 1, "p": 2, "section": 1, "h2": 2}.get(tag)
    inside = [x for child in children for x in plain_lines(child)]
    return inside if border is None else [border, *inside, border]


def plainly(node):
    lines, text, gap = [], "", 0
    for x in [*plain_lines(node), 1]:
        if isinstance(x, str):
            text += x
            continue
        if text.strip():
            if gap == 2 and lines:
                lines.append("")
            lines.append(" ".join(text.split()))
            gap = 0
        text, gap = "", max(gap, x)
    return "\n".join(lines)


def markup(node):
    if isinstance(node, str):
        return node
    tag, children = node
    inside = "".join(markup(x) for x in children)
    return f"<b hidden>{inside}</b>" if tag == "hidden" else f"<{tag}>{inside}</{tag}>"


def grown(r, depth, inside=()):
    if depth == 0 or r.random() < 0.3:
        return " ".join(r.choice(["ab", "c", "", "dé", "\n"]) for _ in range(r.randint(1, 3)))
    # a block ends an open paragraph, so paragraphs hold no blocks here
    tags = ["span", "b", "hidden"] if "p" in inside else ["div", "section", "p", "h2", "span", "b", "hidden", "div"]
    tag = r.choice(tags)
    if tag == "hidden":
        return (tag, ["gone"])
    return (tag, [grown(r, depth - 1, (*inside, tag)) for _ in range(r.randint(0, 4))])


@pytest.mark.parametrize("seed", range(40))
def test_random_trees_equal_a_plain_renderer(seed):
    r = random.Random(seed)
    for _ in range(20):
        tree = ("div", [grown(r, 6) for _ in range(4)])
        assert render(markup(tree)) == plainly(tree)
