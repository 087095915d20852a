import random

import pytest

from playtrace.llm.render_html import render_pages, visible_text

CASES = [
    ("<p>one<p>two<div>three</div>four", "one\n\ntwo\n\nthree\nfour"),
    ("a  <b> b</b>\n c<br>d", "a b c\nd"),
    ("<ul><li>x<li>y<ol start=9><li>q<li>r</ol></ul>z", "- x\n- y\n\n  9. q\n  10. r\n\nz"),
    ("<table><tr><th>Name<th>N<tr><td>longer<td>1</table>", "Name   | N\nlonger | 1"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a | b\n  | c"),
    ("<div hidden>no</div><p style='Display : none'>no</p><span aria-hidden=true>no</span>yes", "yes"),
    ("<head><title>t</title></head><script>if (a<b) '</p>'</script><!-- x --><style>p{}</style>v", "v"),
    ("<pre>  a\n   b</pre>", "  a\n   b"),
    ("a &lt; b &amp; c 1 < 2", "a < b & c 1 < 2"),
    ("<a title='x>y'>l</a> <i>open", "l open"),
    ("before <a href=un", "before"),
    ("<dl><dt>t<dd>d1<dd>d2</dl>", "t\n  d1\n  d2"),
    ("", ""), ("plain", "plain"), ("<script>", ""), ("</p></b>x", "x"),
]


@pytest.mark.parametrize("page, text", CASES)
def test_layout(page, text):
    assert visible_text(page) == text


def test_deep_and_odd_pages_end():
    for page in ("<div>" * 5000 + "x", "<blockquote><ul><li>" * 1000 + "x", "<table><tr><td>" * 300 + "x"):
        assert "x" in visible_text(page)
    assert visible_text("<a " * 50_000) == ""


def test_table_of_pages(spark):
    rows = [(1, "<p>a", "t"), (2, None, "t"), (None, "<p>b<p>c", "t"), (1, "<p>a", "t")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string").repartition(2)
    got = render_pages(pages).collect()
    assert sorted((r.k or 0, r.text, r.n_lines, r.row.text) for r in got) == [
        (0, "b\n\nc", 3, "t"), (1, "a", 1, "t"), (1, "a", 1, "t"), (2, "", 0, "t")
    ]
    assert render_pages(pages.limit(0)).collect() == []


TABLE_CASES = [
    ("<table><tr>Hello<td>x</table>", "Hello\n\nx"),
    ("<table><tr><form><td>a</td></form></tr></table>z", "a\n\nz"),
    ("<table><tbody><form><tr><td>a<td>b</tr></form></tbody></table>z", "a | b\n\nz"),
    ("<form><table><tr><form><td>a</form><td>b</table>c", "a | b\n\nc"),
    ("<table><td>a<td>b", "a | b"),
    ("<table><thead>t<tr><td>a</td><p>u</p></table>", "t\n\nu\n\na"),
    ("<table><tr><td>a<table>s<tr><td>b</table>c</table>", "as\nb\nc"),
    ("<table><tr><template><tr><td>no</td></tr></template><td>a</table>", "a"),
]


@pytest.mark.parametrize("page, text", TABLE_CASES)
def test_strays_in_tables(page, text):
    assert [x for x in visible_text(page).split("\n") if x] == [x for x in text.split("\n") if x]


def test_every_word_of_a_tag_soup_is_rendered():
    rng = random.Random(7)
    names = "table table tr tr td td th tbody thead tfoot caption colgroup form div b p ul li dl dd pre a".split()
    for _ in range(500):
        words, page = [], []
        for i in range(60):
            tag = rng.choice(names)
            page.append(rng.choice([f"<{tag}>", f"<{tag}>", f"</{tag}>", f" w{i}x "]))
            words += [f"w{i}x"] * page[-1].startswith(" w")
        shown = visible_text("".join(page))
        assert all(shown.count(w) == 1 for w in words), page


LONG = "x>" * 40_000
ATTRIBUTE_CASES = [
    (f"<p title='{LONG}' hidden>no</p>yes", "yes"),
    (f'<img src="data:{LONG}" alt="a>b">c', "a>b c"),
    (f"<p title='{LONG[:-1]}y' style='display:none'>no</p>yes", "yes"),
    ("<img alt=Bob's> text <i title='x'>more</i>", "Bob's text more"),
    ("<p a'b=1 hidden>no</p><p '>yes</p>", "yes"),
    ("<p title = 'a' hidden = >no</p><a href=/x/>y</a><p/hidden>no", "y"),
    ("a<b title='never closed>x</b>", "a"),
]


@pytest.mark.parametrize("page, text", ATTRIBUTE_CASES)
def test_attributes_of_any_length_and_quotes(page, text):
    assert visible_text(page) == text


def test_many_quotes_take_linear_time():
    assert visible_text("<a b='" + "<a b=\"'" * 200_000) == ""
    assert visible_text("<a b=c' d>x" * 20_000) == "x" * 20_000


def test_depth_has_no_limit():
    many = "<font><b><span>" * 20_000
    page = many + "<p hidden>no</p><ul><li>a<li>b</ul><table><tr><td>c<td>d</table><div hidden>no</div>e" + "</i>" * 20_000
    assert visible_text(page) == "- a\n- b\n\nc | d\n\ne"
    assert visible_text("<div>" * 300 + "<div hidden>a<div>b</div>c</div>d") == "d"
    assert visible_text("<pre>" + "<b>" * 50_000 + "x") == "x"
    assert visible_text("<blockquote>" * 300 + "x") == "  " * 300 + "x"


def test_spans_have_no_limit():
    rows = "".join(f"<tr><td>r{i}" for i in range(1, 70))
    shown = visible_text(f"<table><tr><td rowspan=70>a<td>r0{rows}<tr><td>last</table>").split("\n")
    assert shown[0] == "a    | r0" and shown[1:70] == [f"     | r{i}" for i in range(1, 70)]
    assert shown[70] == "last |"
    sixty = "".join(f"<td>{i % 10}" for i in range(60))
    shown = visible_text(f"<table><tr>{sixty}<td>x<tr><td colspan=60>w<td>y</table>").split("\n")
    assert shown[0][-1] == "x" and shown[1][-1] == "y" and len(shown[0]) == len(shown[1])
    assert visible_text("<table><tr><td rowspan=99999999999>a<td colspan=99999999999>b<tr><td>c</table>") == "a | b\n  | c"


FORM_CASES = [
    ("a<br><br>b<br>c", "a\n\nb\nc"),
    ("<br>a<br> <br>b", "a\n\nb"),
    ("x<textarea>\nl1\n\n l2 &amp; more</textarea>y", "x\nl1\n\n l2 & more\ny"),
    ("pick <select><option>one<option selected>two<option>three</select>!", "pick two !"),
    ("<select><optgroup><option>one<option>two</optgroup></select>", "one"),
    ("<select multiple><option>one<option hidden>no<option>two</select>", "one two"),
    ("<textarea hidden>no</textarea><select style=display:none><option>no</select>v", "v"),
    ("<ol start=1234567><li>a<li>b</ol>", "1234567. a\n1234568. b"),
    ("<ol start=-2><li>a<li value='0007x'>b<li value=no>c</ol>", "-2. a\n7. b\n8. c"),
    (f"<ol start={'9' * 6000}><li>a</ol>", "2147483647. a"),
    ("<ul>some <b>bold</b> text<li>x<li>y</ul>", "  some bold text\n- x\n- y"),
]


@pytest.mark.parametrize("page, text", FORM_CASES)
def test_forms_breaks_and_numbers(page, text):
    assert visible_text(page) == text
