import random
from html.parser import HTMLParser

import pytest

from salesledger.llm import markup, queries
from tests.llm.data import FOLDER

CASES = [
    ("", ""), ("plain  text\n here", "plain text here"), ("a<br>b<br><br>c", "a\nb\n\nc"), ("<p>a<p>b", "a\n\nb"), ("<div>a</div><div>b</div>", "a\nb"),
    ("a <b> c </b>d", "a c d"), ("x<script>if (a<b) '</p>'</script>y<style>p{}</style>", "xy"), ("<!-- <p>no</p> -->yes<!-- open", "yes"),
    ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>e", "- a\n- b\n  3. c\n  4. d\n\ne"), ("<pre>a\n  b\n\nc</pre>d", "a\n  b\n\nc\n\nd"),
    ("<table><tr><th>k<th>value<tr><td>long<td>1</table>", "k     value\nlong  1"), ("<p hidden>a</p><p style='display: none'>b</p><p>c", "c"),
    ("<style>.ad,#x{display:none}</style><p class='big ad'>a<p id=x>b<p>c", "c"), ("1 < 2 &amp; 3 &lt; 4 &nope; &#233;", "1 < 2 & 3 < 4 &nope; é"),
    ("<a href='x>y'>t</a><img alt=no><input value=no>", "t"), ('<a href="never closed>t</a>', "t"), ("</p></div>a</b>", "a"), ("<td>a<td>b", "a b"),
    ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"), ("<table><tr><td><table><tr><td>in</table><td>out</table>", "in  out"), ("<textarea> <p>x </textarea>", "<p>x"),
]


@pytest.mark.parametrize("page, text", CASES)
def test_rendering(page, text):
    assert markup.extract(page)[1] == text


def test_title_and_null():
    assert markup.extract("<title> A &amp;\n B </title><p>x") == ("A & B", "x")
    assert markup.extract(None) == (None, None)


def test_deep_and_long_pages():
    assert markup.extract("<div>" * 50_000 + "x" + "</p>" * 50_000)[1] == "x"
    assert markup.extract("<table><tr><td>" * 300 + "x")[1].strip() == "x"
    assert len(markup.extract("<li>word" * 20_000)[1]) == 20_000 * 7 - 1
    assert markup.extract("<a b='" * 20_000)[1] == ""


def test_words_of_the_article_stay(spark):
    out = {r["page_id"]: r for r in queries.op8_html_text(spark, FOLDER).collect()}
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    assert len(out) == len(pages)
    for p in pages:
        assert (out[p["page_id"]]["title"], out[p["page_id"]]["text"]) == markup.extract(p["html"])
        assert "track(" not in out[p["page_id"]]["text"] and "<p>" not in out[p["page_id"]]["text"]


def test_odd_rows(spark):
    rows = [(1, "<p>a", "clash"), (1, "<p>a", "clash"), (None, None, None), (2, "", "t")]
    out = markup.extract_text(spark.createDataFrame(rows, "page_id long, html string, text string"))
    assert out.columns == ["page_id", "title", "text"]
    assert sorted((r["page_id"] or 0, r["text"]) for r in out.collect() if r["text"] is not None) == [(1, "a"), (1, "a"), (2, "")]
    assert markup.extract_text(spark.createDataFrame([], "page_id long, html string")).count() == 0


STRAY = [
    ("<table>text<tr><td>a</table>", "text\na"), ("<table><tr>text<td>a<td>b</table>", "text\na  b"), ("<table><tr><td>a</td></tr> bare <b>text</b> on", "a\nbare text on"),
    ("<table><tbody>x<tr><td>a</td><td>b</td></tr>y z</tbody></table>w", "x\na  b\ny z\n\nw"), ("<table><form>f<tr><td>a</form></table>", "f\na"),
    ("<table> <tr> <td>a</td> <td>b</td> </tr> </table>", "a  b"), ("<table><colgroup><col><tr><td>a</table>", "a"), ("<table><tr><form><td>a<td>b</form></table>", "a  b"),
]


@pytest.mark.parametrize("page, text", STRAY)
def test_stray_text_of_tables(page, text):
    assert markup.extract(page)[1] == text


def test_stray_text_widens_no_column():
    page = "<table>" + "<tr><td>a<td>b</td></tr>" * 2000 + "word " * 20_000
    assert len(markup.extract(page)[1]) < 2 * len(page)


def test_long_style_rules():
    names = ",".join(f".a{i}" for i in range(400))
    page = f"<style>@media x {{ {names} {{ color: red; {'margin: 0; ' * 400} display: none }} }} p{{}}</style>"
    assert markup.extract(page + "<p class=a0>x<p class=a399>y<p class=b>z")[1] == "z"
    assert list(markup._rules("a{b}c{d{e}}f{")) == [("a", "b"), ("d", "e")]


SPANS = [
    ("<table><tr><th colspan=2>both<th>c<tr><td>left<td>right<td>x</table>", "both         c\nleft  right  x"),
    ("<table><tr><td rowspan=2>ab<td>c<tr><td>d<tr><td>e<td>f</table>", "ab  c\n    d\ne   f"),
    ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>", "a  b\n   c\n   d"),
    ("<table><tr><td colspan=x>a<td rowspan=-1>b<tr><td>cc<td>d</table>", "a   b\ncc  d"),
    ("<table><tr><td>" + "w" * 60 + "<td>b<tr><td>a<td>c</table>", "w" * 60 + "  b\na  c"),
    ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"),
]
STYLES = [
    ("<style>div.a{display:none}</style><p class=a>x</p><div class='b a'>y</div>z", "x\n\nz"),
    ("<style>.a.b{display:none}</style><p class=a>x<p class='b a'>y", "x"), ("<style>p#i,b{display:none}</style><p id=i>x<p>y<b>z</b>", "y"),
    ("<div style='visibility:hidden'>a<p style='visibility: visible'>b</p>c</div>d", "b\n\nd"),
    ("<style>.v{visibility:hidden}.w{visibility:visible}</style><ul class=v><li>a<li class=w>b</ul>", "- b"),
    ("<table style='visibility:collapse'><tr><td>a<td style='visibility:visible'>b</table>", "b"),
    ("<style>.x{display:none} p.x{display:block} #k{display:none}</style><p class=x>a<p class=x id=k>b<b class=x>c", "a"),
    ("<style>.x{display:none}</style><p class=x style='display:block'>a<p style='color:red' class=x>b", "a"),
    ("<style>.a .b{display:none}</style><p class=b>x", "x"), ("<style>P{display:none}</style><p>x</p>y", "y"),
    ("a<svg><title>t</title><desc>d</desc><g><text>b<tspan>c</tspan></text><path d=x></path>no</g></svg>d", "a bc d"),
]


@pytest.mark.parametrize("page, text", SPANS + STYLES)
def test_spans_and_styles(page, text):
    assert markup.extract(page)[1].strip() == text


@pytest.mark.parametrize("page", [
    "<table><tr><td>" + "w" * 2000 + "<td>b" + "<tr><td>a<td>b" * 3000, "<p><button>" + "<i>" * 6000 + "<div></div>" * 6000,
    "<table><tr>" + "<td>a" * 2000 + "<td>" + "x<br>" * 5000, "<table><tr>" + "<td rowspan=65534>a" * 1000 + "<tr><td>b" * 3000,
    "<table>" + "<tr><td colspan=1000>b<td>c" * 2000, ("<table><tr><td>x<td>" * 9) + "<br>y" * 5000,
    "<style>" + "".join(f".a{i % 90}.b{i // 90}{{display:none}}" for i in range(5000)) + "</style>" + "<p class='a1 b2 c'>x" * 2000,
])
def test_output_is_bounded(page):
    assert len(markup.extract(page)[1]) < 20 * len(page)


def test_rows_of_too_much_padding():
    wide = "<td>" + "w" * 48
    page = "<table><tr>" + wide * 9 + "<tr>" + "<td>" * 8 + "b<tr>" + "<td>" * 8 + "c<br>" * 30 + "</table>"
    assert markup.extract(page)[1].split("\n")[1:] == [" " * 350 + "b", *["c"] * 30]


class Brute:
    """Random well-formed pages, some end tags left out, and their text by plain recursion over the tree and a grid of cells."""

    def __init__(self, seed):
        self.r, self.n = random.Random(seed), 0

    def words(self):
        self.n += 1
        return " ".join(f"w{self.n}{'x' * self.r.randint(0, 5)}" for _ in range(self.r.randint(1, 3)))

    def end(self, tag):
        return self.r.choice(["", f"</{tag}>"])

    def inline(self, seen):
        """(markup, text): a run of words, some of them not displayed or not visible."""
        page, text = [], []
        for _ in range(self.r.randint(1, 3)):
            w, kind = self.words(), self.r.choice(["b", "b", "b", "none", "hidden", "visible"])
            start = {"b": "<b>", "none": "<b class='u gone'>", "hidden": "<b style='visibility:hidden'>", "visible": "<b style='visibility:visible'>"}[kind]
            page.append(f" {start}{w}</b> ")
            if kind == "visible" or (kind == "b" and seen):
                text.append(w)
        return "".join(page), " ".join(text)

    def blocks(self, depth, seen, listed):
        """(markup, items): items are least breaks (int) or [indent, mark, lines]."""
        page, items = "", []
        for _ in range(self.r.randint(1, 3)):
            kind = self.r.choice(["text", "p", "div", "ul", "table", "gone", "veiled"] if depth else ["text", "p"])
            if kind in ("text", "p"):
                m, t = self.inline(seen)
                gap = [2] if kind == "p" else [1]
                page += f"<p>{m}</p>" if kind == "p" else f"<div>{m}</div>"
                items += gap + ([[0, "", [t]]] if t else []) + gap
            elif kind == "ul":
                m, out = "", []
                for _ in range(self.r.randint(1, 3)):
                    w, (sub, under) = self.words(), self.blocks(depth - 1, seen, True)
                    own = [[0, "- ", [w]]] if seen else []
                    m += f"<li>{w}{sub}" + self.end("li")
                    out += [1, *([i + 2, k, x] if not isinstance(b, int) else b for b in own + under for i, k, x in [b if not isinstance(b, int) else (0, "", [])]), 1]
                gap = [1] if listed else [2]
                page += f"<ul>{m}</ul>"
                items += gap + out + gap
            elif kind == "table":
                m, lines = self.table(depth, seen)
                page += m
                items += [2, *([[0, "", lines]] if lines else []), 2]
            else:
                m, under = self.blocks(depth - 1, seen and kind == "div", listed)
                style = {"gone": " class='gone u'", "veiled": " style='visibility: hidden'", "div": ""}[kind]
                page += f"<div{style}>{m}</div>"
                items += [] if kind == "gone" else [1, *under, 1]
        return page, items

    def table(self, depth, seen):
        page, taken, cells, width = "<table>", set(), [], {}
        for row in range(self.r.randint(1, 4)):
            page, col = page + "<tr>", 0
            for _ in range(self.r.randint(1, 3)):
                m, items = self.blocks(self.r.choice([0, 0, depth - 1]), seen, False)
                lines = fold(items)
                across, down = self.r.choice([(1, 1), (1, 1), (2, 1), (1, 2)])
                while (row, col) in taken:
                    col += 1
                taken |= {(row + i, col + j) for i in range(down) for j in range(across)}
                cells.append((row, col, lines))
                if across == 1:
                    width[col] = max(width.get(col, 0), max((len(x) for x in lines if len(x) <= markup.WIDE), default=0))
                page += f"<td colspan={across} rowspan={down}>{m}" + self.end("td")
                col += across
            page += self.end("tr")
        out = []
        for row in range(1 + max(c[0] for c in cells)):
            mine = [(sum(w + 2 for k, w in width.items() if k < col), lines) for r, col, lines in cells if r == row]
            for k in range(max(len(lines) for _, lines in mine)):
                line = ""
                for start, lines in mine:
                    if k < len(lines) and lines[k]:
                        line = line.ljust(max(start, len(line) + 2 if line else 0)) + lines[k]
                out.append(line.rstrip())
            if not any(x for _, lines in mine for x in lines) and out:
                out = out[: len(out) - max(len(lines) for _, lines in mine)]
        return page + "</table>", out


def fold(items):
    lines, gap = [], 0
    for x in items:
        if isinstance(x, int):
            gap = max(gap, x)
        else:
            indent, mark, new = x
            lines += [""] * (gap - 1 if lines else 0)
            lines += [" " * max(0, indent - len(mark if k == 0 else "")) + (mark if k == 0 else "") + n for k, n in enumerate(new)]
            gap = 0
    return lines


@pytest.mark.parametrize("seed", range(300))
def test_brute_force_renderer(seed, monkeypatch):
    monkeypatch.setattr(markup, "SPARE", 1000)  # rows are padded whatever it takes
    brute = Brute(seed)
    page, items = brute.blocks(3, True, False)
    clean = lambda lines: [x.rstrip() for x in lines]
    assert clean(markup.extract("<style>.gone{display:none}</style>" + page)[1].split("\n")) == (clean(fold(items)) or [""])


def test_words_of_pages_in_order(spark):
    """Every word that another parser sees outside hidden elements is in the text, in the same order."""

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.found, self.hidden = [], 0

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style", "title", "noscript")

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style", "title", "noscript")

        def handle_data(self, data):
            self.found += [] if self.hidden else data.split()

    for p in spark.read.parquet(f"{FOLDER}/pages.parquet").collect():
        plain = Words()
        plain.feed(p["html"])
        plain.close()
        got = [w for w in markup.extract(p["html"])[1].split() if w not in ("-", "•")]
        assert "".join(got) == "".join(w for w in plain.found if w not in ("-", "•"))
