import json
from html.parser import HTMLParser

import duckdb

from mailrisk.llm import html_extraction as hx
from mailrisk.llm import queries


class Article(HTMLParser):
    """Blocks of the article element, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks, self.text = False, [], ""

    def flush(self):
        block = " ".join(self.text.split())
        self.text = ""
        if block and self.inside:
            self.blocks.append(block)

    def handle_starttag(self, tag, attrs):
        if tag in ("b", "i", "br"):
            return
        self.flush()
        self.inside = tag == "article" or (self.inside and tag != "footer")

    def handle_endtag(self, tag):
        if tag not in ("b", "i", "br"):
            self.flush()
            self.inside = self.inside and tag != "article"

    def handle_data(self, data):
        self.text += data


def test_query_equals_a_parser(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r["page_id"]: r for r in queries.QUERIES["op9_html_extraction"](spark, folder).collect()}
    pages = duckdb.sql(f"SELECT page_id, url, html FROM '{folder}/pages.parquet'").fetchall()
    assert len(rows) == len(pages)
    for i, url, html in pages:
        parser = Article()
        parser.feed(html)
        parser.close()
        parser.flush()
        want = "\n".join(parser.blocks)
        assert (rows[i]["url"], rows[i]["text"], rows[i]["n_chars"]) == (url, want, len(want))


PAGE = """<!doctype html><html><head><title>T</title><style>p{{}}</style></head><body><!-- x <p>no -->
<header><h1>Site</h1></header><nav><ul>{menu}</ul></nav><div class="cookie-notice">Accept</div>
<div id="content"><h2>{title} &amp; more</h2><p>First&nbsp;<b>bold</b>
 line<p>Second<form><input>Search</form>{extra}<aside>Side</aside></div>
<div class="comments"><p>Reader says</div><script>var a = "<p>code</p>";</script><footer>Foot</footer></body></html>"""


def pages(spark):
    rows = []
    for i in range(9):
        menu = "".join(f"<li><a href=/{j}>item {j}</a>" for j in range(1 + i % 4))
        extra = "<table><tr><td>cell<td>other</table>" if i % 3 == 0 else "<p>Third" if i % 3 == 1 else ""
        rows.append((i, "http://one.org/x", PAGE.format(menu=menu, title=f"Title {i}", extra=extra), "h"))
    rows += [(20, None, "plain &lt;text&gt; only", "h"), (21, "http://two.org", None, "h"), (22, "http://two.org", "", "h"),
             (23, "http://two.org/", "<nav>menu</nav>", "h"), (24, "http://two.org/", "<p>a < b<br>c <p", "h"),
             (24, "http://two.org/", "<p>a < b<br>c <p", "h"), (None, "http://long.org", "<p>" + "word " * 60_000, "h")]
    return spark.createDataFrame(rows, "page_id int, url string, html string, host string")


def test_boilerplate_goes_and_blocks_stay(spark):
    got = hx.extract_pages(pages(spark).repartition(4), "page_id", "url", "html").collect()
    assert len(got) == 16
    text = {r["page_id"]: r["text"] for r in got}
    for i in range(9):
        tail = "\ncell\nother" if i % 3 == 0 else "\nThird" if i % 3 == 1 else ""
        assert text[i] == f"Title {i} & more\nFirst bold line\nSecond{tail}"
    assert text[20] == "plain <text> only" and text[21] == text[22] == text[23] == "" and text[24] == "a < b c"
    assert len(text[None].split()) == 60_000
    wrappers = {r["wrapper"] for r in got if r["page_id"] is not None and r["page_id"] < 9}
    assert len(wrappers) == 1
    marks = {n[1] for n in walk(json.loads(wrappers.pop())) if n[0] == "g"}
    assert "+" in marks and marks & {"?", "*"}
    assert hx.extract_pages(pages(spark).limit(0), "page_id", "url", "html").count() == 0


def walk(nodes):
    for n in nodes:
        yield n
        if n[0] in "eg":
            yield from walk(n[2])


def test_alignment_explains_both_sides():
    p, t, br = ["e", "p", [["t"]]], ["t"], ["e", "hr", []]
    assert hx._fold([p, p, p, br]) == [["g", "+", [p]], br]
    assert hx.align([p, br], [["g", "+", [p]], br]) == [["g", "+", [p]], br]
    assert hx.align([p, br], [p]) == [p, ["g", "?", [br]]]
    assert hx.align([t], []) == [["g", "?", [t]]]
    assert hx.align([["g", "?", [br]], p], [p, p]) == hx.align([p, p], [["g", "?", [br]], p])


def test_every_page_of_a_host_chooses_for_itself(spark):
    bodies = [
        ("<body><nav>menu</nav><article>in article</article></body>", "in article"),
        ("<body><nav>menu</nav><main>in main</main></body>", "in main"),
        ("<body><div class=content>named</div><div>beside</div></body>", "named"),
        ("<body><p>plain body</body>", "plain body"),
        ("<body class='has-sidebar'><p>beside a sidebar</body>", "beside a sidebar"),
        ("<body><article class='post comments-open'>open to comments</article></body>", "open to comments"),
        ("<body><nav>menu only</nav></body>", ""),
    ]
    rows = [(10 * h + i, url, html) for h, url in enumerate(["http://mixed.org/", None, "no host"]) for i, (html, _) in enumerate(bodies)]
    got = hx.extract_pages(spark.createDataFrame(rows, "page_id int, url string, html string"), "page_id", "url", "html").collect()
    assert {r["page_id"]: r["text"] for r in got} == {10 * h + i: text for h in range(3) for i, (_, text) in enumerate(bodies)}
