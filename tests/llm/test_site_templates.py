"""Text of pages: by hand, against a plain reading of the given pages, and template counts by brute force."""

import html as html_module
import re

from pyspark.sql.types import LongType, StringType, StructField, StructType

from shelflife.llm import site_templates
from shelflife.llm.html_blocks import read_page
from shelflife.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PAGES = StructType(
    [StructField("page_id", LongType()), StructField("url", StringType()), StructField("html", StringType())]
    + [StructField(c, LongType()) for c in ("_row", "_box", "_host", "text", "extracted_", "n.chars")]
)


def extracted(spark, rows):
    table = spark.createDataFrame([(*r, *range(6)) for r in rows], PAGES).repartition(3)
    found = site_templates.extract_text(table)
    assert found.columns == [c for c in table.columns if c != "html"] + ["extracted"]
    return [(r["page_id"], r["extracted"]) for r in found.collect()]


def test_given_pages(spark):
    """The text of the given pages is what stands in their article, paragraph by paragraph."""
    found = {r["page_id"]: r for r in QUERIES["op12_site_templates"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(found) == len(pages)
    for page in pages:
        article = re.search(r"<article>(.*?)</article>", page["html"], re.S)[1]
        blocks = [" ".join(html_module.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?p>|</h1>", article)]
        row = found[page["page_id"]]
        assert row["text"] == "\n".join(b for b in blocks if b)
        assert (row["url"], row["n_chars"]) == (page["url"], len(row["text"]))


CASES = {
    "": "",
    "no markup at all &amp; more": "no markup at all & more",
    "<p>a<p>b <br>c<td>d": "a\nb c d",
    "<article><header><h1>T&eacute;</h1></header><p>one&nbsp; <i>t</i>wo\n three</p><ul><li>x<li>y</ul><footer>f</footer></article>after": "Té\none two three\nx\ny",
    "<body class='no-sidebar'><div class=\"side-bar sidebar\">s</div><main><h1>H</h1><article><p>text</article><p>beside</main>": "H\ntext",
    "<article><p>a</p><!-- <p>no</p> --><div class='ad-slot'>buy</div><script>if (a<b) '</p>'</script><p>b</p></article><section id='comments'><article><p>reader</p></article></section>": "a\nb",
    "<nav><ul><li>left open<article><p>still the text</article>": "still the text",
    "<aside><article><p>teaser</p></article></aside><article><p>own</p></article>": "own",
    "<article><table><tr><td>1<td>2<tr><td>3</table><pre>x\n  y</pre></article>": "1 2\n3\nx y",
    "<article><p title=\"a > b\" it's>q</p><span hidden>h</span><p>k<span class=share>share</span> l</p><p style='display: none'>n</p></article>": "q\nk l",
    "<article></article><div>rest</div>": "",
    "a < b <3 &#x41;&#66; &bogus; &copy 2": "a < b <3 AB &bogus; © 2",
    "<div class=cookie-notice>c</div><div role=main><p>m</p></div>": "m",
    "<article class='post has-comments'><p>kept</p><div class='post-comments'>gone</div><form><p>f</p></form></article>": "kept",
    "<title>t</title><style>p{}</style><p>after a head</p><![CDATA[ data ]]><!-- open": "after a head\ndata",
}


def test_pages_by_hand(spark):
    rows = [(i, None if i % 2 else "https://one.example/", h) for i, h in enumerate(CASES)]
    rows += [(100, None, None), (None, "nonsense", "<p>x"), (3, None, rows[3][2])]
    found = extracted(spark, rows)
    want = [(i, CASES.get(h, "x" if i is None else "")) for i, _, h in rows]
    assert sorted((i or -1, e["text"]) for i, e in found) == sorted((i or -1, t) for i, t in want)
    assert all(e["n_chars"] == len(e["text"]) for _, e in found)


def site(host, n, body):
    return [(k, f"http://{host}/{k}", body(k)) for k in range(n)]


def test_templates_are_deleted_by_recurrence_alone(spark):
    """Boxes without a telling name: only counting finds them, and only on their own host."""
    def page(k):
        return (
            f"<div><div>Our great site</div><div>Part {k}</div></div><article><h1>Title</h1><p>Own text number {k} of the site.</p>"
            "<div><p>Read on</p><p>and on</p></div><p>Often said.</p></article><div>Made by us</div>"
        )

    found = extracted(spark, site("many.example", 9, page) + site("few.example", 4, page))
    many = [e for i, e in found if e["n_template"]]
    assert len(many) == 9
    assert {e["text"] for e in many} == {f"Title\nOwn text number {k} of the site.\nOften said." for k in range(9)}
    few = [e for i, e in found if not e["n_template"]]
    assert {e["text"] for e in few} == {f"Title\nOwn text number {k} of the site.\nRead on\nand on\nOften said." for k in range(4)}


def test_copies_of_a_page_are_not_a_template(spark):
    rows = [(k, f"http://copies.example/{k}?from=feed", "<div><section><p>The one long text of all.</p><p>Short.</p></section></div>") for k in range(40)]
    assert {e["text"] for _, e in extracted(spark, rows)} == {"The one long text of all.\nShort."}


def test_leaves_outside_articles_need_a_share(spark):
    def page(k):
        return f"<div><p>The own text of page {k}.</p><p>{'Seldom' if k < 8 else 'Often'}</p></div>"

    found = extracted(spark, site("blog.example", 1000, page))
    texts = {e["text"] for _, e in found}
    assert "The own text of page 3.\nSeldom" in texts and "The own text of page 900." in texts and len(texts) == 1000


def test_empty_table_and_long_page(spark):
    assert extracted(spark, []) == []
    long = "<article>" + "<p>word <b>and</b> word</p>" * 60_000 + "<div>" * 3000
    [(_, e)] = extracted(spark, [(1, "http://x.example/", long)])
    assert e["n_chars"] == 60_000 * 14 - 1


def test_nested_hash_counts():
    """An element's hash depends on all below it and not on attributes."""
    a = read_page("<div id=a><div>x</div><p>y</p></div>").elements
    b = read_page("<div id=b><div>x</div><p>y</p></div>").elements
    c = read_page("<div><div>x</div><p>z</p></div>").elements
    assert [e.hash for e in a] == [e.hash for e in b]
    assert a[0].hash == c[0].hash and a[2].hash != c[2].hash
