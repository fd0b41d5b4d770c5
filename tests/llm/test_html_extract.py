import html.parser

from gatelight.llm import html_extract as H

PAGE = (
    "<!DOCTYPE html><html><head><title>T &amp;</title><style>p{}</style><script>var t='</p>';</script></head><body>"
    "<nav><ul><li><a href='/a'>Menu</a></li></ul></nav><!-- <p>hidden</p> --><div class='ad'>Buy</div>"
    "<article><h1>Head &amp; more</h1><p><b>First   line\n here.<br><p>Two&nbsp;words &lt;b&gt; &eacute;</p>"
    "<div class='comments'><p>Reader says</p></div><aside>By the way</aside></article><footer>&copy; host</footer>"
)


def test_article_text():
    assert H.main_text(PAGE) == "Head & more First line here. Two words <b> é"
    assert H.main_text(PAGE + "</body></html>") == H.main_text(PAGE)
    assert H.main_text("") == "" and H.main_text("plain &lt; text") == "plain < text"
    assert H.main_text("<article><p>cut of") == "cut of"
    assert H.main_text("<p>a<b>b</b>c<br>d<span> e</span></p>") == "abc d e"
    assert H.main_text("<body><header>Site</header><main><header><h1>Title</h1></header><p>x</p></main></body>") == "Title x"
    assert H.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert H.main_text("<form><input><p>Name</p></form><div class='cookie-notice'>Ok?</div><ul><li>one<li>two</ul>") == "one two"


def test_site_templates_go_by_count(spark):
    def page(i, article):
        return f"<body><div><b>Site line</b> of all pages</div><div><p>{article}</p><p>Same closing line.</p></div><div>Legal {i % 2}</div></body>"

    rows = [(i, f"http://www.a.example/{i}", page(i, f"Text number {i} is long enough to be the larger part of the page, surely it is."), 1) for i in range(12)]
    rows += [(100 + i, f"http://b.example/{i}", page(0, "Another text that is long enough to be the larger part, surely it is so."), 1) for i in range(9)]
    rows += [(200, None, None, 1), (201, None, "", 1), (None, "http://c.example", "<p>x</p>", 1)]
    found = {(r.page_id): (r.text, r.n_chars) for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()}
    for i in range(12):
        assert found[i][0] == f"Text number {i} is long enough to be the larger part of the page, surely it is. Same closing line."
    # Copies of one page count once: nothing is template on that host.
    assert all(found[100 + i][0].startswith("Site line of all pages Another text") for i in range(9))
    assert found[200] == ("", 0) == found[201] and found[None] == ("x", 1)


def extracted(spark, pages):
    frame = spark.createDataFrame([(i, "http://big.example/x", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in H.extract(frame).orderBy("page_id").collect()]


def test_templates_of_a_large_host_go_by_number(spark):
    side = "<section>Rotating side {} of the host</section>"
    pages = [f"<article><p>Own text number {i} of this page.</p>{side.format(i % 40)}<p>Shared passage.</p></article>" for i in range(240)]
    assert extracted(spark, pages) == [f"Own text number {i} of this page. Shared passage." for i in range(240)]


def test_every_kind_of_subtree_is_judged(spark):
    kinds = "<p class='advert'>Subscribe now</p><p class='x1'>Follow us</p><h2 id='more'>More of it</h2><blockquote class='q'>Said often</blockquote><article>Teaser</article>"
    outside = "<ul><li>Own {0}</li><li>Same entry</li></ul><p>Own <b>words</b> {0}</p><p>Same line</p>"
    pages = [f"<article><p>Own {i}</p><p>Shared passage.</p>{kinds}</article>" for i in range(40)] + ["<body>" + outside.format(i) for i in range(40, 80)]
    assert extracted(spark, pages) == [f"Own {i} Shared passage." for i in range(40)] + [f"Own {i} Own words {i}" for i in range(40, 80)]


def test_large_templates_go_and_copies_stay(spark):
    long = "<div><p>A legal text that is on all pages and is longer than what they say themselves.</p></div>"
    short = [f"<div><p>Own {i}</p></div>{long}" for i in range(6)]
    copies = [f"<nav>Way {i}</nav><article><h1>Title</h1><div><p>The same article on many pages.</p></div></article><div class='ad'>Buy {i}</div>" for i in range(6)]
    assert extracted(spark, short + copies) == [f"Own {i}" for i in range(6)] + ["Title The same article on many pages."] * 6
    # If nothing else is left, the largest part stays.
    pages = [f"<div>The larger text {i % 4} of the page.</div><section>Part {i // 4}</section>" for i in range(16)]
    assert extracted(spark, pages) == [f"The larger text {i % 4} of the page." for i in range(16)]


def test_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert H.extract(none).count() == 0


class Plain(html.parser.HTMLParser):
    """The article's text by another parser: no tree, no counts, elements by their kind alone."""

    LEFT_OUT = {"nav", "aside", "form", "footer", "script", "style"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.blocks = [], [""]

    def _kept(self):
        return "article" in [t for t, _ in self.open] and not any(t in self.LEFT_OUT or c in ("ad", "comments") for t, c in self.open)

    def handle_starttag(self, tag, attrs):
        if tag in H.BLOCK:
            self.blocks.append("")
        if tag not in H.VOID:
            self.open.append((tag, dict(attrs).get("class")))

    def handle_endtag(self, tag):
        if tag in H.BLOCK:
            self.blocks.append("")
        if tag in [t for t, _ in self.open]:
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if self._kept():
            self.blocks[-1] += data


def test_pages_match_another_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r.page_id: r for r in H.extract(pages).collect()}
    texts = {}
    for row in pages.collect():
        own = Plain()
        own.feed(row.html)
        own.close()
        texts[row.page_id] = " ".join(filter(None, (" ".join(b.split()) for b in own.blocks)))
    wrong = [i for i, t in texts.items() if found[i].text != t]
    assert len(found) == len(texts) and not wrong, (wrong[:3], found[wrong[0]].text[:300], texts[wrong[0]][:300])


def test_counts_show_what_recurs(spark):
    page = lambda i, bar: f"<body><nav><a>Home</a></nav><article><p>Text {i} of its own.</p></article><div class='ad'>{bar}</div></body>"
    rows = [(i, "http://a.example/x", page(i, "Buy this")) for i in range(5)] + [(i, "http://b.example/x", page(i, f"Buy {i}")) for i in range(10, 13)]
    rows += [rows[0]] * 2 + [(99, "http://a.example/long", "<b>" * 30_000 + "</i>" * 30_000 + "x" + "</b>" * 30_000)]
    found = sorted((r.page_id, r.text, r.n_templates) for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    expected = [(i, f"Text {i} of its own.", 2 if i < 5 else 0) for i in [0, 0, *range(5), 10, 11, 12]] + [(99, "x", 0)]
    assert found == sorted(expected)


def test_counts_of_structures_decide_without_kinds(spark):
    """Menus, adverts and footers that differ from page to page go by their structure alone, on a host with enough pages."""
    page = "<nav><ul>{0}</ul></nav><div class='promo-x'>Buy {1} now</div><article><h1>Title {1}</h1><p>The own text of page {1}, which is long enough to be most of what there is to read on it, as the text of an article is.</p></article><footer>Made {1}</footer>"
    rows = [(i, f"http://a.example/{i}", page.format("".join(f"<li><a>Way {i} {k}</a></li>" for k in range(1 + i % 3)), i)) for i in range(6)]
    rows += [(10 + i, f"http://b.example/{i}", page.format("<li><a>x</a></li>", 10 + i)) for i in range(3)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    own = {i: H.main_text(h) for i, _, h in rows}
    both, counts, none = ({r.page_id: (r.text, r.n_templates) for r in H.extract(frame, counts=c, kinds=k).collect()} for c, k in ((True, True), (True, False), (False, False)))
    assert {i: t for i, (t, _) in both.items()} == own
    assert all(counts[i] == (own[i], 3) for i in range(6)) and all(counts[10 + i] == none[10 + i] != (own[10 + i], 0) for i in range(3))


def test_structures_of_content_stay(spark):
    """Sections that hold much of a page, or the title, are no template however often their structure recurs."""
    part = "<div class='part'><p>Part {0} of {1}, a text of its own that takes up much of the page.</p></div>"
    pages = ["<div class='lead'><h1>Title {0}</h1></div>".format(i) + "".join(part.format(k, i) for k in range(4)) for i in range(8)]
    assert extracted(spark, pages) == [" ".join([f"Title {i}", *(f"Part {k} of {i}, a text of its own that takes up much of the page." for k in range(4))]) for i in range(8)]


def test_most_given_pages_go_by_counts(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    texts = [{r.page_id: r.text for r in H.extract(pages, counts=c, kinds=k).collect()} for c, k in ((True, True), (True, False), (False, True), (False, False))]
    both, counts, kinds, none = texts
    assert both == kinds and sum(counts[i] != none[i] for i in none) >= sum(counts[i] == both[i] for i in none) > len(none) / 3, [sum(a[i] == both[i] for i in none) for a in texts]
