from loomlake.llm.html import extract, main_text

SCHEMA = "page_id long, url string, html string"


def texts(spark, pages):
    rows = [(k, f"http://{host}/{k}", page) for k, (host, page) in enumerate(pages)]
    return [r.text for r in main_text(spark.createDataFrame(rows, SCHEMA)).orderBy("page_id").collect()]


def test_counts_decide_beside_articles(spark):
    same = "<div>Follow us on all channels</div><header>The daily paper</header>"
    page = "<body>{same}<header><h1>Head {k}</h1></header><div>Lead {k}</div><article><p>First part {k}</article><article><p>Second {k}</article></body>"
    got = texts(spark, [("a", page.format(same=same, k=k)) for k in range(6)])
    assert got == [f"Head {k}\n\nLead {k}\n\nFirst part {k}\n\nSecond {k}" for k in range(6)]


def test_marks_need_confirming():
    body = "<p>Some words of the text.</p><p>And more of them, to the end.</p>"
    plain = "Some words of the text.\n\nAnd more of them, to the end."
    for wrap in ("div class='layout has-sidebar'", "div class='content no-comments'", "div class='overflow-hidden'", "div class='widget'", "div id='menu'", "form action='/'", "div hidden"):
        end = f"</{wrap.split()[0]}>"
        assert extract("a", f"<body><{wrap}><article>{body}</article>{end}</body>", set()) == plain
    assert extract("a", f"<body><div class='layout has-sidebar'>{body}</div></body>", set()) == plain
    assert extract("a", f"<body><form action='/'>{body}</form><p>End.</body>", set()) == plain + "\n\nEnd."
    assert extract("a", f"<body>{body}<form action='/'>Search</form></body>", set()) == plain
    assert extract("a", f"<body><div class='related'>{body}</div></body>", set()) == plain
    assert extract("a", f"<article>{body}<section id='related-work'><p>Others</section><figure class='banner-image'><p>It</figure></article>", set()) == plain + "\n\nOthers\n\nIt"
    assert extract("a", f"<article>{body}<div class='box share'>Share</div></article><div class='ad'>Buy this now, " + "or this, " * 30 + "</div>", set()) == plain


def test_copies_count_once(spark):
    body = "<p>The one text that was copied.</p><p>It has a second part.</p><p>And a third one.</p>"
    plain = "The one text that was copied.\n\nIt has a second part.\n\nAnd a third one."
    inner = "<article><div>{}</div><ul><li>And its list</ul></article>".format(body)
    pages = [("a", f"<body><!-- {k} -->{body}</body>") for k in range(4)] + [("a", f"<body><p>Page {k}</p><p>It has a second part.</p></body>") for k in range(1)]
    pages += [("b", f"<nav>{k}</nav>{inner}<div>Part {k}</div>") for k in range(6)]
    got = texts(spark, pages)
    assert got == [plain] * 4 + [f"Page {k}\n\nIt has a second part." for k in range(1)] + [f"{plain}\n\nAnd its list\n\nPart {k}" for k in range(6)]


def test_broken_markup():
    assert extract("a", "<body><b title=it's>One</b> <p class=\"x>y\" data-a='>'>Two</p></body>", set()) == "One\n\nTwo"
    assert extract("a", "<p>One</p><a href=\"no end", set()) == "One"
    assert extract("a", "<p>a < b & 3 <5</ x></p><p title='is hidden'>Two</p><p hidden>No</p>", set()).endswith("Two")
    deep = "<div>" * 5000 + "<p>In the deep</p>" + "</div>" * 5000
    assert extract("a", f"<article>{deep}</article><p>After</p>", set()) == "In the deep\n\nAfter"


def test_time_is_linear():
    import time

    def took(page):
        began = time.process_time()
        extract("a", page, set())
        return time.process_time() - began

    for piece in ('<a "', "<a x='", "<", "</b>", "<b><p>", "<!-", "<div class='ad'>", "<article>", "&amp"):
        small, large = took(piece * 10_000), took(piece * 80_000)
        assert large < 20 * small + 0.5, piece


def test_long_page_and_empty_table(spark):
    body = "".join(f"<p>Paragraph {k} of it.</p>" for k in range(100_000))
    assert texts(spark, [("a", f"<body><nav>Menu</nav>{body}</body>")])[0].count("\n\n") == 99_999
    assert main_text(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = spark.createDataFrame([(1, "http://a/", "<p>x</p>", "old", "h", "r")], SCHEMA + ", text string, host string, row string")
    assert [tuple(r) for r in main_text(clash).select("page_id", "host", "row", "text").collect()] == [(1, "h", "r", "x")]


def test_templates_on_pages_without_article(spark):
    """Two hosts, twelve pages each: what recurs goes, by the counts alone, on the small and the joined way."""
    def page(host, k):
        return f"<body><div id='x{host}'><p>Welcome to {host}</p><ul><li>Start</li><li>Contact</li></ul></div><h1>Title {k}</h1><p>Body {host} {k} first.</p><div><p>Body {k} second.</p></div><div><p>Imprint of {host}</p></div></body>"

    rows = [(k, f"http://{h}.org/{k}", page(h, k)) for h in ("one", "two") for k in range(12)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = sorted((f"http://{h}.org/{k}", f"Title {k}\n\nBody {h} {k} first.\n\nBody {k} second.") for h in ("one", "two") for k in range(12))
    for most in (1_000_000, 2):
        assert sorted((r.url, r.text) for r in main_text(frame, most_sent=most).collect()) == want
