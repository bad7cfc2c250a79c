import random

from quire.llm import wrapper


def page(k, body):
    return f"""<!doctype html><html><head><title>T {k}</title><style>p{{}}</style></head><body><div id="top" class="site-header"><a href=/>Home</a></div>
    <div class="wrap"><p>Welcome to our site, where you read stories of all kinds.</p>{body}</div><!-- ad <p>x</p> --><form><p>Search</p></form><aside>Side {k}</aside>
    <div class="comments"><p>First! {k}</p></div><div class="cookie-notice">We use cookies</div><script>var a = "<p>no</p>";</script><footer>f {k}</footer></body></html>"""


def story(k):
    return f"<h2>Title&nbsp;{k}</h2><p>Body of story {k}\n with many   words &amp; signs.<p>Second <i>para</i>graph {k}<br>more</p><ul><li>one {k}<li>two</ul><table><tr><td>a{k}<td>b</table>"


WANT = "Title 9\n\nBody of story 9 with many words & signs.\n\nSecond paragraph 9 more\n\none 9\n\ntwo\n\na9\n\nb"


def test_template_goes_and_slots_stay():
    own = wrapper.Wrapper([page(k, story(k)) for k in range(5)])
    assert wrapper.extract(page(9, story(9)), own) == WANT
    assert wrapper.extract(page(9, story(9)), None).endswith(WANT)


def test_copies_of_an_article_are_no_template():
    own = wrapper.Wrapper([page(k, story(9) + "<p>A long enough paragraph that all of the copies share.</p>") for k in range(5)])
    assert "Body of story 9" in wrapper.extract(page(7, story(9) + "<p>A long enough paragraph that all of the copies share.</p>"), own)


def test_article_and_broken_markup():
    assert wrapper.extract("<nav>n</nav><article><header><h1>H</h1></header><p><b>x<br><p>y &lt; z</article><div>out</div>", None) == "H\n\nx\n\ny < z"
    assert wrapper.extract("<header><h1>Site</h1></header><main><p>x</main>", None) == "x"
    assert wrapper.extract("plain <b>bold</b> a < b <script>if(a<b){'</p>'}</script>tail <p", None) == "plain bold a < b tail"
    for empty in (None, "", "<", "<p", "<!--", "<script>", "</p></div>"):
        wrapper.extract(empty, None)
    r = random.Random(0)
    own = wrapper.Wrapper([page(k, story(k)) for k in range(3)])
    bits = ["<p>", "</p>", '<a href="x', "<", "&amp;", "</", "<!--", "-->", "<div class='ad'>", "</div>", "t ", "<li>", "<table>", "<td>", "<script>", "</script>", '"', "'", ">", "<br/>", "<b>"]
    for _ in range(500):
        wrapper.extract("".join(r.choice(bits) for _ in range(r.randint(0, 40))), own)


def test_query_over_hosts(spark, monkeypatch):
    rows = [(k, f"http://a.example/{k}", page(k, story(k))) for k in range(12)] + [(100, None, page(9, story(9))), (101, "x", None), (102, "http://b.example", ""), (103, "http://A.example/9", page(9, story(9)))]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text")
    got = {r.page_id: r for r in wrapper.main_text(frame).collect()}
    assert got[103].text == WANT and got[103].n_chars == len(WANT) and got[101].text == got[102].text == "" and got[100].text.endswith(WANT)
    monkeypatch.setattr(wrapper, "BROADCAST_BYTES", 0)
    assert {r.page_id: r for r in wrapper.main_text(frame).collect()} == got
    assert wrapper.main_text(frame.limit(0)).count() == 0


def test_long_page():
    html = "<article>" + "".join(f"<p>paragraph {k}" for k in range(20000)) + "</article>"
    assert wrapper.extract(html, None).count("\n\n") == 19999
    for n in (100, 400, 50_000):
        deep = "<article>" + "<div>" * n + "x<script>a<b</script>" + "</div>" * n + "<p>y"
        assert wrapper.extract(deep, None) == "x\n\ny"
        wrapper.Wrapper([f"<nav class=menu>{'<b><nav>' * n}{k}" for k in range(3)]).template(wrapper.parse(deep))


def test_labels_name_regions_by_whole_tokens():
    body = "<article><div class='entry-header'><h1>Title</h1></div><p>Body of it.</p></article>"
    want = "Title\n\nBody of it."
    for label in ("site no-sidebar", "page has-sidebar", "overflow-hidden", "layout-side-by-side", "post-content legal", "related-work", "sidebar"):
        assert wrapper.extract(f"<body><nav>n</nav><div class='{label}'>{body}</div></body>", None) == want
    assert wrapper.extract(f"<body><form id=aspnet>{body}</form></body>", None) == want
    assert wrapper.extract("<body><form><nav>n</nav><div><p>All of the page stands in a form.</p></div></form></body>", None) == "All of the page stands in a form."
    assert wrapper.extract("<div class='post-content legal'><p>Words.</p></div><div class='site-header'>Site</div>", None) == "Words."
    cards = "<div class='comments-area'><article><p>A comment, longer than all of the body is, by far.</p></article></div>"
    assert wrapper.extract(f"<div>{body}</div>{cards}", None) == want
    for label in ("sidebar", "site-footer", "cookie-notice", "nav-menu", "related-posts", "ad ad-slot", "ad-1", "breadcrumb", "comments-area"):
        assert wrapper.extract(f"<div><p>{'Words of the page. ' * 5}</p></div><div class='{label}'>x y</div>", None) == " ".join(["Words of the page."] * 5)


def test_long_boilerplate_and_short_articles():
    boiler = "".join(f"<p>Sentence {w} of a long text that stands on every page of the host.</p>" for w in "abcdefgh")
    html = "<body><div>{}</div><div><h2>Title {}</h2><p>Short {}.</p></div></body>"
    own = wrapper.Wrapper([html.format(boiler, k, k) for k in range(5)])
    assert wrapper.extract(html.format(boiler, 9, 9), own) == "Title 9\n\nShort 9."
    assert wrapper.extract(f"<body><div>{boiler}</div></body>", own) == ""


def test_layouts_and_repeated_articles():
    def layout(name, k):
        return f"<body><div class={name}><p>Template of layout {name}, on all pages of it.</p></div><div class=b{name}><p>Story {k} of layout {name}, which is told but once.</p><p>More of story {k}.</p></div></body>"

    own = wrapper.Wrapper([layout("x", k) for k in range(6)] + [layout("y", k) for k in range(4)])
    for name in "xy":
        assert wrapper.extract(layout(name, 20), own) == f"Story 20 of layout {name}, which is told but once.\n\nMore of story 20."
    same = "".join(f"<p>Paragraph {k} of an article that stands on several pages.</p>" for k in range(6))
    pages = [f"<body><p>Top.</p><div><p>Own text of page {k}.</p></div></body>" for k in range(20)] + [f"<body><p>Top.</p><div>{same}<p>Edition {k}</p></div></body>" for k in range(5)]
    assert wrapper.extract(pages[-1], wrapper.Wrapper(pages)).count("an article that stands") == 6


def test_all_pages_of_a_host_are_counted(spark, monkeypatch):
    def layout(name, k):
        filler = f"<p>{'Long words of a long story ' * 8000}{k}</p>" if k == 0 else ""
        return f"<body><div class={name}><p>Template of layout {name}.</p></div><div><p>Story {k} of {name}.</p>{filler}</div><p>End notice of {name}.</p></body>"

    rows = [(k, f"http://h.example/{k}", layout("x", k)) for k in range(30)]
    rows += [(100 + k, f"http://h.example/y{k}", layout("y", k)) for k in range(8)]
    rows += [(200 + k, f"http://h.example/copy{k}", layout("x", 5)) for k in range(60)]
    rows += [(300 + k, f"http://long.example/{k}", layout("z", 0).replace("Story 0", f"Story {k}")) for k in range(4)]
    rows += [(400 + k, None, layout("w", k + 1)) for k in range(4)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrapper.main_text(frame).collect()}
    assert len(got) == len(rows)
    assert all(got[k] == f"Story {k} of x." for k in range(1, 30)) and all(got[100 + k] == f"Story {k} of y." for k in range(1, 8))
    assert all(got[200 + k] == "Story 5 of x." for k in range(60)) and all(got[400 + k] == f"Story {k + 1} of w." for k in range(4))
    assert all("End notice" not in got[300 + k] and f"Story {k}" in got[300 + k] for k in range(4))
    monkeypatch.setattr(wrapper, "BROADCAST_BYTES", 0)
    assert {r.page_id: r.text for r in wrapper.main_text(frame).collect()} == got


def test_cards_are_not_the_article():
    body = "<h1>Title</h1><p>The body of the page, which is much longer than the cards beside it are, and goes on for a while.</p>"
    cards = "".join(f"<article><h3>Card {k}</h3></article>" for k in range(3))
    for tag in ("div", "main"):
        got = wrapper.extract(f"<header><p>Site</p></header><{tag}>{body}</{tag}><div>{cards}</div>", None)
        assert got.startswith("Title\n\nThe body of the page") and "Site" not in got
    assert "Card" not in wrapper.extract(f"<main>{body}</main><div>{cards}</div>", None)
    own = wrapper.Wrapper([f"<body><article><p>About us.</p></article><div><p>Story {k}.</p></div></body>" for k in range(4)])
    assert wrapper.extract("<body><article><p>About us.</p></article><div><p>Story 9.</p></div></body>", own) == "Story 9."


def test_end_tags_of_deep_elements_close_only_them():
    for n in (100, 200, 400, 20_000):
        html = "<div><article>" + "<div>" * n + "deep" + "</div>" * n + "<p>rest</p></article></div><div>out</div>"
        assert wrapper.extract(html, None) == "deep\n\nrest"
        html = "<table><tr><td><article>" + "<table><tr><td>" * n + "deep" + "</table>" * n + "<p>rest</p></article><td>out</table>"
        assert wrapper.extract(html, None) == "deep\n\nrest"


def test_a_line_of_few_articles_stays():
    def html(lang, k, line):
        return f"<html lang={lang}><body><p>Top {lang}.</p><article><p>Own text of {k}, which no other page has.</p>{line}</article></body></html>"

    common = "<p>A line that several articles share.</p>"
    pages = [html("en", k, "") for k in range(60)] + [html("fr", 100 + k, common) for k in range(4)]
    own = wrapper.Wrapper(pages)
    assert wrapper.extract(pages[-1], own) == "Own text of 103, which no other page has.\n\nA line that several articles share."
