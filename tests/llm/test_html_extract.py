"""Main text of planted pages; repeated runs against brute force."""

import random
from collections import Counter

from pyspark.sql import functions as F

from fathomline.llm import html_extract

from .helpers import sentence

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav>Home About</nav><div class="cookie-notice">We use cookies</div>
<article><h1>Caf&eacute; &amp; tea</h1><p>First   line<br>goes on.</p><script>var x = "<p>no</p>";</script><aside>Read more</aside><p>Second <b>bold</b> one.</p></article>
<section id="comments"><p>A reader writes</p></section><footer>Copyright</footer></body></html>"""


def test_article_without_surroundings(spark):
    pages = spark.createDataFrame([(1, "http://a.b/1", PAGE), (2, "http://a.b/2", None), (3, None, ""), (4, "http://a.b/4", "<p>open <b>never closed"), (5, "x", "<p>" * 3000 + "w " * 50_000)], "page_id long, url string, html string")
    out = {r.page_id: r for r in html_extract.extract_main_text(pages).collect()}
    assert out[1].text == "Café & tea\nFirst line goes on.\nSecond bold one."
    assert out[2].text == out[3].text == "" and out[4].text == "open never closed"
    assert all(r.n_chars == len(r.text) for r in out.values()) and out[5].n_chars == 99_999
    assert html_extract.extract_main_text(pages.limit(0)).count() == 0
    wide = pages.union(pages).withColumn("page", F.lit(1)).withColumn("places", F.lit(2)).withColumn("key", F.lit(3)).withColumn("text", F.lit(4))
    assert sorted(r.text for r in html_extract.extract_main_text(wide).collect()) == sorted(r.text for r in out.values() for _ in range(2))


def test_repeated_runs_equal_brute_force(spark):
    rng = random.Random(11)
    shared = [sentence(rng, n, 10_000) for n in (9, 25, 7)]
    streams = {}
    for k in range(30):
        parts = [sentence(rng, rng.randrange(5, 30), 10_000), shared[k % 3], sentence(rng, 12, 10_000)]
        streams[k] = (f"http://h{k % 2}.com/{k}", parts)
    pages = spark.createDataFrame([(k, u, "".join(f"<div>{p}</div>" for p in parts)) for k, (u, parts) in streams.items()], "page_id long, url string, html string")
    out = {r.page_id: r.text for r in html_extract.extract_main_text(pages).collect()}
    n = html_extract.TOKENS
    for k, (url, parts) in streams.items():
        tokens = " ".join(parts).split()
        host = url.split("/")[2]
        pages_of = [" ".join(p).split() for u, p in streams.values() if u.split("/")[2] == host]
        held = Counter(w for t in pages_of for w in {tuple(t[i : i + n]) for i in range(len(t) - n + 1)})
        others = {w for w, m in held.items() if m >= html_extract.LEAST_PAGES[1] and m * html_extract.PART[1] >= len(pages_of)}
        covered = {i + x for i in range(len(tokens) - n + 1) if tuple(tokens[i : i + n]) in others for x in range(n)}
        wanted, at = [], 0
        for part in parts:
            words = part.split()
            mine = [(at + i) in covered for i in range(len(words))]
            runs, run = [], []
            for w, c in [*zip(words, mine), (None, True)]:
                if not c:
                    run.append(w)
                elif run:
                    runs, run = runs + [run], []
            if runs:
                wanted.append(" ".join(w for r in runs for w in r))
            at += len(words)
        assert out[k] == "\n".join(wanted)
    assert not any(shared[1] in t for t in out.values())


def test_wrappers_with_marked_words_keep_the_article():
    text = "<h1>Title</h1><p>The story.</p>"
    whole = "Title\nThe story."
    for page in (
        f"<div class='layout has-sidebar'><article>{text}</article></div>",
        f"<article class='post comment-open'>{text}</article>",
        f"<div class='elementor-widget'><article>{text}</article></div>",
        f"<article><div class='search-result'>{text}</div></article>",
        "<article><div class='article-header'><h1>Title</h1></div><p>The story.</p></article>",
        f"<div title='the hidden truth' data-x=\"a class='ad'\"><article>{text}</article></div>",
        f"<div class='widget'><p>Not this</p><article>{text}</article></div>",
        f"<main class='form'>{text}</main>",
        f"<form id='aspnet'><nav>Menu</nav><main>{text}</main></form>",
        f"<article>{text}</article><div class='widget'><article>A teaser</article></div>",
        f"<article>{text}<div class='cookie-notice'>We</div><div id=top_ad-2>Buy</div><ul class='x share-buttons'><li>Send</li></ul><p hidden>No</p><p style='display: none'>No</p></article>",
    ):
        assert html_extract.main_text(page) == whole, page
    for page in ("<p>Open page.</p><section class='comments'><article>A reader</article></section>", "<p>Open page.</p><div hidden><article>No</article></div>"):
        assert html_extract.main_text(page) == "Open page.", page


def test_boilerplate_in_marked_pages(spark):
    rng = random.Random(4)
    share, passage = sentence(rng, 14, 10_000), sentence(rng, 30, 10_000)
    rows, wanted = [], []
    for k in range(12):
        body = [sentence(rng, 20 + k, 10_000), sentence(rng, 9, 10_000)]
        # Three articles quote the same passage; all but two pages have the share text; the last is on a host of few pages.
        body += [passage] * (k < 3)
        host = "h.com" if k < 11 else "few.com"
        tag = ("article", "main")[k % 2]
        rows.append((k, f"http://{host}/{k}", f"<nav>Menu</nav><{tag}><p>{body[0]}</p><div class='x'>{share}</div>" + "".join(f"<p>{b}</p>" for b in body[1:]) + f"</{tag}>"))
        wanted.append("\n".join(body if k < 11 else [body[0], share, *body[1:]]))
    # A main part that is nothing but such runs stays, and equal rows are one page.
    rows += [(20, "http://h.com/20", f"<main>{share}</main>")] + [(30, "http://twin.com/", f"<main>{share}</main>")] * 6
    wanted += [share] * 7
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = sorted((r.page_id, r.text) for r in html_extract.extract_main_text(pages).collect())
    assert out == sorted((r[0], w) for r, w in zip(rows, wanted))


def test_pages_without_a_main_part_keep_copied_and_quoted_articles(spark):
    rng = random.Random(6)
    story, menu = sentence(rng, 60, 10_000), sentence(rng, 12, 10_000)
    rows = [(k, f"http://h.com/{k}", f"<div>{menu}</div><div>{story}</div>") for k in range(2)] + [(2, "http://h.com/2", f"<div>{menu}</div><div>{story}</div><div>A note.</div>")]
    rows += [(k, f"http://h.com/{k}", f"<div>{menu}</div><div>{sentence(rng, 30 + k, 10_000)}</div><p>ok</p>") for k in range(3, 10)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: r.text for r in html_extract.extract_main_text(pages).collect()}
    assert [out[k] for k in range(3)] == [story, story, f"{story}\nA note."]
    assert all(menu not in t for t in out.values()) and all(out[k].endswith("\nok") for k in range(3, 10))
    # Two pages alone have no boilerplate.
    two = pages.filter("page_id < 2")
    assert {r.text for r in html_extract.extract_main_text(two).collect()} == {f"{menu}\n{story}"}


def test_markup_that_is_not_what_it_seems():
    for page, wanted in {
        "<article><header><h1>Title</h1></header><p>The story.</p></article>": "Title\nThe story.",
        "<header><h1>Site</h1></header><article><p>The story.</p></article>": "The story.",
        "<p data-x=it's>The story's end.</p><p>More.</p>": "The story's end.\nMore.",
        "<main><article class=teaser>Card</article></main><div>The long story.</div>": "The long story.",
        "<p title = 'a > b'>In\u3000one\u2003space&nbsp;here</p>": "In one space here",
        "<p title=\"never closed>gone": "",
    }.items():
        assert html_extract.main_text(page) == wanted, page


def test_near_equal_articles_stay(spark):
    """Pages of a host whose articles differ in title and last word only, with and without a marked main part."""
    story, share = sentence(random.Random(8), 60, 10_000), sentence(random.Random(9), 12, 10_000)
    for tag in ("article", "div"):
        rows = [(k, f"http://h.com/{k}", f"<nav>Menu</nav><{tag}><h1>Title {k}</h1><p>{story}</p><p>ending {k}</p></{tag}>") for k in range(6)]
        out = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert out == {k: f"Title {k}\n{story}\nending {k}" for k in range(6)}, tag
    # What many pages share beside articles of their own still goes.
    rows = [(k, f"http://h.com/{k}", f"<article><p>{sentence(random.Random(100 + k), 40, 10_000)}</p><p>{share}</p></article>") for k in range(6)]
    assert not any(share in r.text for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())


def test_forms_around_pages_and_marked_headings():
    story = sentence(random.Random(3), 40, 10_000)
    for page, wanted in {
        f"<body><form action='/'><div><p>{story}</p></div></form><div>Copyright</div></body>": f"{story}\nCopyright",
        f"<p>{story}</p><form><label>Your name</label><input><p>Send us a message</p></form>": story,
        f"<article><p>{story}</p></article><form><p>{story} {story}</p></form>": story,
        "<article><p>Let <math><mi>x</mi></math> be <object>a number</object>.</p></article>": "Let x be a number.",
        "<article><h2 id='cookie'>Cookies</h2><p>Bake.</p><h3 id=menu>Menu</h3><p>Eat.</p></article>": "Cookies\nBake.\nMenu\nEat.",
    }.items():
        assert html_extract.main_text(page) == wanted, page
