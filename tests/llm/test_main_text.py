import re
import time

from loreloom.llm.main_text import extract, main_texts

PARA = "A first paragraph of the story, long enough to count, with commas, and more words to follow it here."


def test_site_chrome_goes_and_article_stays():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
    <header class=top><h1>Site</h1></header><nav><ul><li><a href=/a>Menu</a></ul></nav><div class="cookie-notice">We use cookies, many, many, of them indeed.</div>
    <div id=wrap><article class="post has-sidebar"><h1>Title &amp; more</h1><p><b>{PARA}<br><p>Second &lt;b&gt;   one.<!-- <p>no</p> -->
    <ul><li>item one<li>item two</ul><aside>side</aside><div class="ad-slot">Buy, buy, buy</div><form>Name <input> Go</form>
    <section id="comments"><p>{PARA} by a reader</p></section></article><div class=sidebar><p>{PARA} sidebar</p></div></div>
    <footer>&copy; x</footer></body></html>"""
    assert extract(page) == f"Title & more {PARA} Second <b> one. item one item two"


def test_without_article_element_the_best_container_wins():
    page = f"<body><div id=top>short</div><div id=c><div class=s><p>{PARA}</p><p>Tiny.</p></div><div class=s><p>{PARA}!</p></div></div><div><a href=1>One link here to go, and on</a> <a href=2>Another link, and more of it</a></div></body>"
    assert extract(page) == f"{PARA} Tiny. {PARA}!"


def test_repairs_and_edges():
    assert extract(None) == extract("") == ""
    assert extract("just  text\n&eacute; &#233; < 5") == "just text é é < 5"
    assert extract("<p>one<p>two<div>three") == "one two three"
    assert extract("<article><p>a<script>if (a</b>) x</script>b<p>c<unknown>d</unknown>") == "ab cd"
    assert extract("<article><div hidden>no</div><p>x<p style='display: none'>no</p><p>y</article></nav></p>") == "x y"
    assert extract("<table><tr><td>a<td>b<tr><td>c</table>") == "a b c"
    assert extract("<p>unclosed <a href='x") != ""
    assert extract("<script>only()") == ""
    assert extract("<nav><div><p>x</nav><article><p>kept</article>") == "kept"


def test_long_and_deep_pages_in_linear_time():
    start = time.time()
    assert len(extract("<article>" + f"<p>{PARA}" * 20000 + "</article>")) > 20000 * len(PARA)
    assert extract("<div>" * 20000 + "deep" + "</div>" * 20000) == "deep"
    extract("<" * 50000 + "a" * 50000 + "<p " * 20000)
    assert time.time() - start < 60


def test_query_rows(spark):
    pages = spark.createDataFrame([(1, "u", f"<article><p>{PARA}</article>", 5), (1, "u", f"<article><p>{PARA}</article>", 5), (None, None, None, 6)], "page_id long, url string, html string, text int")
    got = main_texts(pages).collect()
    assert sorted((r.n_chars, r.text) for r in got) == [(0, ""), (len(PARA), PARA), (len(PARA), PARA)]
    assert main_texts(pages.limit(0)).count() == 0


def test_template_pages_against_a_plain_reading():
    for k in range(20):
        paras = [f"{PARA} {k} {i}" for i in range(k)]
        page = f'<html><body><nav><ul><li><a href="/x">x</a></li></ul></nav><div class="ad">Nicht, aber.</div><article><h1>H{k}</h1>' + "".join(f"<p>{p}</p>" for p in paras) + "</article><footer>&copy; s.</footer></body></html>"
        assert extract(page) == re.sub(r"\s+", " ", " ".join([f"H{k}", *paras]))


def test_deeply_wrapped_paragraphs_stay_together():
    for depth in (1, 5, 6, 7, 12, 40):
        for n in (2, 3, 5, 20):
            paras = [f"{PARA} {i}" for i in range(n)]
            wrapped = "".join("<div>" * depth + f"<p>{p}</p>" + "</div>" * depth for p in paras)
            for open_, close in (("<article>", "</article>"), ("<main>", "</main>"), ("<div id=c>", "</div>")):
                page = f"<body><div><a href=1>One link here to go, and on</a> <a href=2>Another link, and more of it</a></div>{open_}{wrapped}{close}</body>"
                assert extract(page) == " ".join(paras), (depth, n, open_)


def test_parts_of_an_article_are_not_lost_by_their_names():
    long = f"{PARA} {PARA}"
    parts = [
        f'<section id="recommendations"><h2>What to do</h2><p>{PARA}</p></section>', f'<section class="related-work"><p>{PARA}</p></section>', f'<div class="notice-period">{PARA}</div>',
        f'<p class="tags-explained">{PARA}</p>', '<ol><li><a href=1>A first reference of some length</a></li><li><a href=2>The second one, by someone else</a></li><li><a href=3>And a third reference, at last</a></li></ol>',
        "<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be so, and all that follows from it.</p>",
    ]
    for part in parts:
        words = re.sub(r"<[^>]*>", "|", part.replace("<mi>", "").replace("</mi><mo>", "").replace("</mo><mn>", "").replace("</mn>", "").replace("<math>", "").replace("</math>", ""))
        want = " ".join(w.strip() for w in words.split("|") if w.strip())
        for page in (f"<article><p>{long}</p>{part}<p>{long}</p></article>", f"<body><div class=content><p>{long}</p>{part}<p>{long}</p></div></body>"):
            assert extract(page) == f"{long} {want} {long}", part


def test_what_names_say_beyond_doubt_goes():
    gone = [
        f'<div class="ad-slot">{PARA}</div>', f'<section id="comments"><p>{PARA}</p></section>', f'<div class="cookie-banner"><p>{PARA}</p></div>', f'<div class="newsletter-box"><p>{PARA}</p></div>', f'<div class="sidebar"><p>{PARA}</p></div>',
        '<div class="related"><a href=1>Another story to read now</a><a href=2>And one more of these stories</a></div>', '<div class="notice">Read this.</div>', '<ul class="share"><li><a href=1>Post</a></li><li><a href=2>Mail</a></li></ul>',
        '<ul><li><a href=1>Home</a></li><li><a href=2>News</a></li><li><a href=3>Sport</a></li></ul>',
    ]
    for part in gone:
        assert extract(f"<article><p>{PARA} {PARA}</p>{part}<p>{PARA}</p></article>") == f"{PARA} {PARA} {PARA}", part


def test_deep_text_and_stray_ends_in_linear_time():
    start = time.time()
    assert len(extract("<div>some text here " * 20000)) > 20000 * 10
    extract("<div>" * 3000 + "</section>" * 20000 + "x")
    extract("<i>" * 20000 + "<p>text</p>" * 20000)
    extract("<nav>" + "<b>" * 20000 + "</u>" * 20000)
    assert time.time() - start < 15
