"""Pages with known articles."""

import random
import time

import numpy as np
import pytest

from haulmark.llm.html_extraction import chosen, html_extraction, main_text, page_lines

ARTICLE = "<h1>A &amp; B&nbsp;title</h1><p>First\n  para <b>bold</b><a href=x>link</a>.</p><p>It&#39;s &lt;b&gt; x<br>Second <i>line</i></p><ul><li>one<li>two</ul><table><tr><td>c1</td><td>c2</td></tr></table><p>Of."
WANT = "A & B title\nFirst para boldlink.\nIt's <b> x\nSecond line\none\ntwo\nc1 c2\nOf."
NOISE = ["<nav><ul><li><a href=/a>a</a></li></ul></nav>", "<header><p>site</p></header>", "<footer>&copy; x</footer>", "<aside><p>side</p></aside>", '<div class="ad">buy <div>x</div> now</div>', "<script>var t='</p>';</script>", "<style>p{}</style>", "<!-- <p>no</p> -->", "<form><input><p>mail</p></form>", '<section id="comments"><article><p>nice</p></article></section>', '<div class="cookie-notice">ok?</div>', '<div class="sidebar left"><p>more</p></div>', "<noscript>enable</noscript>", '<p hidden>h</p>', "<button>go</button>"]


@pytest.mark.parametrize("seed", range(30))
def test_article(seed):
    r = random.Random(seed)
    some = lambda: "".join(r.choices(NOISE, k=r.randint(0, 5)))
    i = r.choice([0, ARTICLE.index("<p>It"), ARTICLE.index("<ul>")])
    page = f'<!DOCTYPE html><html><head><title>t</title></head><body class="has-sidebar">{some()}<article>{ARTICLE[:i]}{some()}{ARTICLE[i:]}</article>{some()}' + r.choice(["</body></html>", ""])
    assert main_text(page) == WANT


def test_unmarked():
    body = "".join(f"<div><p>{'words in a long paragraph ' * 6}{i}.</p></div>" for i in range(4))
    page = f"<html><body><ul><li><a href=/>home</a></li><li><a href=/b>about us</a></li></ul><div class=ad>buy</div>{body}<footer>end</footer><p>x</p></body></html>"
    assert main_text(page).split("\n")[:4] == [f"{'words in a long paragraph ' * 6}{i}." for i in range(4)]
    assert "home" not in main_text(page) and "buy" not in main_text(page)


def test_odd():
    assert main_text("") == "" and main_text(None) == "" and main_text("<article></article>") == ""
    assert main_text("<article><p>1 < 2 &unknown; <p>x</article>") == "1 < 2 &unknown;\nx"
    assert main_text("<article><div class=ad><p>never closed") == "never closed"
    assert main_text("<article><p>" + "long " * 200_000 + "</article>") == ("long " * 200_000).strip()


def test_rows(spark):
    rows = [(1, "u", f"<article>{ARTICLE}</article>", 5), (1, "u", f"<article>{ARTICLE}</article>", 5), (2, None, None, 6), (None, "u", "", 7)]
    got = html_extraction(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "u", WANT, len(WANT))] * 2 + [(2, None, "", 0), (None, "u", "", 0)], key=str)
    assert html_extraction(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_short_ranges_after_the_body():
    body, last = "A long body line. " * 120, "The last paragraph has its own words. " * 8
    links = "".join(f"<div><a href=/{i}>Link number {i}</a></div>" for i in range(5))
    source = "<p>See <a href=/s>the long title of a study that the article rests on</a> too.</p>"
    got = main_text(f"<body>{links}<div>{body}</div>{links}<div>{last}</div>{links}<p>Short end.</p>{source}</body>").split("\n")
    assert got == [body.strip(), last.strip(), "Short end.", "See the long title of a study that the article rests on too."]


@pytest.mark.parametrize("wrap", ["div class='layout has-sidebar'", "div id='content-sidebar-wrap'", "div class=widget", "div id=sidebar-wrap", "form id=aspnet", "div class='elementor-widget x'"])
@pytest.mark.parametrize("tag", ["article", "main"])
def test_wrapped_article(wrap, tag):
    page = f"<body><{wrap}><{tag}>{ARTICLE}</{tag}></{wrap.split()[0]}><section id=comments><article><p>nice</p></article></section><aside><article>teaser</article></aside></body>"
    assert main_text(page) == WANT
    assert main_text(page.replace("<section", "<script>'<main>'</script><section")) == WANT


def test_comments_are_no_article():
    page = f"<body><div>{'long text ' * 20}</div><section class='comments-area'><article>nice</article></section><aside><article>teaser</article></aside><div hidden><article>draft</article></div></body>"
    assert main_text(page) == ("long text " * 20).strip()


def test_layout_names_without_an_article():
    assert main_text(f"<div class='layout no-sidebar'><p>{'long text ' * 20}</p><div class='cookie-notice'>ok?</div></div>") == ("long text " * 20).strip()


def test_implied_ends():
    assert main_text('<article><p>First para.<p class="notice">Notice one.<p>Second para real.<p>Third</article>') == "First para.\nSecond para real.\nThird"
    assert main_text("<article><ul><li class=promo>ad<li>real item one<li>two</ul><p>after list</article>") == "real item one\ntwo\nafter list"
    assert main_text("<article><table><tr><td class=ad>x<td>cell<tr><td>y</table><p>rest</article>") == "cell\ny\nrest"
    assert main_text("<article><dl><dt class=ad>x<dd>one<dt>two</dl>rest</article>") == "one\ntwo\nrest"
    assert main_text("<head><title>t</title><body><article>x</article>") == "x"


def test_names_that_are_no_boilerplate():
    page = "<article><header><h1>Head</h1></header><p class=social>a<p class='ad-free content'>b<p class='related-work'>c<p id=adapter>d</article>"
    assert main_text(page) == "Head\na\nb\nc\nd"


def test_paragraph_of_one_link():
    long = "long text " * 30
    assert main_text(f"<div><p>{long}<p><a href=x>one link</a><p>{long}</div>") == f"{long.strip()}\none link\n{long.strip()}"


def test_text_outside_teasers():
    body = "".join(f"<p>{'many words in the text ' * 30}{i}" for i in range(5))
    page = f"<div class=cards><article>teaser one</article><article>teaser two</article></div><div>{body}</div>"
    assert main_text(page).startswith("many words") and main_text(page).endswith(" 4")


@pytest.mark.parametrize("unit", ["<a x ", '<a x=">"', '<a x="', "<p class=ad>", "<div>", "<p><object><div>", "<li><ul>", "</b>", "<table><tr><td>", "<", "<!--", "<title>", "<x y z="])
def test_linear_in_odd_pages(unit):
    def took(n):
        began = time.process_time()
        main_text(unit * (n // len(unit)) + "> the end</article>")
        return time.process_time() - began

    assert took(400_000) < 8 * took(100_000) + 0.5


def plain_windows(lines, weight, inside, window, share=0.2, outweigh=8):
    """The same decision by looking at each window by itself."""
    n = len(lines)
    total = [sum(weight[max(0, i - window // 2) : i + window // 2 + 1]) for i in range(n)]
    found, i = [], 0
    while i < n:
        if total[i]:
            j = i
            while j < n and total[j]:
                j += 1
            real = [k for k in range(i, j) if weight[k]]
            found.append(range(real[0], real[-1] + 1))
            i = j
        else:
            i += 1
    size = lambda r: sum(weight[k] for k in r)
    marked, rest = [r for r in found if inside[r[0]]], [r for r in found if not inside[r[0]]]
    most = max(map(size, rest), default=0)
    if not marked or most > outweigh * max(250, sum(map(size, marked))):
        marked, begun = [], False
        for r in rest:
            begun = begun or size(r) >= share * most
            marked += [r] if begun else []
    return [lines[k] for r in marked for k in r if lines[k]]


@pytest.mark.parametrize("seed", range(60))
def test_windows_like_brute_force(seed):
    r = random.Random(seed)
    parts = ["<p>a short line", "<div><a href=/x>link</a></div>", "<p>" + "some more words here " * 15, "<div class=ad>buy</div>", "<nav><li>x</nav>", "<article>", "</article>", "<div>bare text</div>", "<p>" + "very long text " * 200, "<main>", "</main>", "<li>item", "<footer>f</footer>"]
    page = "".join(r.choices(parts, k=r.randint(0, 40)))
    for window in (3, 5):
        lines, weight, inside = page_lines(page, window)
        assert chosen(lines, weight, inside, window) == plain_windows(lines, weight.tolist(), inside.tolist(), window)
    r.shuffle(lines)
    weight, inside = np.array([len(x) * r.randint(0, 1) for x in lines], np.int64), np.array([r.random() < 0.3 for _ in lines], bool)
    assert chosen(lines, weight, inside) == plain_windows(lines, weight.tolist(), inside.tolist(), 3)


BODY = "<p>" + "The mayor said on Monday that the new bridge would open in spring. " * 12 + "</p>"
TEXT = BODY[3:-4].strip()
AD = "<div class=ad>Buy now</div>"
MENU = "<nav><ul><li><a href=/>Home</a></li><li><a href=/x>News</a></li></ul></nav>"
FOOT = "<footer>Imprint and contact</footer>"
WRITTEN = {
    # without marks
    f"{MENU}<h1>Bridge opens</h1><p>A short lede.</p>{AD}<div>{BODY}</div>{FOOT}": f"Bridge opens\nA short lede.\n{TEXT}",
    f"{MENU}<div class=story><h1>Bridge opens</h1>{AD}{BODY}</div>{FOOT}": f"Bridge opens\n{TEXT}",
    f"<p>Subscribe now</p>{AD}{BODY}": TEXT,
    f"{BODY}{AD}<p>Last words.</p>": f"{TEXT}\nLast words.",
    f"<div class=site-header><h1>Daily News</h1></div>{BODY}": TEXT,
    f"{BODY}<section class=user-reviews><p>I was there too.</p></section>": TEXT,
    f"{BODY}<p class=promotion>The promotion of the team.</p>": f"{TEXT}\nThe promotion of the team.",
    f"<ul><li><a href=a>One</a><li><a href=b>Two</a></ul>{BODY}": TEXT,
    f"<h1><a href=/>The Paper</a></h1>{AD}{BODY}": TEXT,
    "<div class=ad>Buy</div>": "",
    # with marks
    f"{MENU}<article><h1>Bridge opens</h1>{BODY}</article>{FOOT}": f"Bridge opens\n{TEXT}",
    f"<article><div class=article-banner><h1>Bridge opens</h1></div>{BODY}</article>": f"Bridge opens\n{TEXT}",
    f"<article><div class=banner>Download our app</div>{BODY}</article>": TEXT,
    f"<article><header><h1>Bridge opens</h1></header>{BODY}</article>": f"Bridge opens\n{TEXT}",
    f"<article>{BODY}<p class=promotion>The promotion of the team.</p></article>": f"{TEXT}\nThe promotion of the team.",
    f"<main>{BODY}</main><section class=user-reviews><article><p>I was there too.</p></article></section>": TEXT,
    f"<article>{BODY}<div class=search-box><h2>Search</h2></div></article>": TEXT,
    f"<article>{BODY}<div id=modal><p>Sign up</p></div></article>": TEXT,
    f"<article>{BODY}{AD}<p>Last words.</p></article><aside>Most read</aside>": f"{TEXT}\nLast words.",
    f"<body><main><h1>Bridge</h1><div class=meta>By A. Writer</div>{BODY}<form>Mail<input></form></main>{FOOT}": f"Bridge\nBy A. Writer\n{TEXT}",
}


@pytest.mark.parametrize("page", list(WRITTEN))
def test_pages_with_written_expectations(page):
    assert main_text(page) == WRITTEN[page]
