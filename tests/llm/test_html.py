import itertools

from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import html_text
from lectern.llm.html_text import best_run, main_text

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{margin:0}</style><script>var t="</p><p>no";</script></head><body>
<nav><ul><li><a href="/a">Menu one</a></li><li><a href="/b">Menu two</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy this very nice and long thing now</div>
<article><h1>Head &amp; tail</h1><p><b>First   part,<br>second&nbsp;part</b> and <i>it</i>alics &lt;p&gt;.<p>Unclosed
 paragraph</p><aside>Sidebar in the middle with rather many words that would break a run if they counted for much</aside><div class="cookieNotice">Notice</div>
<form>Sign <input name=x>up</form><p>Last words.</p><section id="comments"><p>A reader says a lot of things here</p></section></article><footer>&copy; All</footer></body></html>"""


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=12))
def test_linear_scan_equals_all_runs(xs):
    first, last = best_run(xs)
    best = max([0, *(sum(xs[a:b]) for a, b in itertools.combinations(range(len(xs) + 1), 2))])
    assert sum(xs[first:last]) == best


def test_scores_have_the_expected_signs():
    s = html_text.SCORES
    for place in ("open", "outside"):
        assert s["tag", place] < 0 and s["link", place] < 0 and s["furniture", place] < 0
    assert s["word", "inside"] > 0 and s["word", "open"] > 0 > s["word", "outside"]
    assert s["tag", "inside"] == s["furniture", "inside"] == 0  # what lies in the article doesn't break it


def test_article_of_a_page():
    assert main_text(PAGE) == "Head & tail\nFirst part, second part and italics <p>.\nUnclosed paragraph\nLast words."


def test_labelled_pages_give_their_articles():
    import re

    for page in html_text.LABELLED:
        want = [" ".join(re.sub("<[^>]*>", "", x).split()) for x in re.findall(r"{{(.*?)}}", page)]
        assert main_text(page.replace("{{", "").replace("}}", "")) == "\n".join(want)


def test_odd_pages():
    assert main_text(None) == "" and main_text("") == "" and main_text("<nav><a>x</a></nav><script>1") == ""
    assert main_text("just text") == "just text"
    assert main_text("<body><p>Cut off here &am") == "Cut off here &am"
    assert main_text("<body><p>Cut off here &amp") == "Cut off here &"
    assert main_text("<body><p>Cut off here</") == "Cut off here"
    assert main_text("<body><p>Cut off here<a href='x") == "Cut off here"
    assert main_text("<p>1 < 2 and 3 > 2</p>") == "1 < 2 and 3 > 2"
    assert main_text("<!-- never closed <p>x</p>") == ""
    assert main_text("<p>" + "long words " * 200_000).count("long") == 200_000
    assert main_text("<p>" + "<b>" * 20_000 + "deep" + "</b>" * 20_000) == "deep"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("<>/!-\"'= apdivnscript&;x"), max_size=80))
def test_any_input_gives_some_text(x):
    assert isinstance(main_text(x), str)


def test_table(spark):
    rows = [(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (2, None, None, "t"), (None, "v", "", "t")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 4 and all(g.n_chars == len(g.text) for g in got)
    assert [g.text.count("\n") for g in got if g.page_id == 1] == [3, 3]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


BODY = "<h1>Head of it</h1><p>The first part of the article says what it is about.</p><p>The second part goes on with more words of the kind.</p>"
WANT = "Head of it\nThe first part of the article says what it is about.\nThe second part goes on with more words of the kind."


def test_names_that_are_no_furniture():
    for page in (
        f"<html class='no-js menu'><body class='has-sidebar'>{BODY}</body></html>",
        f"<body class='admin-bar sidebar'>{BODY}</body>",
        f"<body><div id=page class='with-sidebar'>{BODY}</div><footer>All rights</footer></body>",
        f"<body><div id=page class='sidebar'><div class=widget>{BODY}</div><div class=sidebar><a href=x>Most read</a></div></div></body>",
        f"<body><article class='post comments-open'>{BODY}</article></body>",
        f"<body><main role=search id=search>{BODY}</main></body>",
        f"<body><div data-role=menu>{BODY}</div></body>",
    ):
        assert main_text(page) == WANT, page
    assert main_text(f"<article>{BODY}<section id='search'><h2 id='related-work'>Related work</h2><p>Some words of this section.</p></section><h2 id=search>Search</h2><p>Last.</p></article>") == WANT + "\nRelated work\nSome words of this section.\nSearch\nLast."


def test_names_that_are_furniture():
    for tag in ("div class=site-header", "div class='x main-nav'", "section id=comments", "div id=RelatedPosts", "ul role=navigation", "p class=ad"):
        name = tag.split()[0]
        assert main_text(f"<body><article>{BODY}<{tag}><b>Not this</b></{name}></article></body>") == WANT, tag
    long = "<p>Readers say a lot of things that are not the article's.</p>" * 20
    assert main_text(f"<body><article>{BODY}<div id=comments>{long}</div></article></body>") == WANT
    assert main_text("<body><div class=menu><a href=a>One</a> <a href=b>Two</a></div></body>") == ""


def test_furniture_within_a_line():
    assert main_text("<article><p>A paragraph with <span class='notice'>a notice</span> in it.</p><p>Second.</p></article>") == "A paragraph with in it.\nSecond."
    assert main_text("<article><p>Code:</p><pre>x = 1 <span class='hljs-comment'># one</span> <span class='token comment'># two</span></pre></article>") == "Code:\nx = 1 # one # two"


def test_holders_keep_what_lies_in_and_around_them():
    title, lead, long = "Title of it", "The lead tells in a few words what comes.", "The body of the article is longer than all that stands before it, and says a lot more than the lead did."
    assert main_text(f"<body><main><h1>{title}</h1><p>{lead}</p><article><p>{long}</p></article></main></body>") == f"{title}\n{lead}\n{long}"
    assert main_text(f"<body><article><p>{long}</p></article><article><p>{lead}</p></article></body>") == f"{long}\n{lead}"
    assert main_text(f"<body><article><h1>{title}</h1><p>{long}</p><article><p>{lead}</p></article><p>{long}</p></article></body>") == f"{title}\n{long}\n{lead}\n{long}"
    assert main_text(f"<body><nav>Menu</nav><main><p>{lead}</p><aside>Not this</aside><article><p>{long}</p></article></main><footer>End</footer></body>") == f"{lead}\n{long}"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["<p>Some plain words here</p>", "<div><a href=x>A link</a></div>", "<div class=ad>An advert with words</div>", "<article><p>Inside it</p></article>", "<nav><a href=y>Menu</a></nav>", "<aside>Not this one</aside>", "<hr>", "<main><h1>T</h1>", "</main>", "<h2>Head</h2>"]), max_size=9))
def test_the_region_is_the_best_of_all_runs(parts):
    page = html_text.Page("<body>" + "".join(parts))
    places = page.places()
    line = []
    for words, kind, held, tags in page.blocks:
        line += [sum(html_text.SCORES["tag", places[k]] * n for k, n in enumerate(tags)), html_text.SCORES[kind, places[held]] * len(words.split())]
    runs = [(sum(line[a:b]), b - a, -a, a, b) for a, b in itertools.combinations(range(len(line) + 1), 2)]
    best = max(runs, default=(0,), key=lambda r: (round(r[0], 9), r[1], r[2]))
    a, b = best[3:] if best[0] > 1e-9 else (0, 0)
    want = [x[0] for i, x in enumerate(page.blocks) if a <= 2 * i + 1 < b and x[1] != "furniture"]
    assert page.wrappers() or main_text("<body>" + "".join(parts)) == "\n".join(want)


def test_class_names_of_common_blogs():
    for page in (
        f"<body class='no-sidebar comments-open'>{BODY}</body>",
        f"<body><div class='article-header'>{BODY}</div></body>",
        f"<body><div class='site has-menu'>{BODY}</div></body>",
        f"<body><main class='with-sidebar'>{BODY}</main></body>",
        f"<body><section class='related-research'>{BODY}</section></body>",
    ):
        assert main_text(page) == WANT, page
    assert main_text(f"<body><header>Site name</header><article><header><h1>Own title</h1></header>{BODY}</article></body>") == "Own title\n" + WANT


#: Pages of layouts that the labelled ones don't have, with their articles.
HELD_OUT = (
    ("<body class='home blog'><div id=page class=site><header id=masthead class=site-header><div class=site-branding><a href=/>Notes</a></div><nav id=site-navigation><ul><li><a href=/a>About</a></li></ul></nav></header><div id=content class=site-content><main id=main class=site-main><article id=post-7 class='post type-post'><header class=entry-header><h1 class=entry-title>Bees in winter</h1></header><div class=entry-content><p>They keep warm in a ball.</p><div class=sharedaddy><h3>Share this</h3></div><p>The queen sits in the middle.</p></div><footer class=entry-footer><a href=/c>Garden</a></footer></article><div id=comments class=comments-area><h2>Two thoughts</h2><p>Mine died last year.</p></div></main></div><footer class=site-footer>Proudly made</footer></div></body>", "Bees in winter\nThey keep warm in a ball.\nThe queen sits in the middle."),
    ("<body><table><tr><td><a href=1>Index</a></td><td><a href=2>Next</a></td></tr></table><center><h1>Of maps</h1></center><p>Old maps put east at the top.<p>Sailors drew them by hand.<hr><a href=3>Index</a></body>", "Of maps\nOld maps put east at the top.\nSailors drew them by hand."),
    ("<body><div class=navbar><a href=/>Docs</a> <a href=/api>Interface</a></div><div class=sidebar><ul><li><a href=/i>Install</a></li><li><a href=/u>Use</a></li></ul></div><main><h1>Install</h1><p>Run this:</p><pre><code>make <span class=comment># all</span></code></pre><ul><li>Needs a compiler</li></ul></main><div class=pagination><a href=/u>Next: Use</a></div></body>", "Install\nRun this:\nmake # all\nNeeds a compiler"),
    ("<body><div id=cookie-banner>We keep cookies <button>Fine</button></div><nav><a href=/w>World</a></nav><article><h1>Storm hits coast</h1><p class=byline>By one of us</p><p>Waves broke over the wall.</p><aside class=related><a href=/x>Last storm</a></aside><p>No one was hurt.</p></article><section class=newsletter><form>Mail <input></form></section><footer>All rights</footer></body>", "Storm hits coast\nBy one of us\nWaves broke over the wall.\nNo one was hurt."),
    ("<body><div><span><a href=/>Home</a></span></div><div><h2>Short tale</h2><div>There was a fox.<br>It slept.</div><blockquote>Who is there?</blockquote></div><div class=footer-links><a href=/k>Contact</a></div></body>", "Short tale\nThere was a fox. It slept.\nWho is there?"),
)


def test_words_of_held_out_pages():
    from collections import Counter

    hit = got = want = 0
    for page, text in HELD_OUT:
        a, b = Counter(main_text(page).split()), Counter(text.split())
        hit, got, want = hit + sum((a & b).values()), got + sum(a.values()), want + sum(b.values())
    assert 2 * hit / (got + want) > 0.95


def test_deep_nesting_takes_time_in_proportion():
    import time

    for tag in ("div", "div class=menu", "section class='widget x'"):
        began = time.process_time()
        main_text(f"<{tag}>" * 40_000 + "three plain words" + f"</{tag.split()[0]}>" * 40_000)
        assert time.process_time() - began < 10


def test_elements_around_a_whole_page_are_spared():
    body = "<div id=content><h1>T one</h1><p>Para one of text.</p><p>Para two of text.</p></div>"
    for element in ("form id=aspnetForm", "aside", "header", "fieldset"):
        assert main_text(f"<body><{element}>{body}</{element.split()[0]}></body>") == "T one\nPara one of text.\nPara two of text."
    kept = main_text(f"<body>{body}<form><p>Send us a line.</p><p>Or two.</p></form></body>")
    assert "Send" not in kept and kept.startswith("T one")
    assert main_text("<body><article><h1>A</h1><p>Few words.</p><aside><p>Many more words stand beside it than in it.</p><p>And more of them still.</p></aside></article></body>") == "A\nFew words."


def test_linked_paragraphs_are_text():
    page = "<body><h1>Recipes</h1><p>Try <a href=x>this soup with beans and more</a>.</p><p><a href=y>Bread of rye</a></p><p>Enjoy.</p></body>"
    assert main_text(page) == "Recipes\nTry this soup with beans and more.\nBread of rye\nEnjoy."
    assert main_text("<body><div class=gdpr>We keep what you type</div><article><p>Text.</p></article><div class=colophon>Set in lead</div></body>") == "Text."


def test_unfinished_tags_take_linear_time():
    import time

    for part in ("<x", '<a b="', "<!--", "<![CDATA[", '<a b=">', "</", "<x y='"):
        began = time.process_time()
        main_text(part * 60_000)
        assert time.process_time() - began < 5, part
