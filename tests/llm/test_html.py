"""Main text in containers whose names look like boilerplate."""

import pytest

from episodica.llm import html

TEXT = "The article goes on for a while, so that there is some text in it to be found."
SHAPES = [f'<div class="{name}">%s</div>' for name in ("layout has-sidebar", "no-sidebar", "with-banner", "menu-open", "page-widget")] + ["<form>%s</form>"]


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("inner", ["<article><p>%s</p></article>", "<main><p>%s</p></main>", "<div><p>%s</p></div>"])
def test_named_containers(shape, inner):
    page = "<nav><a href=x>Home</a></nav>" + shape % (inner % TEXT) + "<div class=cookie>Cookies.</div><footer>End</footer>"
    assert html.extract(f"<html><body>{page}</body></html>") == TEXT


@pytest.mark.parametrize("around", ["<div class=comments>%s</div>", "<aside>%s</aside>", "<footer>%s</footer>", "<div class='related'>%s</div>", "<div hidden>%s</div>"])
def test_foreign_articles_stay_out(around):
    page = f"<article><p>{TEXT}</p></article>" + around % f"<article><p>Other. {TEXT * 3}</p></article>"
    assert html.extract(page) == TEXT


NAMES = ["social-issues", "widget-text", "comment-on-the-budget", "no-share", "adverbs", "notice-of-intent", "cookies-recipe", "user-info", "readers"]


@pytest.mark.parametrize("name", NAMES)
def test_names_with_words_of_their_own_stay(name):
    """Only names made of boilerplate and layout words alone mark boilerplate."""
    page = f"<article><p>{TEXT}</p><p class='{name}'>Short one.</p><div id={name}><p>Another.</p></div></article><div class=share-buttons>Tell it</div>"
    assert html.extract(page) == f"{TEXT}\n\nShort one.\n\nAnother."


@pytest.mark.parametrize("name", ["share-buttons", "related-posts", "newsletter_signup", "ad-slot-3", "cookie-consent", "site-footer", "comments-area", "user-comments", "google-ads", "disqus_thread", "alert alert-info"])
def test_names_of_boilerplate_alone_go(name):
    assert html.extract(f"<article><p>{TEXT}</p><div class='x {name}'>Not of the article at all, but long enough to be taken for it.</div></article>") == TEXT


def test_other_page_shapes():
    """Expected texts written by hand, for pages unlike the test data's template."""
    link = f"<p><a href=x>{TEXT}</a></p>"
    assert html.extract(f"<body><ul><li><a href=a>Home</a><li><a href=b>News</a></ul><div>{link}<p>{TEXT}</p></div></body>") == f"{TEXT}\n\n{TEXT}"
    assert html.extract(f"<article><p>{TEXT}</p><math><mi>x</mi><mo>=</mo><mn>1</mn></math></article>") == f"{TEXT}\n\nx=1"
    parts = "".join(f"<div class=row><p>{t}</p></div>" for t in (TEXT, "Short.", TEXT))
    assert html.extract(f"<body><div class=menu><a href=a>Menu</a></div><div id=main>{parts}</div></body>") == f"{TEXT}\n\nShort.\n\n{TEXT}"
    table = "<table><tr><td>One<td>Two</article></table>"
    assert html.extract(f"<article><h1>Top</h1><p>{TEXT}{table}<p>Last</article><p>Out</p>") == f"Top\n\n{TEXT}\n\nOne\n\nTwo\n\nLast"
    assert html.extract(f"<main role=main><p>{TEXT}</main><div role=complementary><p>{TEXT}</div>") == TEXT
    assert html.extract("<form action=x><div><p>" + TEXT + "</p><input name=q></div></form>") == TEXT


@pytest.mark.parametrize("piece", ["<span></b>", "<div></p>", "<article></i>", "<a></table>", "</span>", "<p><b></article>"])
def test_events_cost_the_same_however_many_are_open(piece):
    """Twice the page takes some twice the time: no event looks through all open elements."""
    import time

    def seconds(n):
        began = time.process_time()
        html.extract(f"<article><i>{piece * n}{TEXT}")
        return time.process_time() - began

    seconds(1000)
    short, long = min(seconds(4000) for _ in range(3)), min(seconds(32_000) for _ in range(2))
    assert long < 20 * short + 0.2


def test_pages_of_random_templates():
    """Articles put into random surroundings come out whole and alone."""
    import random

    rng = random.Random(4)
    for _ in range(200):
        blocks = [" ".join(rng.choice(["word", "other", "A", "b,", "x."]) for _ in range(rng.choice([2, 12, 60, 200]))) for _ in range(rng.randrange(2, 9))]
        body = "".join(f"<{t}>{b}</{t}>" for b in blocks for t in [rng.choice(["p", "h2", "blockquote", "p"])])
        tag = rng.choice(["article", "main"])
        links = "".join(f"<li><a href=x>Place {k}</a></li>" for k in range(rng.randrange(1, 9)))
        before = rng.choice([f"<nav><ul>{links}</ul></nav>", f"<header><h1>Site</h1><ul>{links}</ul></header>", f"<div class='top-nav'><ul>{links}</ul></div>"])
        after = rng.choice(["<footer><p>All rights, and some more text to be longer than a line.</p></footer>", "<aside><p>Read this as well, it is about something else altogether.</p></aside>", "<section class=comments><p>First! I liked this very much, thank you for it.</p></section>"])
        wrap = rng.choice(["%s", "<div class='site no-sidebar'>%s</div>", "<form>%s</form>", "<div id=page><div class=wrapper>%s</div></div>"])
        page = f"<html><body>{wrap % f'{before}<{tag}>{body}</{tag}>{after}'}<script>var a='<p>no</p>'</script></body></html>"
        assert html.extract(page) == "\n\n".join(blocks)


PROSE = [f"Sentence number {k} of the article says something of its own, and then a bit more of it." for k in range(20)]
BODY = "".join(f"<p>{p}</p>" for p in PROSE)
ALL = "\n\n".join(PROSE)


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<article>short teaser</article><div>{BODY}</div>", ALL),
        (f"<div>{BODY}</div><article><h2>Read next</h2></article><article>Or this</article>", ALL),
        (f"<nav><a href=a>Home</a> <a href=b>News</a>{BODY}", ALL),
        (f"<html><body><nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul><div>{BODY}</div><footer>The end</footer></body></html>", ALL),
        (f"<div class='article-body'><article>{BODY}</article><p>After it all.</p></div>", f"{ALL}\n\nAfter it all."),
        (f"<div class='post'><p>{PROSE[0]}</p></div><div class=posts-nav><a href=x>Older</a></div>", PROSE[0]),
        (f"<div><p>{PROSE[0]}</p><ul><li><a href=x>One linked item</a></li><li>Two</li></ul><p>{PROSE[1]}</p></div>", f"{PROSE[0]}\n\nOne linked item\n\nTwo\n\n{PROSE[1]}"),
        (f"<div class='cookie-consent-bar'>{BODY}</div><div><p>{PROSE[0]}</p><p>{PROSE[1]}</p></div>", f"{PROSE[0]}\n\n{PROSE[1]}"),
        (f"<article><p>{PROSE[0]}</p></article><section class='user-discussion'>{BODY}</section>", PROSE[0]),
        (f"<article><p>{PROSE[0]}</p></article><article><p>{PROSE[1]}</p></article>", f"{PROSE[0]}\n\n{PROSE[1]}"),
        (f"<aside><p>{PROSE[3]}</p></aside><nav><a href=a>Home</a></nav><div>{BODY}</div>", ALL),
    ],
)
def test_misleading_pages(page, want):
    """Teasers, several articles, menus left open, text behind an article, linked items, long notices and comments."""
    assert html.extract(page) == want


def test_named_boxes_cost_alike():
    """Twice the notices take some twice the time."""
    import time

    def seconds(n):
        began = time.process_time()
        html.extract("<article><p>Text of it.</p></article>" + "<div class=notice>Note this.</div>" * n)
        return time.process_time() - began

    seconds(500)
    short, long = min(seconds(2000) for _ in range(3)), seconds(16_000)
    assert long < 16 * short + 0.2


def test_templates_without_articles():
    """Prose in plain boxes among menus, teasers and notices comes out whole and alone."""
    import random

    rng = random.Random(9)
    for _ in range(150):
        blocks = rng.sample(PROSE, rng.randrange(4, 12))
        for k in rng.sample(range(1, len(blocks) - 1), 1):
            blocks.insert(k, "Short one.")
        body = "".join(f"<p>{b}</p>" for b in blocks)
        links = "".join(f"<li><a href=x>Place {k}</a></li>" for k in range(rng.randrange(2, 9)))
        before = rng.choice([f"<nav><ul>{links}</ul></nav>", f"<header><ul>{links}</ul></header>", f"<div class=menu><ul>{links}</ul></div>", "<article>Teaser</article>"])
        after = rng.choice([f"<aside>{BODY}</aside>", f"<div class='comments'>{BODY}</div>", f"<footer>{PROSE[0]}</footer>", f"<div id=cookie-notice>{BODY}</div>"])
        page = f"<html><body>{before}{rng.choice(['<div>%s</div>', '<div id=content><div>%s</div></div>', '<section>%s</section>']) % body}{after}</body></html>"
        assert html.extract(page) == "\n\n".join(blocks)
