"""Which parts of a page join its article and which leave, by names and by densities."""

from __future__ import annotations

import math
import random

import pytest

from trailspark.llm import htmltext

PARAGRAPHS = [f"Paragraph {k} tells of a valley, its river and the way along it, in words enough to count." for k in range(6)]
BODY = "".join(f"<p>{x}</p>" for x in PARAGRAPHS)
TEXT = "\n\n".join(PARAGRAPHS)
REMARKS = "<div class='remarks'>" + "".join(f"<p>Reader {k} liked it, and says so here at some length.</p>" for k in range(4)) + "</div>"


@pytest.mark.parametrize("name", "content-with-sidebar page-content-right-sidebar single-post-sidebar-none layout-nav-left main-menu-open promo login-off sidebar menu comments-open has-comments site__sidebar ad".split() + ["site login-off"])
def test_wrappers_keep_the_article_whatever_their_names(name):
    assert htmltext.main_text(f"<body><div class='{name}'><nav><a href=/>Home</a></nav><div class=text>{BODY}</div></div>{REMARKS}</body>") == TEXT
    assert htmltext.main_text(f"<body><div class='{name}'><article>{BODY}</article>{REMARKS}</div></body>") == TEXT
    assert htmltext.main_text(f"<body><article class='post type-post {name}'>{BODY}</article>{REMARKS}</body>") == TEXT


@pytest.mark.parametrize("name", "ad-hoc cookie-recipes banner-quote login-steps menu-name popup-windows related tags".split())
def test_parts_of_an_article_stay_whatever_their_names(name):
    part = f"<div class='{name}'><p>This part belongs to it.</p></div>"
    assert htmltext.main_text(f"<article>{BODY}{part}{BODY}</article>") == f"{TEXT}\n\nThis part belongs to it.\n\n{TEXT}"


@pytest.mark.parametrize("name", "ad ad-slot-2 sidebar left-sidebar comments comment-list post-comments cookie-notice newsletter-signup remarks discussion responses reader-comments".split())
def test_what_is_named_whole_leaves(name):
    part = f"<div class='{name}'><p>This part is something else, of some length.</p><p>And so is this one.</p></div>"
    for page in (f"<article>{BODY}{part}</article>", f"<main><div>{BODY}</div>{part}</main>", f"<div>{BODY}</div>{part}", f"<div>{part}{BODY}</div>"):
        assert htmltext.main_text(page) == TEXT


def test_many_comments_do_not_outweigh_the_article():
    comments = "<div id=comments>" + "".join(f"<article class='comment'><p>{'A long remark by a reader of this page. ' * 4}</p></article>" for _ in range(30)) + "</div>"
    assert htmltext.main_text(f"<div><div class=text>{BODY}</div>{comments}</div>") == TEXT
    assert htmltext.main_text(f"<main><article>{BODY}</article>{comments}</main>") == TEXT


def test_a_papers_discussion_stays():
    chapter = lambda name: f"<section id='{name}'><h2>{name.title()}</h2><p>What the {name} has to say about it all.</p></section>"
    names = ["introduction", "methods", "results", "discussion", "conclusions"]
    assert htmltext.main_text("<article>" + "".join(map(chapter, names)) + "</article>") == "\n\n".join(f"{x.title()}\n\nWhat the {x} has to say about it all." for x in names)


@pytest.mark.parametrize(
    "page",
    [
        "<h1>T</h1><div>{}</div>", "<div><h1>T</h1><div>{}</div></div>", "<div class=wrap><div class=head><h1>T</h1></div><div class=body>{}</div></div>", "<main><h1>T</h1><div>{}</div></main>",
        "<div class=post><header><h1>T</h1><span>by me</span></header><div>{}</div></div>", "<header><h1>Site</h1></header><article><h1>T</h1>{}</article>", "<nav><a>x</a></nav><h1>T</h1><article>{}</article><footer>f</footer>",
    ],
)
def test_the_headline_comes_with_the_article(page):
    assert htmltext.main_text(f"<body>{page.format(BODY)}</body>") == "T\n\n" + TEXT


def test_short_parts_between_and_beside_stay():
    assert htmltext.main_text(f"<div id=c><div class=s>{BODY}</div><div class=s><p>Short.</p></div><div class=s>{BODY}</div><p>The end.</p></div>") == f"{TEXT}\n\nShort.\n\n{TEXT}\n\nThe end."


def test_joining_equals_its_definition():
    """Random pages of unnamed blocks: below the body, blocks at least as dense as the least dense node around the densest subtree join."""
    rng = random.Random(4)
    for _ in range(200):
        sizes = [[rng.randint(1, 60) for _ in range(rng.randint(1, 6))] for _ in range(rng.randint(1, 7))]
        page = "".join("<div>" + "".join(f"<p>{'w' * n}</p>" for n in part) + "</div>" for part in sizes)
        tree = htmltext.Tree()
        tree.feed(page)
        tree.close()
        kept = htmltext.blocks(tree.root)
        dense = lambda chars, tags: chars / max(1, tags) * math.log(max(1.0001, chars * max(1, tags)), math.log(1 + math.e))
        total = [sum(dense(n, 0) for n in part) for part in sizes]
        body = sum(dense(sum(part), len(part)) for part in sizes)
        if body >= max(total):
            expected = range(len(sizes))
        else:
            best = total.index(max(total))
            least = min(dense(sum(sizes[best]), len(sizes[best])), dense(sum(map(sum, sizes)), sum(1 + len(x) for x in sizes)))
            whole = [i for i, part in enumerate(sizes) if i == best or dense(sum(part), len(part)) >= least]
            expected = None if any(i not in whole and any(dense(n, 0) >= least for n in part) for i, part in enumerate(sizes)) else range(whole[0], whole[-1] + 1)
        if expected is not None:
            assert kept == ["w" * n for i in expected for n in sizes[i]]


def test_long_pages_of_many_links_take_linear_time():
    links = "".join(f"<li><a href=/{k}>link {k}</a></li>" for k in range(100_000))
    assert htmltext.main_text(f"<ul>{links}</ul><article>{BODY}</article><div><ul>{links}</ul></div>") == TEXT
