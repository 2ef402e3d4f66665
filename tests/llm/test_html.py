"""HTML blocks and labels on themes, broken markup and deep pages."""

from __future__ import annotations

import random
import time

import pytest

from sigilo.llm import html_extract as H

WORDS = "the river ran past an old mill where nobody had lived for years and the road beyond it led into hills".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def page(rng, body='class="home"', article="", comments=3, wrapper=None):
    """(html, paragraphs of the article): a page as common themes have it."""
    text = [sentence(rng, rng.randrange(12, 50)) for _ in range(rng.randrange(4, 12))]
    menu = "".join(f'<li><a href="/{k}">{rng.choice(WORDS)}</a></li>' for k in range(6))
    post = f"<article {article}><h1>{sentence(rng, 5)}</h1>" + "".join(f"<p>{t}</p>" for t in text) + "</article>"
    said = '<section class="comments">' + "".join(f'<div class="comment"><p>{sentence(rng, 6)}</p></div>' for _ in range(comments)) + "</section>"
    inner = f'<nav><ul>{menu}</ul></nav>{post}{said}<aside class="sidebar"><p>{sentence(rng, 8)}</p></aside><footer><p>Copyright {sentence(rng, 3)}</p></footer>'
    if wrapper:
        inner = f'<div class="{wrapper}">{inner}</div>'
    return f"<html><head><title>t</title></head><body {body}>{inner}</body></html>", text


THEMES = {
    "plain": {}, "body with a sidebar": {"body": 'class="single-post has-sidebar"'}, "many words": {"body": 'class="page no-footer comments-open has-banner with-search" id="header-on"'},
    "article with comments open": {"article": 'class="post comments-open"'}, "article of a page with share": {"article": 'class="entry related-share has-comments"'},
    "wrapper": {"wrapper": "site has-sidebar menu-open"}, "all": {"body": 'class="has-sidebar"', "article": 'class="post comments-open"', "wrapper": "wrap newsletter-theme"},
}


@pytest.mark.parametrize("theme", ["body with a sidebar", "article with comments open", "all"])
def test_a_theme_does_not_empty_the_page(theme):
    rng = random.Random(9)
    made = [page(rng, **THEMES[theme]) for _ in range(40)]
    found = [H.blocks(h) for h, _ in made]
    for own, (_, text) in zip(found, made, strict=True):
        labels = dict(zip([b[1] for b in own], H.sure_labels(own), strict=True))
        assert all(labels[t] == 1 for t in text) and sum(v == 1 for v in labels.values()) <= len(text) + 1
    model = H.train(found[:20], steps=110, layouts=80)
    for own, (_, text), q in zip(found[20:], made[20:], H.label(model, [H.features(b) for b in found[20:]]), strict=True):
        kept = [b[1] for b, x in zip(own, q, strict=True) if x >= 0.5]
        assert [k for k in kept if k in text] == text and len(kept) <= len(text) + 1


def test_labels_of_every_theme():
    rng = random.Random(12)
    for theme in THEMES.values():
        for h, text in (page(rng, **theme) for _ in range(8)):
            own = H.blocks(h)
            assert [b[1] for b, x in zip(own, H.sure_labels(own), strict=True) if x == 1][1:] == text


def test_the_usual_model_keeps_them_too():
    rng = random.Random(4)
    model = H.train([])
    lost = kept_other = total = 0
    for theme in THEMES.values():
        for h, text in (page(rng, **theme) for _ in range(10)):
            own = H.blocks(h)
            kept = [b[1] for b, x in zip(own, H.label(model, [H.features(own)])[0], strict=True) if x >= 0.5]
            lost += len(set(text) - set(kept))
            kept_other += len(set(kept) - set(text)) - 1
            total += len(text)
    assert lost <= total // 50 and kept_other <= total // 15


def test_unclosed_elements_do_not_swallow_the_page():
    texts = lambda h: [b[1] for b in H.blocks(h)]
    for tag in ("svg", "select", "object", "canvas", "math", "iframe", "noscript", "template"):
        assert texts(f"<p>one</p><{tag}><path><p>two</p><p>three</p>") == ["one", "two", "three"], tag
        assert texts(f"<p>one</p><{tag}><p>no</p></{tag} x><p>three</p>") == ["one", "three"], tag
        assert texts(f"<p>one</p><{tag}>a<{tag}>b</{tag}>c") in (["one", "c"], ["one", "a c"]), tag
    assert texts("<p>one</p><script>let a = '<p>two</p>'") == ["one"] and texts("<p>one</p><script>x</script") == ["one"]


def test_blocks_close_as_they_did():
    texts = lambda h: [b[1] for b in H.blocks(h)]
    assert texts("<ul><li>a<li>b<ul><li>c</ul>d</ul>e") == ["a", "b", "c", "d", "e"]
    tags = lambda h: [" ".join(n.tag for n in b[0].up()).strip() for b in H.blocks(h)]
    assert tags("<div><p>a<p>b<div>c</div></div>d") == ["p div", "p div", "div div", ""]
    assert tags("<p>a<table><tr><td>b<td>c</table>") == ["p", "td tr table", "td tr table"]
    assert tags("<b>a<div>b</b>c</div>") == ["b", "div b", "div b"] or tags("<b>a<div>b</b>c</div>") == ["b", "div b"]
    assert tags("</p></x>a<i>b</i>") == [""]


@pytest.mark.parametrize("unit", ["<div>x ", "<div>", "<b>y", "<h1>z", "<a href=x>w", "<p>q<span>", "<li>", "<div class=a><svg>"])
def test_time_is_linear_in_depth(unit):
    def took(n, tail):
        t = time.perf_counter()
        own = H.blocks(unit * n + tail * n)
        H.features(own)
        return time.perf_counter() - t

    for tail in ("", "</foo>", "</b>", "</svg"):
        took(2000, tail)
        few, many = took(5000, tail), took(20_000, tail)
        assert many < max(16 * few, 4.0), (tail, few, many)
