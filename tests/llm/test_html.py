"""Main text by density: density decides, names only weigh, and broken pages take linear time."""

import math
import time

import pytest

from fleetscope.llm import html

STORY = "<h1>Title here</h1>" + "".join(f"<p>{f'Paragraph {i} tells more of the long story. ' * 12}</p>" for i in range(5)) + "<p>End.</p>"
WANT = html.main_text(f"<article>{STORY}</article>")
MENU = "<ul>" + "".join(f"<li><a href=/{i}>Menu entry {i}</a></li>" for i in range(30)) + "</ul>"


def test_density_decides(monkeypatch):
    page = f"<body><div>{MENU}</div><div><div>{STORY}</div></div><div>{MENU}</div><nav>{MENU}</nav></body>"
    named = f"<body><nav>{MENU}</nav><div class=ad>Buy this now</div><article>{STORY}</article><footer>Imprint</footer></body>"
    assert html.main_text(page) == html.main_text(named) == WANT and "Paragraph 4" in WANT

    def constant(root):
        nodes = found(root)
        for node in nodes:
            node.density = node.sum = 1.0
        return nodes

    found = html.densities
    monkeypatch.setattr(html, "densities", constant)
    assert html.main_text(page) != WANT and html.main_text(named) != WANT


@pytest.mark.parametrize("name", [
    "post-comments", "user-comments", "comment-thread", "ad-slot", "ad-unit", "google-ads", "related-posts", "share-this", "author-bio", "subscribe-form", "comments", "sidebar-left",
])
def test_names_weigh_down_inside_an_article(name):
    apart = f'<div class="{name}"><p>{"Not part of it at all. " * 20}</p></div>'
    for where in (f"<article>{STORY}{apart}</article>", f"<article>{STORY}</article>{apart}", f"<div>{STORY}{apart}</div>", f"<article>{apart}{STORY}</article>"):
        assert html.main_text(f"<body><nav>{MENU}</nav>{where}</body>") == WANT, where


def test_teasers_beside_the_article_go():
    teasers = "".join(f"<article><h2><a href=/{i}>Another story {i}</a></h2><p><a href=/{i}>Read on</a></p></article>" for i in range(4))
    assert html.main_text(f"<body><main><article>{STORY}</article>{teasers}</main></body>") == WANT
    assert html.main_text(f"<body><header>Site</header><main><h2>Not kept?</h2><article>{STORY}</article></main></body>").endswith(WANT)


def plain_densities(root):
    """The formula on sets of characters and tags, one node at a time."""
    def below(node):
        return [d for p in node.parts if isinstance(p, html.Node) and not p.silent for d in [p, *below(p)]]

    def chars(node):
        own = sum(len("".join(p.split())) for p in node.parts if isinstance(p, str))
        return own + sum(chars(p) for p in node.parts if isinstance(p, html.Node) and not p.silent)

    def links(node):
        return chars(node) if node.tag == "a" else sum(links(p) for p in node.parts if isinstance(p, html.Node) and not p.silent)

    share, found = links(root) / chars(root), {}
    for node in [root, *below(root)]:
        c, lc, t, lt = chars(node), links(node), len(below(node)), sum(d.tag == "a" for d in below(node))
        weight, up = 1.0, node
        while up is not None:
            weight, up = weight * (html._WEIGHT if up.marked else 1), up.above
        value = c / max(t, 1) * math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1)) / math.log(1 + math.log(c / max(c - lc, 1) * lc + share * c + math.e)) if c else 0
        found[node] = value * weight
    return found


def test_densities_equal_the_plain_formula():
    root = html.parse(f"<body><div>{MENU}</div><div class=ad>x y<a>z</a></div><section><h2>A b</h2><p>One <i>two</i> <a href=/>three</a></p><ul><li>a<li>b</ul></section><script>var</script></body>")
    want = plain_densities(root)
    nodes = html.densities(root)
    assert set(nodes) == set(want)
    for node in nodes:
        assert node.density == pytest.approx(want[node], rel=1e-12)
        assert node.sum == pytest.approx(sum(want[p] for p in node.parts if isinstance(p, html.Node) and not p.silent), rel=1e-12)


@pytest.mark.parametrize("page", [
    "<a " * 300000, "<div>" * 30000 + "</p>" * 60000, "<b>" * 60000 + "<hr>" * 60000, "<header>" * 60000, '<a "' * 200000 + ">", "<a '\"> " * 60000, "<b>" * 60000 + "<td>" * 60000,
    "<script>" + "</script " * 100000, "<li><table>" + "<b>" * 40000 + "<li>" * 40000, "<!" * 300000, "<a " * 100000 + '">>', "<div><p>text text</p>" * 20000,
], ids=lambda p: p[:12])
def test_broken_pages_take_linear_time(page):
    start = time.perf_counter()
    html.main_text(page)
    assert time.perf_counter() - start < 10


def test_ends_within_a_tag_and_odd_marks():
    assert html.main_text("a < b and c <3 <p>d</p> <") == "a < b and c <3 d <"
    assert html.main_text("<p title='x>y'>a</p><p title=\"it's\">b</p><p title=it's>c</p>") == "a b c"
    assert html.main_text("<p>a</p><p class='open") == "a" and html.main_text("<p>a<!-- open <p>b") == "a"
