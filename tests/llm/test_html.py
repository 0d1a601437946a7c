"""Composite text density against brute force, and pages that names and tags alone would get wrong."""

import math

import pytest

from lodestrata.llm import html_text as H

LINKS = "".join(f"<li><a href='/{i}'>Link number {i}</a></li>" for i in range(30))
STORY = "".join(f"<p>This is paragraph {i} of the story, and it has quite a few words in it.</p>" for i in range(6))
PLAIN = " ".join(f"This is paragraph {i} of the story, and it has quite a few words in it." for i in range(6))


def test_density_decides(monkeypatch):
    page = f"<body><div><ul>{LINKS}</ul></div><div><div>{STORY}</div></div><div><a href=a>a</a> <a href=b>b</a></div></body>"
    assert H.main_text(page) == PLAIN
    monkeypatch.setattr(H, "choose", lambda body: [body])
    assert H.main_text(page) != PLAIN and "Link number 3" in H.main_text(page)


def test_two_articles_are_both_kept():
    second = "<p>The second story is short, but it is a story.</p><p>It ends here.</p>"
    page = f"<body><nav><ul>{LINKS}</ul></nav><article>{STORY}</article><article>{second}</article><footer>End of page</footer></body>"
    assert H.main_text(page) == f"{PLAIN} The second story is short, but it is a story. It ends here."


def test_names_inside_an_article():
    page = f"<body><article>{STORY}<div class='related-work'><p>Related work is part of it.</p></div><p id='notice'>This paragraph too.</p><div class='notice'>We use cookies</div></article></body>"
    assert H.main_text(page) == f"{PLAIN} Related work is part of it. This paragraph too."


def test_a_main_with_lists_of_links_gives_the_story_and_its_heading():
    page = f"<body><main><h1>The title</h1><div>{STORY}</div><div><ul>{LINKS}</ul></div></main></body>"
    assert H.main_text(page) == f"The title {PLAIN}"


def naive(node, kind):
    """Characters, tags, linked characters and links below a node, each by walking all of it."""
    if node.__class__ is str:
        return len("".join(node.split())) if kind == "chars" else 0
    total = 0
    for c in node.children:
        tag = c.__class__ is not str
        if kind == "linked" and tag and c.tag == "a":
            total += naive(c, "chars")
        else:
            total += naive(c, kind)
        total += tag and (kind == "tags" or kind == "links" and c.tag == "a")
    return total


def naive_density(node, body):
    chars, tags, linked, links = (naive(node, k) for k in ("chars", "tags", "linked", "links"))
    if not naive(body, "linked") or not chars:
        return chars / max(1, tags)
    base = math.log(chars / max(1, chars - linked) * linked + naive(body, "linked") / naive(body, "chars") * chars + math.e)
    return chars / max(1, tags) * max(0.0, math.log(max(1.0, chars / max(1, linked) * max(1, tags) / max(1, links))) / math.log(base))


def nodes(node):
    yield node
    for c in node.children:
        if c.__class__ is not str and not c.cut:
            yield from nodes(c)


def text_of(node):
    if node.__class__ is str:
        return "".join(node.split())
    return "" if node.cut else "".join(map(text_of, node.children))


def naive_text(page):
    """The chosen text without white space, by the definition."""
    body = next((n for n in nodes(H.parse(page)) if n.tag == "body"), None) or H.parse(page)
    density = lambda n: naive_density(n, body)
    best, most = body, sum(density(c) for c in body.children if c.__class__ is not str and not c.cut)
    for n in nodes(body):
        s = sum(density(c) for c in n.children if c.__class__ is not str and not c.cut)
        if s > most * (1 + 1e-12):
            best, most = n, s
    path = [best]
    while path[-1] is not body:
        path.append(path[-1].parent)
    threshold = min(map(density, path))
    whole = next((n for n in reversed(path) if n.tag == "article"), best)
    path = path[path.index(whole) :]

    def at(n):
        if n is whole:
            return text_of(n)
        out = ""
        for c in n.children:
            if c.__class__ is str:
                out += text_of(c) if len(text_of(c)) >= max(1.0, threshold) else ""
            elif any(c is x for x in path):
                out += at(c)
            elif not c.cut and naive(c, "chars") and density(c) >= threshold:
                out += text_of(c)
        return out

    return at(body)


def test_pages_equal_brute_force(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()]
    assert len(pages) >= 25
    for page in pages:
        assert "".join(H.main_text(page).split()) == naive_text(page or "")


@pytest.mark.parametrize("page", [f"<body><div><ul>{LINKS}</ul></div><div><div>{STORY}</div><div>{STORY}</div></div></body>", f"<body>Bare text before it all, long enough to be kept here.<div>{STORY}</div><p>x</p></body>", f"<div><p><a href=x>All of it is a link</a></p>{STORY}</div><div>{STORY}<ul>{LINKS}</ul></div>"])
def test_other_pages_equal_brute_force(page):
    assert "".join(H.main_text(page).split()) == naive_text(page)
    body = next((n for n in nodes(H.parse(page)) if n.tag == "body"), None) or H.parse(page)
    measured = H.measure(H.parse(page))
    assert [n.density for n in nodes(measured)] == pytest.approx([naive_density(n, body) for n in nodes(body)])
