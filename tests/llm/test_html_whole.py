"""Pages on which boilerplate must not swallow the article."""

import time

import pytest

from defeasor.llm.html_text import main_text

TEXT = "one two three four five six seven eight nine ten"


@pytest.mark.parametrize("page, text", [
    (f'<body><div class="content has-sidebar"><article><p>{TEXT}</p></article></div></body>', TEXT),
    (f'<body><div id="page-no-comments"><p>{TEXT}</p></div></body>', TEXT),
    (f'<body><article class="post share-enabled"><p>{TEXT}</p></article></body>', TEXT),
    (f'<body><div class="widget"><article><p>{TEXT}</p><div class="share-buttons">Send it</div></article></div></body>', TEXT),
    (f'<body><div class="sidebar"><p>{TEXT}</p></div><p>end</p></body>', TEXT + "\nend"),
    (f'<article><p>{TEXT}</p><div class="comments"><article>short one</article></div></article>', TEXT),
    (f'<article><p class="notice">x<p>Real text</p><p>{TEXT}</p></article>', "Real text\n" + TEXT),
    (f'<article><ul><li class="share">x<li>a b</ul><p>{TEXT}</p></article>', "a b\n" + TEXT),
    (f'<article><ul><li class="share">x</ul><p>{TEXT}</p></article>', TEXT),
    (f'<article><table><tr><td class="ad">x<td>{TEXT}<tr><td>more</table></article>', TEXT + "\nmore"),
    (f'<article><dl><dt class="ad">x<dd>{TEXT}</dl></article>', TEXT),
    (f'<article><svg class="icon"/><p>{TEXT}</p></article>', TEXT),
    (f'<article><svg><path d="M"/></svg><p>{TEXT}</p></article>', TEXT),
])
def test_article_is_whole(page, text):
    assert main_text(page) == text


SENTENCES = [f"{TEXT} {i}." for i in range(8)]
TOLD = "".join(f"<p>{x}</p>" for x in SENTENCES)


@pytest.mark.parametrize("comments", [
    f"<section id='comments'><article class='comment'>{TOLD}</article></section>", f"<section id='comments'><article>{TOLD}</article></section>",
    f"<div class='comment-list'><div>{TOLD}</div></div>", f"<article class='reader-comment'>{TOLD}</article>", f"<div id='disqus_thread'><main>{TOLD}</main></div>",
    f"<section><div class='related-posts'><a href='/x'>{TEXT}</a></div></section>", f"<div class='newsletter-signup'>{TEXT}</div>", f"<div class='ad-slot'>{TEXT}</div>", f"<div class='site-info'>{TEXT}</div>", f"<div class='related-articles'>{TEXT}</div>",
])
@pytest.mark.parametrize("inside", [False, True])
def test_comments_and_notices_are_out(comments, inside):
    story = "".join(f"<p>Story {x}</p>" for x in SENTENCES[:4])
    page = f"<body><article>{story}{comments}</article></body>" if inside else f"<body><article>{story}</article>{comments}</body>"
    assert main_text(page) == "\n".join(f"Story {x}" for x in SENTENCES[:4])


def test_comments_that_are_most_of_a_page():
    page = f"<body><div class='content'><p>Story {TEXT}</p><p>{TEXT}</p></div><div class='comments'>{TOLD * 3}</div></body>"
    assert main_text(page) == f"Story {TEXT}\n{TEXT}"
    assert main_text(f"<div class='comments'>{TOLD}</div>") == ""


@pytest.mark.parametrize("unit", ["<svg ", "<a ", "<a \"", "<a '\"", "<div></p>", "<button><p><div>", "<b></i>", "<i><div><b></i>", "<script ", "<!--", "</p ", "<td>"])
def test_linear_time(unit):
    start = time.process_time()
    main_text(f"<article><p>{TEXT}</p>" + unit * (400_000 // len(unit)) + "' >")
    assert time.process_time() - start < 8
