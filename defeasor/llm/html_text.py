"""Main text of web pages by a maximum-scoring subsequence.

A page is read once into tags and runs of words. Words score positive, tags negative, words of boilerplate (menus,
footers, links lists, adverts and so on) negative; the weights are log odds counted on labelled pages, one for each kind
of token and place (inside an article or main element, outside of it on pages that have one, or on pages without). A
linear scan finds the contiguous region of the best total; its words outside of boilerplate are the text.

Blocks (paragraphs, headings, list items, cells, ...) are joined by one \\n in page order; white space inside a block
becomes one blank; character references are decoded; br counts as white space.

Edge cases: null and empty pages, pages without tags' worth of words and pages of boilerplate only give the empty text;
unclosed elements end with the element around them or where HTML implies it; no element that is or holds the article (the
main element, else the longest article; on pages without either, over half of the words) is boilerplate, but reader comments,
and articles in them, always are; a headline outside of the article is none of its text; a "<" that begins no whole tag is text;
a page without any tag is one block of text. Repeated rows are read each for itself.
Empty tables give empty results. Only the named columns are read.

Scale: in place, no shuffle; time is linear in a page's length, also for tags that never close; memory is that of one batch of pages.
"""

from __future__ import annotations

import html as html_lib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import small_batches

#: Attributes end before a "<" outside of quotes. Each quote sign permutes the states a scan can be in, so no more than three of the
#: scans that begin at different tags run on over the same text: tags that never close cost linear time.
_ATTRS = r"""(?:[^<>"']|"[^"]*"|'[^']*')"""
_RAW = "script|style|noscript|template|svg|iframe|textarea|select|object|canvas|title"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<svg\b{_ATTRS}*?/>|<(?P<raw>{_RAW}|head\b(?=\s*/))\b{_ATTRS}*+>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<close>/)?(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>{_ATTRS}*+)>", re.S | re.I)
_HINT = re.compile(r"""(?:^|\s)(?:class|id|role|aria-label|data-role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_PARTS = re.compile(r"[a-z]+")
_MAIN_ROLE = re.compile(r"""(?:role\s*=\s*["']?main\b|itemprop\s*=\s*["']?articleBody\b)""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img br".split())
_BOILER = frozenset("nav aside footer form menu dialog button fieldset".split())
#: Fixed words by which class, id and role name boilerplate.
_BOILER_HINTS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist complementary contentinfo cookie cookies consent copyright disqus footer gdpr menu modal nav navbar navigation newsletter notice notices popup promo promoted recommended related replies respond search share sharing sidebar siteinfo colophon social sponsor sponsored subscribe subscription toolbar widget".split())
#: Those of them that name reader comments, which no size makes the article.
_COMMENT_HINTS = frozenset("comment comments commentlist disqus replies respond".split())
#: Parts that turn a hint into a statement about the page, and parts that only say which piece of a hint it is.
_MODIFIERS = frozenset("has have no not with without enabled disabled enable disable is hide show open closed type".split())
_LAYOUT = frozenset("area article articles bar block body bottom box btn button buttons col column container content form group inner item items left link links list outer panel post posts primary right row secondary section signup slot stories story thread title top unit wrap wrapper".split())
_P = frozenset(["p"])
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li dd dt main menu nav ol p pre section table ul".split())
_SCOPE = frozenset("button caption html marquee table td th".split())
_CELLS = frozenset("td th caption".split())
_TABLE = frozenset("table thead tbody tfoot tr td th caption".split())
#: Start tags that end an open element: which ones, and what keeps them from being ended.
_CLOSES = {"li": (frozenset(["li"]), frozenset("ul ol menu table td th".split())), **dict.fromkeys(("dt", "dd"), (frozenset(["dt", "dd"]), frozenset("dl table td th".split()))), **dict.fromkeys(("td", "th"), (_CELLS, frozenset(["tr", "table"]))), "tr": (frozenset(["tr"]), frozenset(["table"])), **dict.fromkeys(("tbody", "thead", "tfoot"), (frozenset("tbody thead tfoot".split()), frozenset(["table"]))), **dict.fromkeys(("option", "optgroup"), (frozenset(["option"]), frozenset(["select", "datalist"])))}
#: Elements that are boilerplate even if they hold most words of a page without an article.
_NEVER_WHOLE = frozenset("nav aside footer menu dialog button header".split())

Item = tuple[str, str, str, int]  # kind of token, what (tag name or words), place, position in the page


def _names(value: str, hints: frozenset[str]) -> bool:
    """Whether a word of a class, id or role does: it or its last part is a hint, or its first one before parts of layout."""
    for word in value.lower().split():
        parts = _PARTS.findall(word)
        if not parts or not _MODIFIERS.isdisjoint(parts):
            continue
        if "".join(parts) in hints:
            return True
        while len(parts) > 1 and parts[-1] in _LAYOUT:
            parts.pop()
        if parts[-1] in hints:
            return True
    return False


def _hinted(attrs: str, hints: frozenset[str]) -> bool:
    return "=" in attrs and any(_names("".join(m), hints) for m in _HINT.findall(attrs))


def _boilerplate(name: str, attrs: str, in_main: bool) -> bool:
    if name in _BOILER or (name == "header" and not in_main):
        return True
    if name in ("html", "body", "main") or "=" not in attrs and "hidden" not in attrs.lower():
        return False
    return bool(_HIDDEN.search(attrs)) or _hinted(attrs, _BOILER_HINTS)


def _elements(tokens: list[re.Match]) -> dict[int, int]:
    """For the position of each start tag among the tokens, the position at which its element ends: at its end tag, at the
    end of an element around it, or where HTML implies its end."""
    ends: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    where: dict[str, list[int]] = {}  # places in the stack by name, and of all elements that are not inline

    def top(names) -> int:
        return max((where[n][-1] for n in names if where.get(n)), default=-1)

    def cut(i: int, at: int) -> None:
        for name, p in stack[i:]:
            ends[p] = at
            where[name].pop()
            if name not in _INLINE:
                where[""].pop()
        del stack[i:]

    def close(names: frozenset[str], stop: frozenset[str], at: int) -> None:
        i = top(names)
        if i >= 0 and i >= top(stop):
            cut(i, at)

    for at, m in enumerate(tokens):
        name = (m["name"] or "").lower()
        if not name or name in _VOID:
            continue
        if m["close"]:
            if name in _INLINE:  # a stray one ends no block
                if top((name,)) > top(("",)):
                    cut(top((name,)), at)
            else:
                close(frozenset((name,)), frozenset() if name in _TABLE or name in ("body", "html") else _CELLS - {name}, at)
            continue
        if (m["attrs"] or "").endswith("/") and name not in _CLOSES and name not in _ENDS_P:
            continue
        if name in _ENDS_P:
            close(_P, _SCOPE, at)
        if name in _CLOSES:
            close(*_CLOSES[name], at)
        if not (m["attrs"] or "").endswith("/"):
            for key in (name,) if name in _INLINE else (name, ""):
                where.setdefault(key, []).append(len(stack))
            stack.append((name, at))
    ends.update((p, len(tokens)) for _, p in stack)
    return ends


def _is_main(name: str, attrs: str) -> bool:
    return name in ("article", "main") or bool(_MAIN_ROLE.search(attrs))


def read_page(page: str) -> list[Item]:
    """Tags ('t'), words ('w'), words of links ('a') and boilerplate words ('b') with their places in, out or none."""
    out: list[Item] = []
    tokens = list(_TOKEN.finditer(page))
    ends = _elements(tokens)
    n_before, n, at = [], 0, 0  # words before each token
    for m in tokens:
        n += _n_words(page[at : m.start()])
        n_before.append(n)
        at = m.end()
    n_before.append(n + _n_words(page[at:]))
    held = lambda p: n_before[ends[p]] - n_before[p]
    comments, until = set(), -1  # elements of reader comments and all in them
    for p in sorted(ends):
        if p < until:
            comments.add(p)
        elif tokens[p]["name"].lower() not in ("html", "body") and _hinted(tokens[p]["attrs"] or "", _COMMENT_HINTS):
            comments.add(p)
            until = ends[p]
    mains = [p for p in ends if p not in comments and _is_main(tokens[p]["name"].lower(), tokens[p]["attrs"] or "") and held(p)]
    the_main = max(mains, key=lambda p: (tokens[p]["name"].lower() != "article", held(p), -p), default=None)

    def whole(p: int, name: str) -> bool:
        """Whether an element is or contains the article or, on pages without one, the bulk of the words; reader comments never."""
        if p in comments:
            return False
        if the_main is not None:
            return p <= the_main < ends[p]
        return name not in _NEVER_WHOLE and 2 * held(p) > n_before[-1]

    boiler_end, main_end, link, at, has_main = 0, 0, 0, 0, False

    def words(upto: int, i: int) -> None:
        if upto > at and (text := page[at:upto]) and (not text.isspace() or out):
            kind = "b" if i <= boiler_end and boiler_end else "a" if link else "w"
            out.append((kind, text, "in" if i <= main_end and main_end else "out", at))

    for i, m in enumerate(tokens):
        words(m.start(), i)
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        boiler = bool(boiler_end) and i < boiler_end
        inside = bool(main_end) and i <= main_end
        if m["close"]:
            if not boiler and i != boiler_end and name == "a":
                link = max(0, link - 1)
            out.append(("t", f"/{name}", "in" if inside else "out", m.start()))
            continue
        inside = inside and i < main_end
        attrs = m["attrs"] or ""
        if not boiler and i in ends:
            if _boilerplate(name, attrs, inside) and not whole(i, name):
                boiler, boiler_end = True, ends[i]
            elif _is_main(name, attrs):
                main_end, has_main, inside = max(main_end, ends[i]), True, True
        link += name == "a" and not boiler
        out.append(("t", name, "in" if inside else "out", m.start()))
    words(len(page), len(tokens))
    return out if has_main else [(k, x, "none", p) for k, x, _, p in out]


def _n_words(text: str) -> int:
    return len(text.split())


def labelled_pages(n: int = 120, seed: int = 11) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Pages made from a rule, with the (start, end) of their content. Around articles of 1 to 40 paragraphs (with links,
    inline markup, lists, tables and quotes) there are menus, notices, adverts, comments and footers of many shapes, with
    and without names that say so; a third of the pages have no article or main element."""
    rng = random.Random(seed)

    def say(k: int) -> str:
        return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(k)) + "."

    def marked(k: int) -> str:
        kind = rng.choice(("a href='/x'", "em", "b", "span"))
        return f"{say(k)} <{kind}>{say(rng.randint(1, 4))}</{kind.split()[0]}> {say(k)}" if rng.random() < 0.3 else say(2 * k)

    def extra() -> str:
        link = lambda: f"<a href='/y'>{say(rng.randint(2, 6))}</a>"
        return rng.choice((
            f"<ul><li>{say(5)}</li><li>{say(5)}</li></ul>", f"<ol><li>{link()}</li><li>{link()}</li></ol>", f"<h2>{say(4)}</h2>", f"<blockquote><p>{say(15)}</p></blockquote>",
            "<table>" + "".join(f"<tr><td>{say(2)}</td><td>{say(3)}</td></tr>" for _ in range(3)) + "</table>", f"<div>{say(12)}</div>", f"<pre>{say(6)}</pre>",
        ))

    def items(one: str, k: int, words: int) -> str:
        return "".join(one.format(say(rng.randint(1, words))) for _ in range(k))

    for i in range(n):
        k = rng.randint(3, 20)
        menu = rng.choice((items("<li><a href='/m'>{}</a></li>", k, 3), items("<a href='/m'>{}</a> ", k, 3), items("<div>{}</div>", k, 3), items("<span>{}</span><br>", k, 2)))
        before = [f"<nav><ul>{menu}</ul></nav>", f'<div class="ad">{say(rng.randint(4, 15))}</div>', f"<header><h2>{say(2)}</h2></header>", f"<div><ul>{menu}</ul></div>", f"<div>{menu}</div>", f"<div><span>{say(3)}</span> <span>{say(2)}</span></div>"]
        after = [f"<footer>{say(rng.randint(5, 15))}</footer>", f'<div class="comments"><p>{say(20)}</p></div>', f"<aside><p>{say(12)}</p></aside>", f"<form><label>{say(3)}</label><input><button>{say(1)}</button></form>", f"<div>{menu}</div>", f"<div><small>{say(4)}</small></div>"]
        shell = ("<article>", "</article>") if i % 3 == 0 else ("<main>", "</main>") if i % 3 == 1 else ("<div>", "</div>")
        if i % 3 < 2:  # text without a name stands beside articles too
            before.append(f"<div>{say(rng.randint(5, 60))}</div>")
            after.append(f"<div>{say(rng.randint(5, 60))}</div>")
        head = f"<html><head><title>{say(4)}</title></head><body>" + "".join(rng.sample(before, 3))
        paragraphs = "".join(f"<p>{marked(rng.randint(4, 30))}</p>" + (extra() if rng.random() < 0.15 else "") for _ in range(rng.randint(1, 40)))
        start = head + shell[0]
        content = f"<h1>{say(5)}</h1>{paragraphs}"
        yield start + content + shell[1] + "".join(rng.sample(after, 3)) + "</body></html>", [(len(start), len(start) + len(content))]


#: Tags are counted by these names; all others share one weight.
_OWN_WEIGHT = frozenset("p h1 h2 h3 li ul ol a b em span br table tr td blockquote pre div article main nav aside footer header form section".split())


def _key(kind: str, what: str, place: str) -> tuple[str, str, str]:
    if kind != "t":
        return kind, "", place
    name = what.lstrip("/")
    return kind, what if name in _OWN_WEIGHT else "*", place


@cache
def weights() -> dict[tuple[str, str, str], float]:
    """Log odds of each kind of token on the labelled pages; a tag's is below zero always."""
    inside, outside = Counter(), Counter()
    for page, content in labelled_pages():
        for kind, what, place, pos in read_page(page):
            n = 1 if kind == "t" else _n_words(what)
            (inside if any(a <= pos < b for a, b in content) else outside)[_key(kind, what, place)] += n
    return {k: min(-0.05, x) if k[0] == "t" else x for k in inside | outside for x in [math.log((inside[k] + 0.5) / (outside[k] + 0.5))]}


def best_region(scores: list[float]) -> tuple[int, int]:
    """(start, end) of the contiguous region with the largest positive total, the first one on ties; (0, 0) if none."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, region = total, (start, i + 1)
    return region


def _score(item: Item, table: dict[tuple[str, str, str], float], first_boiler: bool) -> float:
    kind, what, place, _ = item
    if kind == "b" and place == "in":  # an insert never outweighs the article around it
        return -0.5 if first_boiler else 0.0
    if kind == "t":
        return table.get(_key(kind, what, place), -0.05)
    n = _n_words(what)
    return n * table.get((kind, "", place), table.get(("w", "", place), 1.0)) if n else 0.0


def main_text(page: str | None) -> str:
    if not page:
        return ""
    items, table = read_page(page), weights()
    scores = [_score(x, table, not i or items[i - 1][0] != "b") for i, x in enumerate(items)]
    a, b = best_region(scores)
    blocks: list[list[str]] = [[]]
    for kind, what, _, _ in items[a:b]:
        if kind == "t":
            name = what.lstrip("/")
            if name == "br":
                blocks[-1].append(" ")
            elif name not in _INLINE:
                blocks.append([])
        elif kind != "b":
            blocks[-1].append(html_lib.unescape(what))
    lines = [" ".join("".join(x).split()) for x in blocks]
    return "\n".join(x for x in lines if x)


def extract_text(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", carry: tuple[str, ...] = ("url",)) -> DataFrame:
    """Per row: id, the columns in carry, text and n_chars."""
    small_batches(pages.sparkSession)
    kept = [id_col, *carry]
    out = T.StructType([*[T.StructField(c, pages.schema[c].dataType) for c in kept], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=out.names)

    return pages.select(*[F.col(c) for c in kept], F.col(html_col).cast("string").alias("__html")).mapInArrow(run, out)
