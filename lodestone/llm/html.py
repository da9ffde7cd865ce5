"""Main-text extraction by the maximum-scoring subsequence of a page's tokens.

A page is read once, forwards, as a stream of tags and words. Words score positive and tags negative, by weights learned
from labelled pages: the log odds of the token inside against outside the marked content. A token's kind says where it
stands: within an article or main element, outside it, or on a page without one; for words and inline tags also the sort of their block, for words its
length and whether they are a link's. A linear scan finds the contiguous stretch of tokens with the greatest sum.

Containers inside that stretch (menus, forms, adverts, comments and the like) are left out by the same labelled pages: a
logistic regression weighs a container's element name, the words of its class, id and role, its share of the page's
words, its links and headings. No single word decides: a wrapper of class "with-sidebar" that holds the article stays.
What is left out counts 0 in the scan, so that it neither adds to a stretch nor breaks it.

The labelled pages are invented here from random layouts, with the content marked.

Results for odd input: a null or empty page, and a page without words, give an empty text; an element that is never
closed ends with the element around it; a tag that never closes with > is text; repeated rows are read each.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches

# Element names by what they are.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
NEVER = RAW | frozenset("head noscript template select button svg math object audio video canvas datalist dialog menu".split())
DOUBTFUL = frozenset("nav header footer aside form".split())
IN_HEAD = frozenset("title meta link script style base noscript template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
PROSE = frozenset("p blockquote pre dd figcaption summary".split())
ENDS_ITSELF = frozenset("p li dt dd tr td th option".split())
#: Words of class, id and role that can tell what is not content.
HINTS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side aside widget widgets header masthead footer foot copyright "
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert "
    "comment comments disqus reply replies respond discussion related recommended share sharing social newsletter subscribe subscription signup login "
    "search form popup modal overlay toolbar pagination pager tags taglist skip contentinfo complementary".split()
)

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_ATTRIBUTE = re.compile(r"""[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("|'|[^\s>]*+))?+""")
_GAP = re.compile(r"[\s/]*+")
_PART = re.compile(r"[a-z]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I | re.A) for name in RAW}


class Scanner:
    """Reads a page's tags and texts from left to right; looks ahead for what cannot be there at most once."""

    def __init__(self, html: str) -> None:
        self.html, self.last = html, {c: html.rfind(c) for c in ("<", ">", '"', "'", "-->", "]]>")}
        self.missing: set[str] = set()
        self.plain = False  # after a tag that only a > inside quotes could close, quotes no longer hide >

    def _find(self, what: str, at: int) -> int:
        return self.html.find(what, at) if self.last[what] >= at else -1

    def tag(self, at: int) -> tuple[str, dict[str, str], bool, int] | None:
        """Name, class, id and role, whether /> ends it, and the place after it, of the tag whose name starts at."""
        html = self.html
        found = _NAME.match(html, at)
        if not found or self.last[">"] < at:
            return None
        name, place, attributes, slash = found[0].lower(), found.end(), {}, False
        while True:
            gap = _GAP.match(html, place)
            slash = gap[0].endswith("/")
            place = gap.end()
            if html[place : place + 1] == ">":
                return name, attributes, slash, place + 1
            found = _ATTRIBUTE.match(html, place)
            if self.plain or not found:
                break
            place, value = found.end(), found[2] or ""
            if value in ('"', "'"):
                end = self._find(value, place)
                if end < 0:  # a quote that never closes is part of an unquoted value
                    end = min(x for x in (self._find(">", place), len(html)) if x >= 0)
                    value, place = html[place:end], end
                else:
                    value, place = html[place:end], end + 1
            if (key := found[1].lower()) in ("class", "id", "role"):
                attributes.setdefault(key, value)
        self.plain = True
        end = self._find(">", at)
        return (name, attributes, html[end - 1] == "/", end + 1) if end >= 0 else None

    def __iter__(self):
        """(text, "", {}, False) and ("", name or /name, attributes, self-closing), in order."""
        html, at, text = self.html, 0, 0
        while (at := self._find("<", at)) >= 0:
            head = html[at + 1 : at + 2]
            name, after = "", -1
            if head == "!" or head == "?":
                if html.startswith("!--", at + 1):
                    after = at + 5 if html.startswith(">", at + 4) else self._find("-->", at + 4) + 3
                    after = after if after > 2 else len(html)
                elif html.startswith("![CDATA[", at + 1) and (end := self._find("]]>", at)) >= 0:
                    after = end + 3
                else:
                    after = self._find(">", at) + 1 or -1
            elif found := self.tag(at + 1 + (head == "/")):
                name, attributes, slash, after = found
            elif head == "/" and html[at + 2 : at + 3] not in ("", " ", "\n", "\t"):
                after = self._find(">", at) + 1 or -1
            if after < 0:
                at += 1
                continue
            if text < at:
                yield html[text:at], "", {}, False
            if name:
                yield "", "/" * (head == "/") + name, attributes, slash
                if head != "/" and name in RAW and not slash and name not in self.missing:
                    if end := _RAW_END[name].search(html, after):
                        after = end.start()
                    else:
                        self.missing.add(name)
                        after = len(html) if name in ("script", "style") else after
            at = text = after
        if text < len(html):
            yield html[text:], "", {}, False


class Page:
    """A page's tokens in order (tag or "", text, block, container, link) and its containers as a tree."""

    def __init__(self, html: str) -> None:
        self.tokens: list[tuple[str, str, int, int, bool]] = []
        self.block_tag, self.block_words = [""], [0]
        self.parent, self.name, self.hints = [-1], ["html"], [()]
        self.words, self.linked, self.title = [0], [0], [False]
        stack, depth = [0], Counter()  # open containers, and how many of each name
        link = False

        def close(upto: int) -> None:
            while len(stack) > upto:
                k = stack.pop()
                depth[self.name[k]] -= 1
                self.words[stack[-1]] += self.words[k]
                self.linked[stack[-1]] += self.linked[k]
                self.title[stack[-1]] |= self.title[k]

        for text, name, attributes, slash in Scanner(html):
            if text:
                n = len(text.split())
                self.tokens.append(("", text, len(self.block_tag) - 1, stack[-1], link))
                self.block_words[-1] += n
                self.words[stack[-1]] += n
                self.linked[stack[-1]] += n * link
                self.title[stack[-1]] |= bool(n) and self.block_tag[-1] == "h1"
                continue
            ends, plain = name[0] == "/", name.lstrip("/")
            if plain not in INLINE:
                if not ends and plain not in IN_HEAD and depth["head"]:
                    close(max(1, next(i for i, k in enumerate(stack) if self.name[k] == "head")))
                self.block_tag.append("" if ends else plain)
                self.block_words.append(0)
                if not ends and plain in ENDS_ITSELF and self.name[stack[-1]] == plain:
                    close(len(stack) - 1)
                elif not ends and self.name[stack[-1]] == "p":
                    close(len(stack) - 1)
            if ends and depth[plain]:
                at = len(stack) - 1
                while self.name[stack[at]] != plain:
                    at -= 1
                self.tokens.append((name, "", len(self.block_tag) - 1, self.parent[stack[at]], False))
                close(at)
                continue
            if plain == "a":
                link = not ends
            hints = () if ends else self.evidence(attributes)
            if not ends and plain not in VOID and not slash and plain not in ("html", "body") and (plain not in INLINE or hints):
                self.parent.append(stack[-1])
                self.name.append(plain)
                self.hints.append(hints)
                self.words.append(0)
                self.linked.append(0)
                self.title.append(False)
                stack.append(len(self.name) - 1)
                depth[plain] += 1
            self.tokens.append((name, " " if plain == "br" else "", len(self.block_tag) - 1, stack[-1], False))
        close(1)

    @staticmethod
    def evidence(attributes: dict[str, str]) -> tuple[str, ...]:
        """Hint words that are a whole name of class, id or role, those that are a part of one, and the parts beside them."""
        out = []
        for value in attributes.values():
            for name in value.lower().split():
                parts = _PART.findall(name)
                if HINTS.isdisjoint(parts):
                    continue
                out += [f"whole:{parts[0]}"] if len(parts) == 1 else [("part:" if p in HINTS else "beside:") + p for p in parts]
        return tuple(dict.fromkeys(out))

    def features(self, k: int) -> list[str]:
        """What tells whether container k is content."""
        share = self.words[k] / max(1, self.words[0])
        links = self.linked[k] / max(1, self.words[k])
        size = min(4, self.words[k].bit_length() // 2)
        out = ["", f"name:{self.name[k] if self.name[k] in DOUBTFUL else ''}", f"share:{min(4, int(5 * share))}", f"links:{min(2, int(3 * links))}", f"size:{size}"]
        return out + ["title"] * self.title[k] + list(self.hints[k]) + ["hinted"] * bool(self.hints[k])

    def excluded(self, weight: dict[str, float]) -> list[bool]:
        """For each container whether it, or one around it, is left out."""
        out = [False] * len(self.name)
        for k in range(1, len(out)):
            doubt = self.name[k] in DOUBTFUL or self.hints[k]
            out[k] = out[self.parent[k]] or self.name[k] in NEVER or bool(doubt and sum(weight.get(f, 0.0) for f in self.features(k)) > 0)
        return out

    def kinds(self, out: list[bool]) -> list[str]:
        """The kind of every token; empty for what is left out."""
        inner = [False] * len(self.name)
        for k in range(1, len(inner)):
            inner[k] = inner[self.parent[k]] or self.name[k] in ("article", "main")
        some = any(i and not o for i, o in zip(inner, out, strict=True))
        kinds = []
        for tag, _, block, k, link in self.tokens:
            where = "i" if inner[k] else "o" if some else "n"
            name, n = self.block_tag[block], self.block_words[block]
            sort = "h" if name in HEADINGS else "p" if name in PROSE else "x"
            if out[k]:
                kinds.append("")
            elif tag:
                kinds.append(where + tag + f":{sort}" * (tag.lstrip("/") in INLINE))
            else:
                kinds.append(where + f" {sort}{(n > 4) + (n > 12)}{'a' * link}")
        return kinds


class Layouts:
    """Invented pages. Content words start with c, all others with b."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def text(self, mark: str, low: int, high: int) -> str:
        return " ".join(f"{mark}{self.r.randrange(500)}" for _ in range(self.r.randint(low, high)))

    def links(self, mark: str, n: int, low: int = 1, high: int = 3) -> str:
        items = [f'<a href="/">{self.text(mark, low, high)}</a>' for _ in range(n)]
        shape = self.r.choice(["<ul>{}</ul>", "<div>{}</div>", "{}"])
        return shape.format("".join(f"<li>{x}</li>" for x in items) if "ul" in shape else " ".join(items))

    def named(self, inner: str, names: str, tags: str = "div section", told: bool = False) -> str:
        """inner in an element that tells what it is by name, class or id, or (but if told) does not."""
        name = self.r.choice(names.split())
        tag = name if name in DOUBTFUL and self.r.random() < 0.5 else self.r.choice(tags.split())
        odds = self.r.random() * (0.6 if told else 1)
        around = self.r.choice(["{}", "site-{}", "{}-box", "page-{}", "{} {}-main", "main-{}", "{}_list", "js-{}", "{}-area"]).format(name, name)
        return f"<{tag}{f' class={chr(34)}{around}{chr(34)}' if odds < 0.6 else f' id={around}' if odds < 0.8 and ' ' not in around else ''}>{inner}</{tag}>"

    def aside(self) -> str:
        """Something within or beside the article that does not belong to it."""
        r = self.r
        return r.choice(
            [
                lambda: self.named(self.text("b", 3, 20), "ad ads advert advertisement sponsored promo banner"),
                lambda: self.named(self.links("b", r.randint(2, 5)), "share social sharing tags toolbar"),
                lambda: self.named(self.links("b", r.randint(3, 9), 2, 9), "related recommended aside"),
                lambda: self.named(f"<p>{self.text('b', 4, 25)}</p><form><input><button>{self.text('b', 1, 2)}</button></form>", "newsletter subscribe signup form notice"),
                lambda: f"<aside><p>{self.text('b', 5, 40)}</p></aside>",
                lambda: f"<form><label>{self.text('b', 1, 4)}</label><input><button>{self.text('b', 1, 2)}</button></form>",
            ]
        )()

    def comments(self) -> str:
        r = self.r
        one = lambda: r.choice(['<article class="comment">{}</article>', '<div class="comment-body">{}</div>', "<li>{}</li>"]).format(
            f"<span>{self.text('b', 1, 2)}</span><p>{self.text('b', 3, 50)}</p><a href='/'>{self.text('b', 1, 1)}</a>"
        )
        return self.named("".join(one() for _ in range(r.randint(1, 12))), "comments comments comment discussion disqus respond replies", told=True)

    def content(self) -> str:
        r, out = self.r, []
        for _ in range(r.randint(1, 14)):
            p = self.text("c", *r.choice([(1, 12), (2, 12), (9, 40), (30, 90)]))
            link = f'<a href="/">{self.text("c", 1, 6)}</a>'
            cited = "".join(f"<li><a href='/'>{self.text('c', 4, 10)}</a></li>" for _ in range(r.randint(3, 6)))
            shapes = ["<p>{0}</p>"] * 8 + ["<p>{0} {1} {0}</p>", "<p>{1} {0}</p>", "<p>{0}, {1}</p>", "<p><b>{0}</b><br>{0}</p>", "<p>{0}<br><p>{0}", "<h2>{2}</h2><p>{0}</p>", "<ul><li>{0}</li><li>{0}</li></ul>"]
            shapes += ["<blockquote>{0}</blockquote>", "<pre>{0}</pre>", "<div>{0}</div>", "<div><p>{0}</p><img></div>", "<table><tr><td>{2}</td><td>{0}</td></tr></table>", "<ul>{3}</ul>"]
            shapes += ['<section class="{4}"><h2>{2}</h2><p>{0}</p><p>{0}</p></section>', '<div class="{4}"><p>{0}</p></div>']
            names = "side-effects related-work share-price search-results-analysis notice-period form-factor social-history header-files text-content intro header-text tags-explained alert-levels side-notes"
            out.append(r.choice(shapes).format(p, link, self.text("c", 1, 7), cited, r.choice(names.split())))
            if r.random() < 0.2:
                out.append(self.aside())
        return "".join(out)

    def page(self) -> str:
        r = self.r
        front = [self.named(f"<p>{self.text('b', 5, 25)}</p><a href='/'>{self.text('b', 1, 2)}</a>", "cookie notice consent gdpr alert")] * (r.random() < 0.4)
        top = f"<span>{self.text('b', 1, 4)}</span>" * r.randint(0, 1) + self.named(self.links("b", r.randint(3, 12)), "nav menu navigation navbar")
        front.append(self.named(top, "header masthead header") if r.random() < 0.7 else top)
        front += [self.named(self.links("b", r.randint(2, 4)), "breadcrumb breadcrumbs")] * (r.random() < 0.3)
        front += [f"<div>{self.text('b', 3, 12)}</div>"] * (r.random() < 0.2) + [self.aside()] * (r.random() < 0.3)
        heading = f"<h1>{self.text('c', 1, 9)}</h1>"
        body = (heading if r.random() < 0.9 else "") + [self.aside(), ""][r.random() < 0.8] + self.content()
        names = ["", ' class="post"', ' class="entry-content"', ' id="content"', ' class="article-body has-sidebar"', ' class="story header-fixed"']
        body = r.choice(["<article{1}>{0}</article>", "<article{1}>{0}</article>", "<main{1}>{0}</main>", "<div{1}>{0}</div>", "<div{1}>{0}</div>"]).format(body, r.choice(names))
        side = self.named("".join(f"<h3>{self.text('b', 1, 3)}</h3><p>{self.text('b', 2, 15)}</p>{self.links('b', r.randint(2, 8), 1, 8)}" for _ in range(r.randint(1, 3))), "sidebar aside widget side complementary")
        teasers = "".join(f'<div><a href="/"><img><span>{self.text("b", 2, 9)}</span></a></div>' for _ in range(r.randint(2, 7)))
        back = [self.comments()] * (r.random() < 0.5) + [f"<p>{self.text('b', 2, 7)}</p>"] * (r.random() < 0.3) + [f"<div>{teasers}</div>"] * (r.random() < 0.3)
        middle = [body, *back]
        if r.random() < 0.4:
            middle.insert(r.choice([0, len(middle)]), side)
        end = r.choice(["<p>{}</p>", "<div>{}</div>", "<div><p>{}</p></div>", "{}"]).format(self.text("b", 3, 9)) + self.links("b", r.randint(0, 6))
        end = self.named(end, "footer footer foot contentinfo copyright") if r.random() < 0.7 else f"<div>{end}</div>"
        wrap = ["{}", "<div>{}</div>", '<div class="page with-sidebar">{}</div>', '<div class="layout header-fixed">{}</div>', '<div id="wrapper" class="no-sidebar sticky-footer">{}</div>']
        wrap += ['<form id="aspnetForm">{}</form>', '<form id="form1" action="/">{}</form>', '<div class="container has-menu nav-open">{}</div>', "<main>{}</main>"]
        inner, outer = r.choice(wrap), r.choice(wrap[:-1])
        return f"<html><head><title>{self.text('b', 2, 6)}</title></head><body>" + outer.format("".join(front) + inner.format("".join(middle)) + end) + "</body></html>"


@lru_cache(1)
def labelled_pages() -> list[str]:
    made = Layouts(1)
    return [made.page() for _ in range(300)]


def _marked(page: Page) -> tuple[list[bool], list[int]]:
    """For each container whether it holds content words; and the tokens that hold some."""
    holds = [False] * len(page.name)
    at = []
    for i, (_, text, _, k, _) in enumerate(page.tokens):
        if text.lstrip().startswith("c"):
            at.append(i)
            while k >= 0 and not holds[k]:
                holds[k] = True
                k = page.parent[k]
    return holds, at


@lru_cache(1)
def weights() -> tuple[dict[str, float], dict[str, float]]:
    """Of containers' features (above 0 in sum: left out) and of tokens, words held positive and tags negative."""
    pages = [Page(p) for p in labelled_pages()]
    rows, left_out = [], []
    for page in pages:
        holds, _ = _marked(page)
        for k in range(1, len(page.name)):
            if (page.name[k] in DOUBTFUL or page.hints[k]) and (page.words[k] or page.name[k] in DOUBTFUL):
                rows.append(page.features(k))
                left_out.append(not holds[k])
    names = {f: i for i, f in enumerate(sorted({f for r in rows for f in r}))}
    who = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.array([names[f] for r in rows for f in r])
    y, w = np.array(left_out, float), np.zeros(len(names))
    speed = np.full(len(names), 1e-8)
    for _ in range(400):
        error = 1 / (1 + np.exp(-np.bincount(who, w[column], len(rows)))) - y
        gradient = np.bincount(column, error[who], len(names)) + 0.05 * w
        speed += gradient**2
        w -= 0.5 * gradient / np.sqrt(speed)
    container = dict(zip(names, w.tolist(), strict=True))

    inside: Counter[str] = Counter()
    outside: Counter[str] = Counter()
    for page in pages:
        holds, at = _marked(page)  # every layout has content
        kinds = page.kinds([n in NEVER or (n in DOUBTFUL or bool(h)) and not c for n, h, c in zip(page.name, page.hints, holds, strict=True)])
        first, last = at[0], at[-1] + 1  # with the tag that ends the last block
        while first and page.tokens[first - 1][2] == page.tokens[first][2]:
            first -= 1
        for i, kind in enumerate(kinds):
            if kind:
                (inside if first <= i <= last else outside)[kind] += len(page.tokens[i][1].split()) or 1
    token = {}
    for kind in {*inside, *outside}:
        odds = log((inside[kind] + 1) / (outside[kind] + 1))
        token[kind] = max(odds, LEAST_WORD) if kind[1] == " " else min(odds, LEAST_TAG)
    return container, token


#: The least weight of a word, the weight nearest to 0 of a tag, and that of a tag that no labelled page has.
LEAST_WORD, LEAST_TAG, OTHER_TAG = 0.1, -0.02, -0.3


def region(weight: list[float]) -> tuple[int, int]:
    """First and last + 1 of the stretch with the greatest sum; the first and shortest of equal ones; (0, 0) if none is positive."""
    best, span = 0.0, (0, 0)
    total, start = 0.0, 0
    for i, w in enumerate(weight):
        total += w
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, span = total, (start, i + 1)
    return span


def scores(page: Page, kinds: list[str], token: dict[str, float]) -> list[float]:
    """The weight of every token, a text's times its words; 0 for what is left out."""
    out = []
    for (_, text, _, _, _), kind in zip(page.tokens, kinds, strict=True):
        if not kind:
            out.append(0.0)
        elif kind[1] == " ":
            out.append(len(text.split()) * token.get(kind, LEAST_WORD))
        else:
            out.append(token.get(kind, OTHER_TAG))
    return out


def main_text(html: str | None) -> str:
    """The page's main text: its blocks in order, with an empty line between."""
    if not html:
        return ""
    page = Page(html)
    container, token = weights()
    kinds = page.kinds(page.excluded(container))
    first, last = region(scores(page, kinds, token))
    blocks: list[str] = []
    parts: list[str] = []
    block = -1
    for (_, text, number, _, _), kind in zip(page.tokens[first:last], kinds[first:last], strict=True):
        if not text or not kind:
            continue
        if number != block:
            blocks.append("".join(parts))
            parts, block = [], number
        parts.append(text)
    blocks.append("".join(parts))
    clean = (" ".join(entities.unescape(b).split()) for b in blocks)
    return "\n\n".join(b for b in clean if b)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h.as_py()) for h in batch.column("html")]
        columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(pages["page_id"].cast("bigint").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    return map_batches(rows, run, "page_id bigint, url string, text string, n_chars bigint")
