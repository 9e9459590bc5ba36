"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page becomes a list of leaf blocks: runs of text between block-level tags, with their open elements. Features are
the tags and the words of class, id and role of all ancestors, and the form of the text (length, share of linked
letters, end marks). The field scores each block as article or not and each pair of neighbours, and Viterbi picks the
best labelling of a page.

It is trained on labelled pages: rows whose own article or main element tells the labels, and the same pages dressed
in other layouts, with plain and speaking wrappers, so that the field also learns pages without those elements.
Training maximizes the penalized likelihood (forward-backward) over a bounded sample of rows.
"""

from __future__ import annotations

import html as html_rules
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgrisk.llm.common import arrow_map, slices

# Element names of the HTML standard.
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("script style title textarea noscript template iframe svg object audio video canvas".split())
#: Without an end tag these hold the rest of the page; any other silent element is then taken for a stray tag.
RAW = {"script", "style"}
#: Opening one of these ends an open element of the set, up to the nearest of the bounds.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: A quote opens a string directly after the equals sign of an attribute only; any other quote is a plain character.
_VALUE = r"""[ \t\n\f\r]*+=[ \t\n\f\r]*+(?:"[^"]*+"|'[^']*+'|[^ \t\n\f\r"'>][^ \t\n\f\r>]*+)?+"""
_TAG = re.compile(rf"<(?:!--|(/?)([a-zA-Z][^\s/>]*)((?:[ \t\n\f\r/]++|[^ \t\n\f\r/>][^ \t\n\f\r/>=]*+(?:{_VALUE})?+)*+)>|[!?/][^>]*>)")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|(?<![\w-])hidden(?![\w-])", re.I)

#: A leaf block: text, open elements from outside in as (tag, words), share of letters inside links.
Block = tuple[str, tuple[tuple[str, tuple[str, ...]], ...], float]


def leaf_blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order; scripts, styles, comments and other silent elements leave nothing."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    links = linked = 0
    at, size = 0, len(page)

    def flush() -> None:
        nonlocal linked
        whole = " ".join(html_rules.unescape("".join(text)).split())
        text.clear()
        if whole:
            out.append((whole, tuple(stack), min(1.0, linked / len(whole))))
        linked = 0

    def close(names: set[str], bounds: set[str]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in bounds:
                return

    def take(piece: str) -> None:
        nonlocal linked
        if piece:
            text.append(piece)
            if links:
                linked += len(piece)

    while at < size:
        start = page.find("<", at)
        if start < 0:
            take(page[at:])
            break
        take(page[at:start])
        found = _TAG.match(page, start)
        if found and found.group(0) == "<!--":
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        found = found or _LOOSE.match(page, start)
        if not found:
            if start + 1 < size and (page[start + 1].isalpha() or page[start + 1] in "/!?"):
                break  # an unfinished tag
            take("<")
            at = start + 1
            continue
        at = found.end()
        if not found.group(2):
            continue
        tag, attributes = found.group(2).lower(), found.group(3)
        if found.group(1):
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK:
                flush()
                if any(t == tag for t, _ in stack):
                    close({tag}, set())
            continue
        if tag in SILENT:
            if not attributes.endswith("/"):
                end = re.compile(f"</{tag}(?![^\\s/>])[^>]*>", re.I).search(page, at)
                at = end.end() if end else size if tag in RAW else at
            continue
        if tag == "a":
            links = 1
        elif tag in ("br", "hr"):
            flush()
        elif tag in BLOCK:
            flush()
            close({"p"}, {"td", "th", "button", "table", "li", "article", "section", "div", "body"})
            if tag in ENDS:
                close(*ENDS[tag])
            words = []
            if attributes:
                for a, b, c in _NAMES.findall(attributes):
                    words += [w.lower() for w in _TOKEN.findall(a or b or c)]
                if _HIDDEN.search(attributes):
                    words.append("hidden")
            if tag not in VOID:
                stack.append((tag, tuple(words)))
    flush()
    return out


_SECTIONS = {"article", "main", "nav", "header", "footer", "aside", "form"}
_PLAIN = {"html", "body", "div"}


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of the features of every block."""
    out = []
    for number, (text, path, linked) in enumerate(blocks):
        own = ["bias"]
        near = "none"
        for tag, words in path:
            if tag not in _PLAIN:
                own.append("in " + tag)
            if tag in _SECTIONS:
                near = tag
            own += ["of " + w for w in words]
        own.append("near " + near)
        leaf = path[-1][0] if path else "none"
        count = text.count(" ") + 1
        length = min(6, count.bit_length())
        link = 0 if linked < 0.05 else 1 if linked < 0.5 else 2
        own += [f"leaf {leaf}", f"words {length}", f"links {link}", f"links {link} words {length}"]
        if text[-1] in ".!?…。！？":
            own.append("sentence")
        if "©" in text or "(c)" in text.lower():
            own.append("copyright")
        if number == 0:
            own.append("first")
        if number == len(blocks) - 1:
            own.append("last")
        out.append(list(dict.fromkeys(own)))
    return out


class Field:
    """Weights of a two-label chain: article (1) or other (0)."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}  # for article against other
        self.moves = np.zeros((2, 2))

    def scores(self, names: list[list[str]]) -> list[float]:
        get = self.weights.get
        return [sum([get(n, 0.0) for n in own]) for own in names]

    def label(self, blocks: list[Block]) -> list[int]:
        """The best labelling (Viterbi); equal scores go to other."""
        scores = self.scores(features(blocks))
        (stay0, to1), (to0, stay1) = self.moves.tolist()
        best0 = best1 = 0.0
        back: list[tuple[int, int]] = []
        for i, s in enumerate(scores):
            if i == 0:
                best0, best1 = 0.0, s
                continue
            a, b = best0 + stay0, best1 + to0
            c, d = best0 + to1, best1 + stay1
            back.append((0 if a >= b else 1, 0 if c >= d else 1))
            best0, best1 = max(a, b), max(c, d) + s
        if not scores:
            return []
        path = [1 if best1 > best0 else 0]
        for step in reversed(back):
            path.append(step[path[-1]])
        return path[::-1]

    def train(self, pages: list[tuple[list[list[str]], list[int]]], rounds: int = 6, rate: float = 0.3, penalty: float = 1e-4) -> Field:
        """Stochastic gradient ascent of the penalized likelihood, with a step for each weight that shrinks by use."""
        seen: dict[str, float] = {}
        seen_moves = np.full((2, 2), 1e-6)
        order = random.Random(5)
        pages = [p for p in pages if p[1]]
        for _ in range(rounds):
            order.shuffle(pages)
            for names, labels in pages:
                s = self.scores(names)
                n = len(s)
                m = self.moves
                ahead = np.zeros((n, 2))
                ahead[0] = 0.0, s[0]
                for i in range(1, n):
                    step = ahead[i - 1][:, None] + m
                    top = step.max(0)
                    ahead[i] = top + np.log(np.exp(step - top).sum(0))
                    ahead[i, 1] += s[i]
                after = np.zeros((n, 2))
                for i in range(n - 2, -1, -1):
                    step = m + after[i + 1] + np.asarray([0.0, s[i + 1]])
                    top = step.max(1, keepdims=True)
                    after[i] = (top + np.log(np.exp(step - top).sum(1, keepdims=True)))[:, 0]
                whole = np.logaddexp(ahead[-1, 0], ahead[-1, 1])
                share = np.exp(ahead + after - whole)[:, 1]
                for own, label, p in zip(names, labels, share.tolist()):
                    error = label - p
                    if abs(error) < 1e-4:
                        continue
                    for name in own:
                        g = error - penalty * self.weights.get(name, 0.0)
                        seen[name] = seen.get(name, 1e-6) + g * g
                        self.weights[name] = self.weights.get(name, 0.0) + rate * g / math.sqrt(seen[name])
                gradient = np.zeros((2, 2))
                for i in range(1, n):
                    joint = ahead[i - 1][:, None] + m + (after[i] + np.asarray([0.0, s[i]]))[None, :] - whole
                    gradient -= np.exp(joint)
                    gradient[labels[i - 1], labels[i]] += 1
                gradient -= penalty * m
                seen_moves += gradient**2
                self.moves = m + rate * gradient / np.sqrt(seen_moves)
        return self


# --- labelled pages -----------------------------------------------------------------------

#: Wrappers of articles and of everything else, by kind, from outside in: tags with words of class, id or role.
ARTICLES = [
    "article", "main", "main article", "div.content", "div.post", "div.entry.content", "div.article.body", "section.story",
    "div.main div.text", "div.page div", "div", "div div", "td", "div.post.content div", "section", "div.markdown",
]
OTHERS = {
    "menu": ["nav", "header nav ul", "div.menu", "div.nav", "div.navbar ul", "div.navigation", "ul.menu", "div.breadcrumb", "div.toolbar"],
    "header": ["header", "div.header", "div.masthead", "div.banner", "div.top", "div.logo"],
    "footer": ["footer", "div.footer", "div.colophon", "div.copyright", "div.bottom", "section.footer"],
    "sidebar": ["aside", "div.sidebar", "div.side", "div.widget", "div.related", "div.recommended", "section.more"],
    "notice": ["div.cookie", "div.notice", "div.consent", "div.gdpr", "div.alert", "div.popup", "div.modal", "dialog", "div.disclaimer"],
    "advert": ["div.ad", "div.ads", "div.advert", "div.advertisement", "div.promo", "div.sponsored", "div.sponsor", "aside.ad"],
    "form": ["form", "form fieldset", "div.newsletter form", "div.signup", "div.subscribe", "div.login form", "div.search form", "form select"],
    "comments": ["div.comments", "section.comments", "ol.commentlist", "div.comment", "div.replies", "div.disqus", "section.responses", "div.discussion", "article.comment"],
    "share": ["div.share", "div.social", "ul.tags", "div.meta", "div.pagination"],
}
_INSIDE = ["advert", "sidebar", "form", "share", "comments", "notice"]
_SPARE = ["Home About Contact", "All of the words in this sentence stand for running text that goes on for a while."]


def _wrap(spec: str) -> tuple[tuple[str, tuple[str, ...]], ...]:
    return tuple((x.split(".")[0], tuple(x.split(".")[1:])) for x in spec.split())


#: Class words of other parts of a page; those left out also name parts of articles.
_OTHER_WORDS = {w for specs in OTHERS.values() for spec in specs for _, words in _wrap(spec) for w in words} - {"top", "side", "more", "bottom", "meta"}


def own_labels(blocks: list[Block]) -> list[int] | None:
    """Labels that a page's article or main element tells; None without one."""
    if not any(tag in ("article", "main") for _, path, _ in blocks for tag, _ in path):
        return None
    out = []
    for _, path, _ in blocks:
        tags = [t for t, _ in path]
        inside = False
        for tag, words in path:
            if tag in ("article", "main") and not set(words) & {"comment", "comments", "teaser", "card"}:
                inside = True
            elif tag in ("nav", "aside", "footer", "form", "button", "select", "dialog") or _OTHER_WORDS & set(words):
                inside = False
            elif tag == "header" and not any(t[0] == "h" and t[1:].isdigit() for t in tags):
                inside = False
        out.append(int(inside))
    return out


def dressed(pages: list[list[Block]], labels: list[list[int]], copies: int = 2, seed: int = 3) -> list[tuple[list[Block], list[int]]]:
    """The articles of labelled pages in other layouts, with other parts around and inside them."""
    draw = random.Random(seed)
    prose = [b[0] for page, own in zip(pages, labels) for b, y in zip(page, own) if y] or _SPARE
    rest = [b[0] for page, own in zip(pages, labels) for b, y in zip(page, own) if not y] or _SPARE
    root = (("html", ()), ("body", ()))
    out = []
    for page, own in zip(pages, labels):
        article = [(b[0], b[1][-1] if b[1] else ("p", ()), b[2]) for b, y in zip(page, own) if y]
        for _ in range(copies):
            blocks: list[Block] = []
            marks: list[int] = []
            outer = root + (_wrap(draw.choice(["div", "div.wrapper", "div.container", "div.site", "table tr"])) if draw.random() < 0.6 else ())

            def other(kind: str, inside: tuple = ()) -> None:
                path = outer + inside + _wrap(draw.choice(OTHERS[kind]))
                for _ in range(draw.choice((1, 1, 2, 4))):
                    linked = 1.0 if kind in ("menu", "share") or draw.random() < 0.2 else 0.0
                    text = draw.choice(prose if kind in ("comments", "advert", "sidebar", "notice") and draw.random() < 0.6 else rest)
                    leaf = draw.choice([(), (("p", ()),), (("li", ()),), (("div", ()),), (("h3", ()),)])
                    blocks.append((text, path + leaf, linked))
                    marks.append(0)

            for kind in draw.sample(["notice", "header", "menu", "advert"], draw.randint(0, 4)):
                other(kind)
            wrapper = _wrap(draw.choice(ARTICLES))
            for i, (text, leaf, linked) in enumerate(article):
                if i and draw.random() < 0.08:
                    other(draw.choice(_INSIDE), wrapper)
                blocks.append((text, outer + wrapper + ((leaf[0] if leaf[0] not in ("article", "main", "html", "body") else "p", ()),), linked))
                marks.append(1)
            for kind in draw.sample(["sidebar", "comments", "form", "share", "advert", "footer", "notice"], draw.randint(0, 6)):
                other(kind, wrapper if kind != "footer" and draw.random() < 0.2 else ())
            out.append((blocks, marks))
    return out


def train_field(pages: DataFrame, rows: int = 200, copies: int = 2) -> Field:
    """Train on at most about ``rows`` pages with an article or main element, chosen by a hash of the page's text."""
    told = pages.where(F.col("html").rlike("(?i)<(article|main)[\\s>]")).select("html")
    total = told.count()
    place = F.pmod(F.xxhash64("html", F.lit("labelled pages")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = sorted(r["html"] for r in told.where(place < F.lit(rows / max(total, 1))).collect())[: 2 * rows]
    parsed = [leaf_blocks(h) for h in chosen]
    labels = [own_labels(b) for b in parsed]
    ready = [(b, y) for b, y in zip(parsed, labels) if y is not None and any(y)]
    if not ready:  # no page tells its labels: layouts around spare text
        ready = [([(_SPARE[0], (("nav", ()),), 1.0), (_SPARE[1], (("article", ()), ("p", ())), 0.0)], [0, 1])] * 20
    whole = ready + dressed([b for b, _ in ready], [y for _, y in ready], copies)
    return Field().train([(features(b), y) for b, y in whole])


def main_text(pages: DataFrame, field: Field, blocks: bool = False) -> DataFrame:
    """Main text of every page: page_id, url, text and n_chars, its code points (other columns are ignored).

    The text is the article's blocks in page order, each with character references decoded and white space turned
    into single spaces, joined by a space; empty if a page has none or its html is null. With ``blocks`` also the
    labelled blocks, as (text, article). Repeated rows are handled once each.
    """
    shared = pages.sparkSession.sparkContext.broadcast(field)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        model = shared.value
        for part in slices(batches, "html"):
            out: dict[str, list] = {"page_id": part["page_id"], "url": part["url"], "text": [], "n_chars": []} | ({"blocks": []} if blocks else {})
            for page in part["html"]:
                found = leaf_blocks(page) if page else []
                labels = model.label(found)
                text = " ".join(b[0] for b, y in zip(found, labels) if y)
                out["text"].append(text)
                out["n_chars"].append(len(text))
                if blocks:
                    out["blocks"].append([{"text": b[0], "article": bool(y)} for b, y in zip(found, labels)])
            yield out

    types = dict(pages.select("page_id", "url").dtypes)
    schema = f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long" + (", blocks array<struct<text: string, article: boolean>>" if blocks else "")
    return arrow_map(pages.select("page_id", "url", "html"), work, schema)
