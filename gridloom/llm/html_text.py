"""Main text of web pages by the maximum-scoring subsequence.

A page is a row of words and tags. Words score by the element they stand in
and tags by their kind, with weights from labelled pages; the contiguous part
with the largest sum is the content, found in one pass.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without an end tag, elements whose content is no text of the page (code, drawings, controls), elements that begin a block, and those that an opening block closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea select option button".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset(("body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"))
#: Elements, roles and parts of a class or id that mark what is not the article.
ASIDE_TAGS = frozenset("nav header footer aside form menu dialog head title".split())
ASIDE_NAMES = frozenset("ad ads adv advert advertisement advertising sponsored sponsor promo banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside related share sharing social cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login form search comment comments disqus reply replies widget toolbar pagination pager copyright legal disclaimer skip".split())
ARTICLE_TAGS = frozenset(("article", "main"))
#: Parts of a name that say how a page is laid out or set up, those whose header is a headline, those of what readers write, and elements that may end in their own tag.
LAYOUT, HEADED = frozenset("with without no has open closed status enabled disabled".split()), frozenset("entry article post content".split())
REPLIES, FOREIGN = frozenset("comment comments disqus reply replies".split()), frozenset(("svg", "math"))

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*(?:>|$)|<\?[^>]*(?:>|$)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*(?:>|$)", re.S)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTR = re.compile(r"\b(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[^a-z]+")
_SPACE = re.compile(r"\s+")
_END_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW | {"title"}}


def place(tag: str, attributes: str, outer: str, inner: bool = False) -> str:
    """The kind of place that an element opens: aside, article, or as outside it; with inner, an article ends the aside that it stands in."""
    named = bool(attributes) and tag not in ("html", "body") and is_aside(attributes, outer)
    if outer == "aside" or tag in ASIDE_TAGS:
        # a header in an article holds the article's own headline
        own = (tag == "header" and outer == "article") or (inner and tag in ARTICLE_TAGS)
        return "article" if own and not named else "aside"
    if named:
        return "aside"
    return "article" if tag in ARTICLE_TAGS else outer


def is_aside(attributes: str, outer: str = "plain") -> bool:
    """Whether a name in a class, id or role has a part that marks an aside. Names of a layout ('no-sidebar') and of a headline ('entry-header') do not."""
    for name in _names(attributes):
        parts = set(_PART.split(name))
        marks = parts & ASIDE_NAMES
        if outer == "article" or parts & HEADED:
            marks.discard("header")
        if marks and not parts & LAYOUT:
            return True
    return False


def _names(attributes: str) -> set[str]:
    found: set[str] = set()
    for m in _ATTR.finditer(attributes):
        found.update((m[2] or m[3] or m[4] or "").lower().split())
    return found


def tokens(page: str, kept: frozenset[int] = frozenset(), inner: bool = False, held: dict[int, int] | None = None) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, place) for every tag and run of text: kinds are open, close, void and text.

    kept: places in the page of elements that are no asides, whatever their
    names. held takes the words of each element that its name or form makes
    an aside, by its place in the page, and under -1 those of the whole page;
    words in other asides by tag (nav, footer) are not counted.
    """
    stack: list[tuple[str, str, int]] = []
    depth: Counter[str] = Counter()  # open elements by tag, so no step walks the stack in vain
    watched: list[int] = []  # places of open elements whose words are counted
    at, where = 0, "plain"

    def push(tag: str, place_: str, mark: int) -> None:
        stack.append((tag, place_, mark))
        depth[tag] += 1
        if tag in ASIDE_TAGS and tag != "form":
            depth["*"] += 1
        if mark >= 0:
            watched.append(mark)

    def pop() -> str:
        tag, _, mark = stack.pop()
        depth[tag] -= 1
        if tag in ASIDE_TAGS and tag != "form":
            depth["*"] -= 1
        if mark >= 0:
            words = held.get(mark, 0)
            watched.pop()
            if watched:  # an element's words are those of the one around it, too
                held[watched[-1]] = held.get(watched[-1], 0) + words
        return tag

    def count(text: str) -> None:
        if held is not None and not depth["*"]:
            n = len(text.split())
            held[-1] = held.get(-1, 0) + n
            if watched:
                held[watched[-1]] = held.get(watched[-1], 0) + n

    def finish() -> None:
        while stack:
            pop()

    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            count(page[at:])
            finish()
            yield "text", page[at:], where
            return
        if m.start() > at:
            count(page[at : m.start()])
            yield "text", page[at : m.start()], where
        at = m.end()
        name = _NAME.match(m[0])
        if name is None:
            continue
        tag = name[1].lower()
        if m[0][1] == "/":
            if depth[tag]:
                while pop() != tag:
                    pass
                where = stack[-1][1] if stack else "plain"
            yield "close", tag, where
        elif tag in _END_RAW and not (tag in FOREIGN and m[0].endswith("/>")):
            end = _END_RAW[tag].search(page, at)
            at = end.end() if end else len(page)
            yield "void", tag, where
        elif tag in VOID or (tag in FOREIGN and m[0].endswith("/>")):
            yield "void", tag, where
        else:
            if tag in CLOSES_P and depth["p"]:
                # an open paragraph ends here, with the inline elements in it
                cut = len(stack) - 1
                while stack[cut][0] != "p" and stack[cut][0] not in BLOCK:
                    cut -= 1
                if stack[cut][0] == "p":
                    while len(stack) > cut:
                        pop()
            outer, attributes = stack[-1][1] if stack else "plain", m[0][name.end() : -1]
            if m.start() in kept:
                where = "article" if tag in ARTICLE_TAGS and (inner or outer != "aside") else outer
            else:
                where = place(tag, attributes, outer, inner)
            wraps = held is not None and tag not in ("html", "body") and (tag == "form" or (tag not in ASIDE_TAGS and attributes and is_aside(attributes) and not _names_parts(attributes) & REPLIES))
            push(tag, where, m.start() if wraps else -1)
            yield "open", tag, where
    finish()


def _names_parts(attributes: str) -> set[str]:
    return {p for name in _names(attributes) for p in _PART.split(name)}


def placed(page: str) -> list[tuple[str, str, str]]:
    """The tokens of a page. An element that holds most of its words is a wrapper and no aside, whatever its name; where all articles stand in asides, an article ends the aside around it."""
    held: dict[int, int] = {}
    seq = list(tokens(page, held=held))
    kept = frozenset(k for k, n in held.items() if k >= 0 and 2 * n > held[-1])
    if kept:
        seq = list(tokens(page, kept))
    if not any(where == "article" for _, _, where in seq) and any(kind == "open" and value in ARTICLE_TAGS for kind, value, _ in seq):
        seq = list(tokens(page, kept, inner=True))
    return seq


#: Pages whose content is known, from which the weights come: (place, is content) for words, as (tag, is content) for what surrounds a tag.
LABELLED = [
    ("<html><head><title>T one</title></head><body><nav><ul><li><a>Home</a></li><li><a>News</a></li></ul></nav><article><h1>[Head line one]</h1><p>[Some words of the text stand here and go on for a while.]</p><p>[More words in another paragraph, with <b>bold</b> ones.]</p></article><footer>Rights reserved</footer></body></html>"),
    ("<html><body><div class='menu'><a>Start</a><a>About us</a></div><div id='content'><h2>[A second head]</h2><p>[Long sentences make up the content of a page as a rule.]</p><ul><li>[first point of a list]</li><li>[second point]</li></ul></div><div class='comments'><p>Nice post, thanks</p></div></body></html>"),
    ("<html><body><header><h1>Site</h1></header><main><p>[The main part of the page has all of its words here.]</p><p>[It ends with this one.]</p></main><aside><h3>Related</h3><a>Other page</a></aside><form><label>Mail</label><input></form></body></html>"),
    ("<html><body><div class='ad'>Buy this now while it lasts</div><p>[Only paragraphs follow one another on this page.]</p><p>[Nothing else marks them as the text of the page.]</p><div class='cookie-notice'>We use cookies</div></body></html>"),
    ("<html><body><table><tr><td><a>Index</a></td><td><p>[Old pages lay out their text in tables of cells.]</p><p>[The second paragraph is as long as the first one.]</p></td></tr></table><div class='footer'>Contact us</div></body></html>"),
]


def learn(pages: list[str]) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of words by place and of tags by name: log-odds of content with one added, words clipped to [-8, 2] and tags to [-3, -0.1]."""
    words, tags = Counter(), Counter()
    for page in pages:
        inside = False
        for kind, value, where in tokens(page):
            if kind == "text":
                for part in re.findall(r"[\[\]]|[^\s\[\]]+", value):
                    if part in "[]":
                        inside = part == "["
                    else:
                        words[where, inside] += 1
            else:
                tags[value, inside] += 1
    odds = lambda c, k: math.log((c[k, True] + 1) / (c[k, False] + 1))
    word = {p: min(2.0, max(-8.0, odds(words, p) * (4 if p == "aside" else 1))) for p in ("plain", "article", "aside")}
    tag = {t: min(-0.1, max(-3.0, odds(tags, t))) for t in {t for t, _ in tags}}
    return word, tag


WORD_WEIGHT, TAG_WEIGHT = learn(LABELLED)


def main_text(page: str | None, word: dict[str, float] = WORD_WEIGHT, tag: dict[str, float] = TAG_WEIGHT) -> str:
    """The blocks of the best contiguous part, joined by a blank line; empty for null, empty and wordless pages.

    Where a page has article or main elements, words outside any of them score
    below zero, so the part runs from the first to the last of them. In the
    part, blocks that stand aside (adverts, forms, comments) and what stands
    between two articles are left out and cost next to nothing, however long
    they are.
    A part of equal score that begins earlier wins.
    """
    if not page:
        return ""
    seq = placed(page)
    marked = any(where == "article" for _, _, where in seq)
    best, best_at, total, begin, spent = 0.0, (0, 0), 0.0, 0, 0.0
    for i, (kind, value, where) in enumerate(seq):
        if kind == "text":
            n = len(value.split())
            weight = word[where]
            if marked and where == "plain":
                weight = -2.0
            elif where != "aside":
                weight = max(weight, 0.5)
            score = n * weight
            if n and where != "aside" and not (marked and where == "plain"):
                spent = 0.0
        else:
            score = tag.get(value, -0.5) * (0.02 if marked and where == "article" else 0.2)
        if where == "aside" or (marked and where == "plain"):
            # what is left out below doesn't part the content: all of it between two words of the content costs 1 at most
            score = max(score, -1.0 - spent)
            spent += score
        if total <= 0:
            total, begin = 0.0, i
        total += score
        if total > best:
            best, best_at = total, (begin, i + 1)
    blocks: list[str] = []
    open_: list[str] = []
    before = "".join

    def close() -> None:
        text = _SPACE.sub(" ", html.unescape(before(open_))).strip()
        if text:
            blocks.append(text)
        open_.clear()

    for kind, value, where in seq[best_at[0] : best_at[1]]:
        if kind == "text":
            if where != "aside" and not (marked and where == "plain"):
                open_.append(value)
        elif value in BLOCK:
            close()
        elif value == "br":
            open_.append(" ")
    close()
    return "\n\n".join(blocks)


def extract(pages: DataFrame, html_column: str = "html", *keep: str) -> DataFrame:
    """The columns named by keep (default: all but the html) and text, for every row.

    Null and empty html give an empty text; nothing is capped. Only the page
    itself is looked at, so repeated rows give repeated results; a column of
    the input named text is replaced.
    """
    names = [c for c in (keep or pages.columns) if c not in (html_column, "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                out = [main_text(t) for t in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(out, pa.string())], names=[*names, "text"])

    kept = pages.select(*names)
    return pages.select(*names, F.col(html_column).cast("string").alias("__html")).mapInArrow(run, kept.schema.add("text", "string"))
