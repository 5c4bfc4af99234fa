"""Operator 10: main text of web pages by two-pass block rules."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Frequent function words of four languages.
STOP_WORDS = frozenset(
    """the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when
    le la les de des du et en un une est que qui dans pour pas sur au par plus ne se ce avec sont il elle nous vous ils mais ou
    der die das und ist von zu den mit sich auf für nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um
    el los las y del se por con para su al lo como más pero sus le ya este sí porque esta entre cuando muy sin sobre""".split()
)
_SKIPPED = frozenset("script style noscript template iframe object embed svg canvas head title form select option button textarea input fieldset datalist audio video map".split())
_RAW = frozenset("script style textarea title noscript iframe template".split())
_BOILER = frozenset("nav footer header aside menu dialog".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Names of boilerplate wherever it stands, and names that count outside articles only.
_ALWAYS = frozenset(
    """ad ads adsense advert advertisement advertising banner promo promotion sponsor sponsored sidebar nav navbar navigation breadcrumb breadcrumbs menu
    cookie cookies consent gdpr popup modal newsletter subscribe social share sharing related recommended recommendations
    comment comments commentlist disqus replies respond login toolbar pagination pager""".split()
)
_OUTSIDE = frozenset("header footer masthead".split())
#: Words that also occur in names of prose (legal-background): they count alone, and outside articles only.
_ALONE = frozenset("side foot notice legal copyright tags search skip".split())
_PROSE = frozenset("blockquote q cite h1 h2 h3 h4 h5 h6 strong em b i span code pre table figure".split())
#: Tokens that say what a page has or lacks, not what an element is.
_ABOUT = re.compile(r"(?:has|have|no|not|with|without|hide|show)[_\-]", re.IGNORECASE)
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    linked: int
    boiler: bool
    article: bool
    tag: str
    label: str = ""


def _boiler(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is boilerplate by its name, or by the first or last part of a class, id or role."""
    if name in _BOILER:
        return not (name == "header" and in_article)
    if not attributes or name in ("html", "body", "article", "main") or in_article and name in _PROSE:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        for token in " ".join(filter(None, m.groups()[1:])).lower().split():
            if _ABOUT.match(token):
                continue
            parts = re.split(r"[-_]+", token.strip("-_0123456789"))
            ends = {parts[0], parts[-1]}
            if ends & _ALWAYS or not in_article and (ends & _OUTSIDE or token in _ALONE):
                return True
    return False


def blocks(page: str, named: bool = True) -> list[Block]:
    """Text blocks in page order, with how much of each is inside links and where it stands.

    Without ``named`` only element names make boilerplate outside articles, not classes and ids.
    """
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # name, skipped, boilerplate, article
    parts: list[str] = []
    linked, links = 0, 0

    def state() -> tuple[bool, bool, bool]:
        return stack[-1][1:] if stack else (False, False, False)

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            _, boiler, article = state()
            out.append(Block(text, linked, boiler, article, next((s[0] for s in reversed(stack) if s[0] in _BLOCK), "")))
        parts.clear()
        linked = 0

    def pop_to(name: str) -> None:
        nonlocal links
        while stack:
            top = stack.pop()[0]
            links -= top == "a"
            if top == name:
                return

    at = 0
    while at < len(page):
        m = _TAG.search(page, at)
        stop = m.start() if m else len(page)
        if stop > at and not state()[0]:
            text = html.unescape(page[at:stop])
            parts.append(text)
            if links:
                linked += len("".join(text.split()))
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in _BLOCK:
            flush()
        if m[1]:
            if any(s[0] == name for s in stack):
                pop_to(name)
            continue
        if name in _RAW and not m[3].endswith("/"):
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = close.end() if close else len(page)
            continue
        if name in _VOID or m[3].endswith("/"):
            continue
        if name == "body":
            stack.clear()
            links = 0
        if name in _CLOSES:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in _CLOSES[name]:
                    pop_to(stack[k][0])
                    break
                if stack[k][0] in ("ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "select"):
                    break
        elif name in _BLOCK and stack and stack[-1][0] == "p":
            pop_to("p")
        skipped, boiler, article = state()
        inside = article or name in ("article", "main")
        marked = _boiler(name, m[3] if named or article else "", article)
        stack.append((name, skipped or name in _SKIPPED, boiler or marked, inside))
        links += name == "a"
    flush()
    return out


def first_pass(found: list[Block], low: float = 0.15, high: float = 0.3, short: int = 70, long: int = 200, max_links: float = 0.33) -> None:
    """Stop-word density, length and link density label blocks good, bad, near (nearly good) or short.

    Long text without links is near at least: its language may have other stop words, or no blanks.
    """
    for b in found:
        size = max(1, len(b.text.replace(" ", "")))
        words = _WORD.findall(b.text.lower())
        stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
        links = b.linked / size
        if b.boiler:
            b.label = "bad"
        elif links > max_links:
            b.label = "short" if b.article and b.tag == "p" else "bad"
        elif len(b.text) < short:
            b.label = "bad" if b.linked and not b.article else "short"
        elif stops >= high:
            b.label = "good" if len(b.text) > long else "near"
        elif stops >= low or not b.linked or b.article:
            b.label = "near"
        else:
            b.label = "bad"


def second_pass(found: list[Block]) -> None:
    """Near and short blocks take the label of the nearest decided neighbour, at equal distance the good one's.

    What markup alone makes boilerplate decides nothing about its neighbours, and blocks in and outside articles are no
    neighbours of each other.  Where no block is good the longest of those near it counts as
    good, or else the longest short paragraph.
    """
    for inside in (True, False):
        own = [b for b in found if b.article == inside and not b.boiler]
        decided = [i for i, b in enumerate(own) if b.label in ("good", "bad")]
        if not any(own[i].label == "good" for i in decided):
            # No block passes alone: the longest near one, or else the longest short paragraph or heading, stands for the text.
            near = [i for i, b in enumerate(own) if b.label == "near" or b.label == "short" and (inside or b.tag in ("p", "h1", "h2", "h3"))]
            if near:
                best = max(near, key=lambda i: (own[i].label == "near", len(own[i].text), -i))
                own[best].label = "good"
                decided = sorted([*decided, best])
        labels = [own[i].label for i in decided]
        at = 0
        for i, b in enumerate(own):
            while at < len(decided) and decided[at] < i:
                at += 1
            if b.label in ("good", "bad"):
                continue
            sides = [(abs(decided[k] - i), labels[k] != "good", labels[k]) for k in (at - 1, at) if 0 <= k < len(decided)]
            b.label = min(sides)[2] if sides else "bad"


def main_text(page: str) -> str:
    """The page's article: good blocks in order, one space between.

    An article or main element is a prior: where its good blocks hold at least half as much text as the good blocks outside,
    the others are left out, else the elements are teasers.  Where classes and ids leave no text, or none of the page's
    articles, a wrapper has such a name: then they do not count outside articles.
    """
    text = ""
    for named in (True, False):
        found = blocks(page, named)
        first_pass(found)
        second_pass(found)
        good = [b for b in found if b.label == "good"]
        marked = [b for b in good if b.article]
        other = [b for b in good if not b.article]
        if 2 * sum(len(b.text) for b in marked) < sum(len(b.text) for b in other):
            marked = []
        if marked or not text:
            text = " ".join(b.text for b in marked or other)
        if marked or text and (other or not any(b.article for b in found)):
            break
    return text


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row a page.

    Null and empty pages have an empty text, broken markup is read as far as it goes, a page of any length is read whole,
    repeated rows are alike, further columns go no further, an empty table gives no rows.
    """

    def batches(it):
        for batch in it:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(batches, "page_id bigint, url string, text string, n_chars bigint")
