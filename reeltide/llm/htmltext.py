"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags; each has its length, the share of it inside links, the share of its words that are stop
words, and the containers around it. First pass: blocks in menus, headers, footers, sidebars, notices, adverts, forms and comments (by tag, by hidden styles, or where a whole class, id or role
names one), and blocks that are mostly links, are out; inside an article, headers and such containers as forms, menus, banners and widgets are out only as far as their
blocks do not read like an article's, as is what noscript holds, unless the page shows it besides; blocks of an article and long blocks with enough stop words are in; the rest are undecided:
nearly good, short, or poor. On a page with next to no stop words, one in a language that is not listed, length decides in place of stop words. Second pass: undecided ones take the label of their nearest decided neighbours
(blocks that their container puts out are no neighbours).

Scale: one map over the pages, no shuffle; each page is scanned once, in time linear in its length.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from reeltide.llm.common import read

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup; it is skipped up to the closing tag.
RAW = frozenset("script style annotation annotation-xml template textarea iframe title svg object select noembed noframes xmp".split())
OUT_TAGS = frozenset("nav footer aside form button dialog menu head fieldset label".split())
IN_TAGS = frozenset(("article", "main"))
#: Words of a class, id or role that name what is not of the article.
OUT_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus nav navbar navigation newsletter notice notices pager pagination related replies reply respond share sharing shoutbox sidebar sponsor sponsored subscribe complementary contentinfo".split()
)
#: The same, but in an article they also stand for parts of it: there the density rules have the last word.
LOOSE_WORDS = frozenset("alert banner disclaimer discussion footer form header login masthead menu modal popup promo promoted search signup skip social tags toolbar widget".split())
#: Words that say where or how a container stands, not what is in it.
PLACES = frozenset("area bar bars block body bottom box button buttons center col column container content count counts desktop fixed global group icon icons inner item items left links list main mobile off outer page primary right row secondary section site small sticky text tool tools top unit widgets wrap wrapper zone".split())
#: After these a word says what the container has or lacks.
TURNS = frozenset("has hide hides is js no non not show toggle with without".split())
#: Closed by the next tag of one of these kinds, if still open.
CLOSES = {"p": BLOCKS, "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "tbody", "tfoot")), "td": frozenset(("td", "th", "tr", "tbody", "tfoot")), "th": frozenset(("td", "th", "tr", "tbody", "tfoot")), "option": frozenset(("option", "optgroup"))}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

#: Frequent function words of the languages read here; enough to tell running text from lists of names.
STOP_WORDS = frozenset(
    "a an and are as at be by for from has have he in is it its not of on or that the this to was were which with you "
    "au aux avec ce ces dans de des du elle en est et il la le les mais ne ou par pas pour que qui sa se son sur un une vous "
    "als am auf aus bei das dem den der des die ein eine er es für im in ist mit nicht sich sie sind und von war wie zu zum "
    "al como con de del el en es esta la las lo los más no o para pero por que se son su sus un una y ya".split()
)
LONG, SHORT, MANY_LINKS, FEW_STOPS, MANY_STOPS = 140, 70, 0.3, 0.12, 0.3
#: Below this share of stop words over the whole page, its language is taken as one that is not listed.
NO_STOPS = 0.06
RIGHTS = ("©", "copyright", "all rights reserved")

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _names(token: str, words: frozenset[str]) -> bool:
    """Whether a whole class, id or role names one of `words`: such as site-footer, blog-comments, sidebar-left or ad-1, not has-sidebar or login-guide."""
    parts = [p.lower() for p in _PART.findall(token)]
    if not any(p in words for p in parts) or any(p in TURNS for p in parts):
        return False
    return parts[-1] in words or all(p in OUT_WORDS or p in LOOSE_WORDS or p in PLACES or p.isdigit() for p in parts)


def _marks(attributes: str) -> int:
    """2 if the attributes of a tag put its content out, 1 if only by a word that an article may use for parts of its own, else 0."""
    out = 0
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value)):
            return 2
        if name in ("class", "id", "role"):
            for token in value.split():
                if _names(token, OUT_WORDS):
                    return 2
                if _names(token, LOOSE_WORDS):
                    if "site" in (p.lower() for p in _PART.findall(token)):  # the site's, not the article's
                        return 2
                    out = 1
    return out


class Block:
    __slots__ = ("inside", "linked", "out", "parts", "tag")

    def __init__(self, tag: str, inside: bool, out: int):
        self.tag, self.inside, self.out, self.parts, self.linked = tag, inside, out, [], []


#: (text, tag, share inside links, inside an article, 2 in a container that is out, 1 in one that is out unless the density rules say otherwise)
Told = tuple[str, str, float, bool, int]


class Open:
    """The tags that are open: of each its name, whether it is inside an article, how far it is out, and where the next block-level one is at or below it."""

    def __init__(self):
        self.stack: list[tuple[str, bool, int, int]] = []
        self.count: dict[str, int] = {}

    def push(self, tag: str, inside: bool, out: int) -> None:
        at = len(self.stack)
        self.stack.append((tag, inside, out, at if tag in BLOCKS else self.block(at - 1)))
        self.count[tag] = self.count.get(tag, 0) + 1

    def block(self, at: int) -> int:
        return self.stack[at][3] if at >= 0 else -1

    def cut(self, size: int) -> None:
        while len(self.stack) > size:
            self.count[self.stack.pop()[0]] -= 1

    def close(self, tag: str) -> None:
        if self.count.get(tag):
            while self.stack[-1][0] != tag:
                self.cut(len(self.stack) - 1)
            self.cut(len(self.stack) - 1)

    def closed_by(self, tag: str) -> None:
        """Ends what a block-level tag ends by itself, looked for up to the next container."""
        at = self.block(len(self.stack) - 1)
        while at >= 0 and self.stack[at][0] in CLOSES:
            if tag in CLOSES[self.stack[at][0]]:
                self.cut(at)
                return
            at = self.block(at - 1)

    def top(self) -> tuple[bool, int]:
        return self.stack[-1][1:3] if self.stack else (False, 0)

    def block_tag(self) -> str:
        at = self.block(len(self.stack) - 1)
        return self.stack[at][0] if at >= 0 else ""


def blocks(page: str) -> list[Told]:
    """Each block with text, in page order."""
    found: list[Block] = []
    opened = Open()
    current = Block("", False, 0)
    links, i, n = 0, 0, len(page)

    def cut() -> Block:
        if current.parts:
            found.append(current)
        return Block("noscript" if opened.count.get("noscript") else opened.block_tag(), *opened.top())

    while i < n:
        j = page.find("<", i)
        if j < 0:
            j = n
        if j > i:
            current.parts.append(page[i:j])
            current.linked.append(links > 0)
        if j >= n:
            break
        if page.startswith("<!--", j):
            end = page.find("-->", j + 4)
            i = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), j):
            end = page.find(">", j)
            i = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, j) or _LOOSE.match(page, j)
        if not m:
            if re.match(r"</?[a-zA-Z]", page[j : j + 3]):  # a tag that never ends
                break
            current.parts.append("<")
            current.linked.append(links > 0)
            i = j + 1
            continue
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        i = m.end()
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            opened.close(tag)
            if tag in BLOCKS or opened.top()[1] != current.out:
                current = cut()
            continue
        if tag in RAW:
            if attributes.rstrip().endswith("/") and tag in ("svg", "math", "object"):
                continue
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, i)
            i = n if end is None else end.end()
            continue
        if tag in BLOCKS:
            opened.closed_by(tag)
        if tag == "br":
            current.parts.append("\n")
            current.linked.append(links > 0)
            continue
        if tag in VOID or attributes.endswith("/"):
            if tag in BLOCKS:
                current = cut()
            continue
        if tag == "a":
            links += 1
        inside, out = opened.top()
        inside = inside or tag in IN_TAGS
        if tag in OUT_TAGS:
            out = 2
        elif tag == "header":
            out = max(out, 1 if inside else 2)
        elif tag == "noscript":  # often a notice or a picture, on lazy pages the article
            out = max(out, 1)
        elif attributes and tag not in ("html", "body") and tag not in IN_TAGS:
            mark = _marks(attributes)
            out = max(out, mark if inside else 2 * mark)
        opened.push(tag, inside, min(out, 2))
        if tag in BLOCKS or min(out, 2) != current.out:  # an inline container that is out is a block of its own
            current = cut()
    if current.parts:
        found.append(current)

    told = []
    for b in found:
        text = " ".join(entities.unescape("".join(b.parts)).split())
        if text:
            linked = sum(len("".join(p.split())) for p, is_link in zip(b.parts, b.linked, strict=True) if is_link)
            told.append((text, b.tag, linked / max(1, sum(len("".join(p.split())) for p in b.parts)), b.inside, b.out))
    shown = {b[0] for b in told if b[1] != "noscript"}
    return [b for b in told if b[1] != "noscript" or b[0] not in shown]


def stop_share(text: str) -> float:
    stops = [w.strip(".,;:!?()\"'").lower() in STOP_WORDS for w in text.split()]
    return sum(stops) / len(stops)


def first_pass(found: list[Told]) -> list[str]:
    """in, out and gone (in a container that is out); undecided: short, near (nearly good) and poor."""
    article = any(inside and out < 2 for _, _, _, inside, out in found)
    judged = [out < 2 and (out == 1 or not (article and inside)) and linked <= MANY_LINKS for _, _, linked, inside, out in found]
    shares = [stop_share(b[0]) if j else 0.0 for b, j in zip(found, judged, strict=True)]
    size = sum(len(b[0]) for b, j in zip(found, judged, strict=True) if j)
    foreign = sum(len(b[0]) * s for b, s in zip(found, shares, strict=True)) < NO_STOPS * size  # by length, as not all scripts part words
    first = []
    for (text, tag, linked, inside, out), density in zip(found, shares, strict=True):
        if out == 2:
            first.append("gone")
        elif out == 1:  # only what reads like running text, or is a heading, stays
            running = tag == "p" and (len(text) >= SHORT or density >= FEW_STOPS)
            good = linked <= MANY_LINKS and not text.lower().startswith(RIGHTS) and (tag in HEADINGS or running or (len(text) >= LONG and (foreign or density >= MANY_STOPS)))
            first.append("in" if good else "gone")
        elif article and inside:
            first.append("in" if linked <= 0.8 or len(text) >= LONG else "short")
        elif text.lower().startswith(RIGHTS):
            first.append("out")
        elif linked > MANY_LINKS:
            first.append("out")
        elif len(text) < SHORT and tag != "p":
            first.append("short")
        elif (foreign or density >= MANY_STOPS) and len(text) >= LONG:
            first.append("in")
        elif foreign or density >= FEW_STOPS or len(text) < SHORT:
            first.append("near")
        else:
            first.append("poor")
    return first


def labels(found: list[Told]) -> list[bool]:
    """Which of the blocks belong to the main text."""
    first = first_pass(found)
    n = len(first)

    def nearest(step: int) -> list[tuple[str | None, int]]:
        out_, seen, at = [(None, n)] * n, None, 0
        for i in range(n) if step > 0 else range(n - 1, -1, -1):
            out_[i] = (seen, abs(i - at) if seen else n)
            if first[i] in ("in", "out"):
                seen, at = first[i], i
        return out_

    before, after = nearest(1), nearest(-1)
    kept = []
    for i, what in enumerate(first):
        if what in ("in", "out", "gone"):
            kept.append(what == "in")
            continue
        (a, da), (b, db) = before[i], after[i]
        if a is None and b is None:
            kept.append(True)  # nothing decided on the page
        elif what == "near":
            kept.append("in" in (a, b) or a is None or b is None)
        elif what == "short":
            kept.append(a == b == "in" or (found[i][1] in HEADINGS and b == "in") or (a != b and "in" in (a, b) and (a == "in") == (da < db)))
        else:
            kept.append(a == b == "in")
    return kept


def main_text(page: str | None) -> str:
    """The blocks of the main text, one a line; a null or empty page has none."""
    found = blocks(page or "")
    return "\n".join(b[0] for b, keep in zip(found, labels(found), strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """Every page's main text: page_id, url, text, n_chars (code points).

    Null and empty html give an empty text; text without any tag is one block; broken markup is read as far as it goes. Repeated rows and
    null ids are kept as they are; an empty table gives no rows. Other columns are not read.
    """

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", "html")
    return rows.mapInArrow(told, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op2_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


QUERIES = {"op2_htmltext": op2_htmltext}
ORACLES: dict[str, str] = {}
