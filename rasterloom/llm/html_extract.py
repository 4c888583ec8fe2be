"""Main text of web pages: the maximum-scoring contiguous run of words and tags.

A page is a sequence of tags and words. Words score above zero, tags below; how much is learned
from labelled pages by what each kind of tag, in each kind of place, does there, and words in links
apart from others. A place is what markup around it says: content, something else, nothing, or
(where a page marks its content) beyond the content. One linear scan finds the contiguous stretch
with the greatest sum. From that stretch, blocks that are marked as something else (menus, notices,
adverts, forms, reader comments ...) are left out; what remains is the text, one line for each block.

A class or id marks a block only if all of its name does: ``ad-box`` is an advert, ``ad-hoc-rules``
isn't. Names mark no part of a sentence. A heading that only announces comments marks the rest of
its element.

Cases: null or empty html, or no words: empty text; html that breaks off anywhere, unclosed or
stray tags: read as a browser would, roughly; ties: the stretch that begins first; texts of any
length: linear; repeated rows: each gets its own result; extra columns: ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import prepare

#: A comment, a declaration, or the beginning of a tag, whose end ``Tags`` finds.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/><]*+)", re.S)
#: What matters within a tag: its end, another tag's beginning, a quoted value's beginning.
INSIDE = re.compile(r"[<>]|=\s*+[\"']")
#: Name and value of each attribute; values are passed over as a whole, whatever they hold.
ATTRIBUTE = re.compile(r"([^\s=/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
SIDE_ATTRIBUTES = frozenset("class id role hidden style aria-hidden".split())
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# Elements of HTML, by how they take part in a text.
RAW = frozenset("script style textarea title noscript template iframe object svg math canvas select option".split())
OPAQUE = frozenset("script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
ASIDE_TAGS = frozenset("nav footer aside form button dialog menu search head label".split())
CONTENT_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# What names of classes and ids say; the second list counts as the beginning of a name, too.
ASIDE_NAMES = frozenset("ad ads advert nav navbar menu header masthead footer aside promo banner gdpr notice signup login search share social widget popup modal tags pager pagination toolbar copyright legal topbar byline meta reply replies alert overlay".split())
ASIDE_BEGINNINGS = ("comment", "sidebar", "advert", "cookie", "consent", "footer", "newsletter", "sponsor", "navig", "breadcrumb", "subscri", "related", "recommend", "promo", "banner", "disqus", "disclaim")
CONTENT_NAMES = frozenset("content article post entry main story body text".split())
#: What the other parts of such a name may be.
SHAPE_NAMES = frozenset(
    "site page global primary secondary top bottom left right inner outer wrap wrapper container box block section area slot unit list item items link links button buttons bar strip panel"
    " group row col column grid content contents form field icon icons text title heading head body module component js mobile desktop sticky fixed float floating small large big new latest popular"
    " post posts article articles entry news feed stories card cards image img logo user author media info count counter thread this us to the and your my of on in for main article page view role".split()
)
# Blocks that hold sentences; a name within a sentence marks nothing.
SENTENCES = frozenset("p li td th dd dt h1 h2 h3 h4 h5 h6 blockquote figcaption caption pre".split())
#: Headings that only announce what readers wrote.
COMMENTS = re.compile(r"(\d+ |no |all |add a |post a |leave a |write a |reader |readers?['\u2019]s? |user |recent )*(comments?|responses|replies|reply)( \(?\d+\)?)?( (on|to|from) .*)?:?", re.I)
LEFT_OUT = ("aside", "inset")
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())


@dataclass
class Run:
    """A tag, or the text between two tags."""

    key: str
    words: int = 0
    text: str = ""
    breaks: bool = False  # a block begins or ends here
    aside: bool = False
    gold: bool = False  # for labelled pages


def side_of(name: str, attributes: str, in_content: bool, in_sentence: bool) -> str:
    """What an element is by its name and attributes: aside, content, or nothing (''). Within
    content, aside parts are insets: they belong to its stretch, though not to its text."""
    said = marked_side(name, attributes, in_content, in_sentence)
    return "inset" if said == "aside" and in_content else said


def names_aside(value: str, name: str, in_content: bool) -> bool:
    """Whether a class or an id marks something else than content. Parts of content and blocks of
    sentences are marked by a whole name only, containers elsewhere by any part of one."""
    for word in value.split():
        parts = [x.lower() for x in NAME_PARTS.findall(word)]
        if in_content and CONTENT_NAMES.intersection(parts):
            parts = [x for x in parts if x not in ("header", "meta", "tags", "legal", "alert", "notice", "social")]
        said = [x in ASIDE_NAMES or x.startswith(ASIDE_BEGINNINGS) for x in parts]
        if any(said) and (all(y or x in SHAPE_NAMES or len(x) == 1 for x, y in zip(parts, said)) or not (in_content or name in SENTENCES)):
            return True
    return False


def marked_side(name: str, attributes: str, in_content: bool, in_sentence: bool) -> str:
    part_of_sentence = in_content and in_sentence and name not in BLOCK
    if (name in ASIDE_TAGS and not (name == "label" and part_of_sentence)) or (name == "header" and not in_content):
        return "aside"
    said = "content" if name in CONTENT_TAGS else ""
    if attributes and not (name in HEADINGS or name in ("html", "body")):
        for key, a, b, c in ATTRIBUTE.findall(attributes):
            value, key = a or b or c, key.lower()
            if key not in SIDE_ATTRIBUTES:
                continue
            if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
                return "aside"
            if key == "role" and value.lower() in ASIDE_ROLES:
                return "aside"
            if key in ("class", "id"):
                if not part_of_sentence and names_aside(value, name, in_content):
                    return "aside"
                if CONTENT_NAMES.intersection(x.lower() for x in NAME_PARTS.findall(value)):
                    said = "content"
            if key == "role" and value.lower() in ("main", "article"):
                said = "content"
    return said


class Tags:
    """Comments, declarations and tags of a page in order; a tag and its values may have any length.

    Whether a tag ends is settled by where its last value ended, so a failed search is kept by those
    places: no later search goes over them again, and all of them together take linear time."""

    def __init__(self, page: str):
        self.page = page
        self.open_ended: set[int] = set()  # places after which a tag finds no end
        self.last = {q: page.rfind(q) for q in "\"'"}

    def end(self, at: int) -> int:
        """Place of the > that ends the tag whose attributes begin at ``at``, -1 where there is none."""
        passed = []
        while at not in self.open_ended:
            passed.append(at)
            m = INSIDE.search(self.page, at)
            if m and m[0] == ">":
                return m.start()
            if not m or m[0] == "<" or self.last[m[0][-1]] < m.end():
                break
            at = self.page.index(m[0][-1], m.end()) + 1
        self.open_ended.update(passed)
        return -1

    def find(self, at: int) -> tuple[int, int, str, str, str] | None:
        """Begin, end, slash, name and attributes of the first one from ``at`` on; comments and declarations have no name."""
        while m := TOKEN.search(self.page, at):
            if not m[2]:
                return m.start(), m.end(), "", "", ""
            if (end := self.end(m.end())) >= 0:
                return m.start(), end + 1, m[1], m[2].lower(), self.page[m.end() : end]
            at = m.start() + 1
        return None


def runs_of(page: str) -> list[Run]:
    """The page as tags and texts in order. Scripts, styles and the like are tags without words."""
    out: list[Run] = []
    # open elements: name, the side that holds within, whether content, a strict aside, or a block of sentences encloses it
    stack: list[tuple[str, str, bool, bool, bool]] = []
    opened: dict[str, int] = {}
    gold, at, size = False, 0, len(page)
    side, within, strict, sentence = "", False, False, False
    heading = 0  # where the last heading begins

    def settle() -> None:
        nonlocal side, within, strict, sentence
        _, side, within, strict, sentence = stack[-1] if stack else ("", "", False, False, False)

    def close(keep: int) -> None:
        for name, *_ in stack[keep:]:
            opened[name] -= 1
        del stack[keep:]

    def text(piece: str) -> None:
        if piece:
            words = len(piece.split())
            out.append(Run("word:" + side + ("/link" if opened.get("a") else ""), words, piece, False, side in LEFT_OUT, gold))

    last, tags = page.rfind(">"), Tags(page)
    while at < size:
        found = tags.find(at) if at <= last or page.find("<!--", at) >= 0 else None
        if not found:
            rest = page[at:]
            cut = re.search(r"<[a-zA-Z/!?][^<]*\Z", rest)  # a tag that breaks off at the end
            text(rest[: cut.start()] if cut else rest)
            break
        start, end, slash, name, attributes = found
        text(page[at:start])
        at = end
        if not name:
            if page[start:end] == "<!--[-->":
                gold = True
            elif page[start:end] == "<!--]-->":
                gold = False
            continue
        closes = bool(slash)
        if closes:
            before = side
            # an end tag without a beginning ends nothing, and none but its own ends an article
            for i in range(len(stack) - 1, -1, -1) if opened.get(name) else ():
                if stack[i][0] == name:
                    if before == stack[i][1] == "content" != (stack[i - 1][1] if i else ""):
                        before = "whole"
                    close(i)
                    break
                if stack[i][0] in CONTENT_TAGS and name not in ("body", "html"):
                    break
            settle()
            out.append(Run(f"/{name}:{before}", 0, "", name in BLOCK, before in LEFT_OUT, gold))
            if name in HEADINGS and stack and side not in LEFT_OUT:
                said = " ".join(entities.unescape("".join(r.text for r in out[heading:])).split())
                if said and len(said) < 200 and COMMENTS.fullmatch(said):
                    own = "inset" if within else "aside"
                    stack[-1] = (stack[-1][0], own, within, True, sentence)
                    for r in out[heading:]:
                        r.aside, r.key = True, r.key.partition(":")[0] + ":" + own
                    settle()
            continue
        if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == name:
            close(len(stack) - 1)
            settle()
        own = side_of(name, attributes, within, sentence)
        if own == "content" and side in LEFT_OUT and (strict or name not in CONTENT_TAGS):
            own = side
        whole = own == "content" != side  # content begins with this element
        side = own or side
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
            if end or name in OPAQUE:
                at = end.end() if end else size
            out.append(Run(f"raw:{side}", 0, " " if name not in OPAQUE else "", False, True, gold))
            settle()
            continue
        if name in HEADINGS:
            heading = len(out)
        out.append(Run(f"{name}:{'whole' if whole else side}", 0, " " if name == "br" else "", name in BLOCK, side in LEFT_OUT, gold))
        if name not in VOID and not attributes.endswith("/"):
            stack.append((name, side, within or own == "content", strict or (own in LEFT_OUT and name in ASIDE_TAGS), name in SENTENCES or (sentence and name not in BLOCK)))
            opened[name] = opened.get(name, 0) + 1
        settle()
    # where a page marks its content, what no mark encloses lies beyond it
    inside = sum(r.words for r in out if r.key.startswith("word:content"))
    plain = [r for r in out if r.key.partition(":")[2] in ("", "/link")]
    if inside and 4 * inside >= sum(r.words for r in plain):
        for r in plain:
            r.key = r.key.replace(":", ":beyond", 1)
    return out


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """Begin and end of the contiguous stretch with the greatest sum above zero, the first of several."""
    best, begin, end, total, start = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, begin, end = total, start, i + 1
    return begin, end


@dataclass
class Weights:
    """Score of one word and of one tag by its key; a tag that was never seen counts as ``unseen``."""

    value: dict[str, float] = field(default_factory=dict)
    unseen: float = -0.8
    #: The same within content, whose tags seldom end it.
    unseen_within: float = -0.05
    #: Bounds that keep words positive and tags negative.
    least_word: float = 0.01
    least_tag: float = -0.02

    def score(self, run: Run) -> float:
        if run.words:
            return run.words * self.value.get(run.key, self.least_word)
        if run.key.startswith("word:"):
            return 0.0
        return self.value.get(run.key, self.unseen_within if run.key.endswith((":content", ":inset")) else self.unseen)

    def region(self, runs: list[Run]) -> tuple[int, int]:
        return best_stretch([self.score(r) for r in runs])


def fit_weights(pages: list[str], *, rounds: int = 40, rate: float = 0.25) -> Weights:
    """Learn from pages in which <!--[--> and <!--]--> enclose the content.

    Weights begin as the log-odds of standing inside, and are corrected while the scan's stretch
    differs from the labelled one: what it has too much falls, what it lacks rises."""
    parsed = [runs_of(p) for p in pages]
    inside: dict[str, float] = {}
    outside: dict[str, float] = {}
    for runs in parsed:
        for r in runs:
            n = r.words or (0 if r.key.startswith("word:") else 1)
            (inside if r.gold else outside)[r.key] = (inside if r.gold else outside).get(r.key, 0) + n
    w = Weights()
    for key in {*inside, *outside}:
        odds = math.log((inside.get(key, 0) + 0.5) / (outside.get(key, 0) + 0.5))
        w.value[key] = min(max(odds, w.least_word), 2.0) if key.startswith("word:") else min(odds, w.least_tag)
    for _ in range(rounds):
        wrong = 0
        for runs in parsed:
            a, b = w.region(runs)
            if all((a <= i < b) == r.gold for i, r in enumerate(runs) if r.words):
                continue  # tags at either end may stay out
            wrong += 1
            for i, r in enumerate(runs):
                if (a <= i < b) != r.gold and (r.words or not r.key.startswith("word:")):
                    step = rate if r.gold else -rate
                    if r.key.startswith("word:"):
                        w.value[r.key] = min(max(w.value[r.key] + step / 10, w.least_word), 2.0)
                    else:
                        w.value[r.key] = min(w.value[r.key] + step, w.least_tag)
        if not wrong:
            break
    return w


def main_text(page: str | None, weights: Weights) -> str:
    """Blocks of the best stretch, one on a line."""
    if not page:
        return ""
    runs = runs_of(page)
    a, b = weights.region(runs)
    lines, block = [], []

    def end():
        line = " ".join(entities.unescape("".join(block)).split())
        if line:
            lines.append(line)
        block.clear()

    for r in runs[a:b]:
        if r.breaks:
            end()
        if not r.aside and r.text:
            block.append(r.text)
    end()
    return "\n".join(lines)


# ---------------------------------------------------------------- labelled pages


def labelled_pages() -> list[str]:
    """Pages of common layouts whose content is marked, with long and short articles in each."""
    link = "<li><a href='/x'>{}</a></li>"
    menu = "".join(link.format(x) for x in ("Home", "News", "Sport and games", "About us", "Contact"))
    say = "The council met on Tuesday evening and agreed to repair the old bridge before winter sets in."
    heads = [
        f"<nav><ul>{menu}</ul></nav>",
        f"<header><a href='/'>The Daily Paper</a><ul>{menu}</ul></header>",
        f"<div class='menu'><ul>{menu}</ul></div><div class='cookie-notice'><p>We use cookies to make this site work well for you. {say}</p><button>Accept all</button></div>",
        f"<div><ul>{menu}</ul></div><form><p>Search this site</p><input type='text'></form>",
        f"<nav>{menu}</nav><div class='ad'>{say} {say}</div>",
        f"<table><tr><td><a href='/a'>Home</a> <a href='/b'>News</a></td><td>",
    ]
    tails = [
        "<footer>&copy; The Daily Paper. All rights reserved.</footer>",
        f"<aside><h3>More</h3><ul>{menu}</ul></aside><footer><p>Imprint</p></footer>",
        f"<section id='comments'><h2>Comments</h2><div class='comment'><p>{say} I do not agree at all. {say}</p></div><div class='comment'><p>{say}</p></div></section>",
        f"<div class='sidebar'><p>{say} {say}</p></div><div class='footer'><p>Imprint and terms of use</p></div>",
        f"<div><ul>{menu}</ul></div><div><a href='/p'>Print</a> <a href='/m'>Mail</a></div>",
        f"<div><h3>2 Comments</h3><div><b>Bob</b><p>{say}</p></div><div><b>Eve</b><p>I do not agree at all. {say}</p><a href='/r'>Reply</a></div></div>",
        f"<div class='x7'><div class='x8'><p>{say} {say}</p></div><div class='x8'><p>I do not agree. {say}</p></div></div>",
    ]
    frames = [
        ("<article>", "</article>"),
        ("<main><article>", "</article></main>"),
        ("<div class='content'>", "</div>"),
        ("<div id='post'>", "</div>"),
        ("<div>", "</div>"),
        ("<section>", "</section>"),
    ]
    bodies = [
        f"<h1>Bridge to be repaired</h1><p>{say}</p><p>{say} {say}</p>",
        f"<h1>Bridge</h1><p><b>{say}</b><br>{say}</p><ul><li>{say}</li><li>{say}</li></ul><p>{say} See <a href='/z'>the plan</a>.</p>",
        f"<p>{say}",
        f"<header><h1>Bridge</h1><p class='byline'>By Ann Smith</p></header><p>{say}</p><aside>Read more</aside><p>{say}</p><div class='share'>Share this</div><p>The end.</p>",
        f"<h2>Repair</h2><p>{say}</p><div class='ad'>{say}</div><p>{say} {say}</p><blockquote>{say}</blockquote><p>{say}</p>",
        f"<h1>Bridge</h1><p>Yes.</p><p>{say}</p><table><tr><th>Year</th><th>Cost</th></tr><tr><td>2020</td><td>12</td></tr><tr><td>2021</td><td>14</td></tr></table><p>{say}</p>",
        f"<h1>Bridge</h1><p>In short: no.</p><figure><img src='b.png'><figcaption>The bridge in May</figcaption></figure><p>{say}</p><h2>Costs</h2><p>{say}</p><pre>a b</pre><p>End.</p>",
    ]
    out = []
    for i, head in enumerate(heads):
        for j, tail in enumerate(tails):
            for k, (before, after) in enumerate(frames):
                # parts that are left out stand within articles only where markup tells an article
                turn = (i + j + k) % (len(bodies) if k < 4 else 5)
                body = bodies[turn if turn < 3 or k < 4 else turn + 2]
                if k >= 4 and j == len(tails) - 1:
                    continue  # without any mark, comments look like an article
                out.append(f"<html><head><title>Bridge</title></head><body>{head}{before}<!--[-->{body}<!--]-->{after}{tail}</body></html>")
    return out


def extract_pages(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages."""
    spark = prepare(pages.sparkSession)
    shared = spark.sparkContext.broadcast(weights or fit_weights(labelled_pages()))

    def extract(parts):
        for batch in parts:
            text = [main_text(x.as_py(), shared.value) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.col("html")).mapInArrow(extract, "page_id long, url string, text string, n_chars long")
