"""Main text of web pages by line-block distribution.

One forward scan strips the markup: scripts, styles, comments and other invisible elements go; block elements end a line,
inline elements do not. Lines inside menus, headers, footers, sidebars, notices, adverts, forms and reader comments (by
element, role, or class and id words) are boilerplate and weigh nothing; other lines weigh their characters outside links.
Words in a class or id rule out no element that holds the page's text (`judged`).

The weights of WINDOW consecutive lines are summed; text surges where the sum reaches the threshold and dives where it falls
to zero, and the lines between a surge and its dive are a run. The threshold is THRESHOLD characters, or half of the page's
largest sum if that is less. Lines with text right before a surge (a short heading, a first line) belong to its run. What
runs are kept is their text, boilerplate apart: lines of links alone steer where text opens and closes, not what is kept.

Elements only help the distribution along: they raise the weights of their lines by the threshold, so that every line of
theirs surges, and end a run where they end. These are the article and main elements, if they hold the page's text (`trusted`;
runs that touch none of them are then left out), else the innermost container that holds nearly all text of the runs of a
first pass and is no list of links.

Defined results: NULL, empty and text-free pages give an empty text; character references are decoded once, after the
markup is gone; a tag that never closes lasts to its parent's end; a quote within an unquoted value is an ordinary character,
one that never closes too; white space is what Unicode calls so, no-break spaces included; repeated pages are extracted each.
Nothing is cut off, whatever the length, and the time grows with the length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktempo.llm.common import struct_array, text_udf

WINDOW, THRESHOLD, DOMINANT, NEARLY = 3, 86, 4, 0.9

#: Element and attribute names; fixed values.
RAW = set("script style textarea title".split())
HIDDEN = set("noscript template svg math iframe object canvas video audio map select".split())
BLOCKS = set("""address article aside blockquote body br caption center col colgroup dd details dialog dir div dl dt
fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p
pre section summary table tbody td tfoot th thead tr ul""".split())
CONTAINERS = set("div section td center".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = set("nav header footer aside form menu dialog button label fieldset".split())
WORDS = set("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidebars
aside menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar notice notices cookie
cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related
recommended comment comments reply replies respond disqus discussion pagination pager search widget widgets skip hidden
alert copyright legal disclaimer form""".split())
COMMENTS = set("comment comments reply replies respond disqus".split())
#: Words that are a matter of an article as well: inside of one they rule out what is mostly links.
SUBJECTS = set("related recommended discussion search alert copyright legal disclaimer social notice notices".split())
#: First or last part of a name that tells a state of the page: no-sidebar, has-sidebar, with-comments, comments-open.
STATES = set("no not non has have with without".split()), set("open closed on off enabled disabled".split())
ROLES = set("navigation banner contentinfo complementary search form menu menubar dialog alert".split())

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
BEFORE, ATTRIBUTE, EQUALS, UNQUOTED = (re.compile(r) for r in (r"[\s/]*", r"=?[^\s/>=]*", r"\s*=\s*", r"[^\s>]*"))
PLAIN = re.compile(r"([^\s/=]+)(?:\s*=\s*(\S+))?")
CLOSES = re.compile(r"</(" + "|".join(sorted(HIDDEN | RAW)) + r")(?=[\s/>])", re.I)
NAME_PART = re.compile(r"[a-z0-9]+")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Line(NamedTuple):
    text: str
    weight: int  #: characters outside links; 0 in boilerplate
    linked: int  #: characters in links
    article: int  #: number of the outermost article or main element around it, 0 for none
    bad: bool
    held: int  #: the innermost element around it that class or id words speak of, -1 for none


class Named(NamedTuple):
    """An element whose class or id holds one of WORDS."""

    says: str  #: "weak" boilerplate or something else, "strong", "subject", or "comments"
    around: int  #: the next such element around it, -1 for none
    article: int  #: the article it lies in


class Element(NamedTuple):
    """An open element; `first` is the number of its first line."""

    name: str
    unwanted: bool
    named: int
    hidden: bool
    first: int


def said_by(attributes: dict[str, str]) -> str:
    """What the class and id of an element say; "" for nothing."""
    parts: list[str] = []
    word = False
    for name in ("class", "id"):
        for token in attributes.get(name, "").lower().split():
            each = NAME_PART.findall(token)
            state = len(each) > 1 and (each[0] in STATES[0] or each[-1] in STATES[1])
            word |= not state and not WORDS.isdisjoint(each)
            parts += ["state"] if state else each
    if not word:
        return ""
    if not COMMENTS.isdisjoint(parts):
        return "comments"
    if WORDS.isdisjoint(set(parts) - SUBJECTS):
        return "subject"
    return "strong" if WORDS.issuperset(parts) else "weak"


def unwanted(tag: str, attributes: dict[str, str], inside_article: bool) -> bool:
    """Is the element boilerplate by its tag, role or style? A header of the article itself is not."""
    if tag in BOILERPLATE and not (tag == "header" and inside_article):
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    return (attributes.get("role", "").lower() in ROLES or "hidden" in attributes
            or attributes.get("aria-hidden", "").lower() == "true"
            or "style" in attributes and bool(INVISIBLE.search(attributes["style"].lower())))


class Scanner:
    """Reads tags of one page from left to right; nothing is read twice."""

    def __init__(self, page: str):
        self.page, self.lost = page, set()  # quotes that do not occur any more

    def attributes(self, at: int) -> tuple[int, dict[str, str]] | None:
        """Where the tag whose name ends at `at` ends, and its attributes; None if it does not end."""
        page = self.page
        end = page.find(">", at)
        if end < 0:
            return None
        inside = page[at:end]
        if '"' not in inside and "'" not in inside:
            return end + 1, {n.lower(): v for n, v in reversed(PLAIN.findall(inside))} if inside else {}
        found: dict[str, str] = {}
        while True:
            at = BEFORE.match(page, at).end()
            if at >= len(page):
                return None
            if page[at] == ">":
                return at + 1, found
            name = ATTRIBUTE.match(page, at)
            at, value = name.end(), ""
            equals = EQUALS.match(page, at)
            if equals:
                at = equals.end()
                quote = page[at:at + 1]
                close = page.find(quote, at + 1) if quote in ("'", '"') and quote not in self.lost else -1
                if close >= 0:
                    at, value = close + 1, page[at + 1:close]
                else:
                    if quote in ("'", '"'):
                        self.lost.add(quote)
                    value = UNQUOTED.match(page, at)
                    at, value = value.end(), value[0]
            found.setdefault(name[0].lower(), value)


def page_lines(page: str) -> tuple[list[Line], list[Named], list[tuple[str, int, int, int]], set[int]]:
    """Lines in page order; the named elements; all elements that hold lines as (name, first line, end, depth); and those
    named elements that are or hold an article or main element."""
    scanner, last_close = Scanner(page), {}
    for m in CLOSES.finditer(page):
        last_close[m[1].lower()] = m.start()
    closes: dict[str, re.Pattern] = {}
    lines: list[Line] = []
    named: list[Named] = []
    spans: list[tuple[str, int, int, int]] = []
    holding: set[int] = set()
    text: list[str] = []
    stack: list[Element] = []
    open_names: Counter = Counter()
    linked = bad = articles = anchors = article = hidden = 0
    holder = -1

    def flush() -> None:
        nonlocal linked
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line:
                own = len(line) - line.count(" ") - linked
                lines.append(Line(line, 0 if bad else max(own, 0), linked, article if articles else 0, bad > 0, holder))
            text.clear()
        linked = 0

    def close(element: Element) -> None:
        nonlocal bad, articles, anchors, hidden, holder
        if (element.unwanted or element.named >= 0) and element.name not in BLOCKS:
            flush()
        if element.named >= 0:
            holder = named[element.named].around
        if len(lines) > element.first and element.name in BLOCKS:
            spans.append((element.name, element.first, len(lines), len(stack)))
        open_names[element.name] -= 1
        bad -= element.unwanted
        hidden -= element.hidden
        articles -= element.name in ("article", "main")
        anchors -= element.name == "a"

    def take(piece: str) -> None:
        nonlocal linked
        if not hidden:
            text.append(piece)
            if anchors:
                linked += len("".join(html.unescape(piece).split()))

    at = 0
    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            take(page[at:])
            break
        if start > at:
            take(page[at:start])
        tag = NAME.match(page, start + 1)
        if tag is None:
            mark = page[start + 1:start + 2]
            if mark not in ("!", "?", "/"):
                take("<")
                at = start + 1
                continue
            ends = "-->" if page.startswith("<!--", start) else "]]>" if page.startswith("<![CDATA[", start) else ">"
            end = page.find(ends, start + (4 if ends == "-->" else 2))
            if end < 0:
                break
            at = end + len(ends)
            continue
        name = tag[2].lower()
        found = scanner.attributes(tag.end())
        if found is None:
            break
        at, attributes = found
        if name in BLOCKS:
            flush()
        if tag[1]:
            if open_names[name]:
                while True:
                    element = stack.pop()
                    close(element)
                    if element.name == name:
                        break
            continue
        if name in RAW:
            pattern = closes.setdefault(name, re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I))
            end = pattern.search(page, at) if last_close.get(name, -1) >= at else None
            if end is None:
                break
            at = end.end()
            continue
        if name in VOID:
            continue
        if name in BLOCKS and stack and stack[-1].name == "p":
            close(stack.pop())
        says = said_by(attributes) if attributes and name not in ("html", "body", "main") else ""
        flag = unwanted(name, attributes, articles > 0)
        if (flag or says) and name not in BLOCKS:
            flush()
        unseen = name in HIDDEN and last_close.get(name, -1) >= at
        stack.append(Element(name, flag, len(named) if says else -1, unseen, len(lines)))
        open_names[name] += 1
        if says:
            named.append(Named(says, holder, article if articles else 0))
            holder = len(named) - 1
        if name in ("article", "main"):
            article += not articles
            articles += 1
            around = holder
            while around >= 0 and around not in holding:
                holding.add(around)
                around = named[around].around
        bad += flag
        hidden += unseen
        anchors += name == "a"
    flush()
    while stack:
        close(stack.pop())
    return lines, named, spans, holding


def judged(lines: list[Line], named: list[Named], holding: set[int]) -> list[Line]:
    """Lines with those in elements that class and id words rule out marked as bad.

    The heaviest element is judged first, comments last. One with weak words stays if it has a block of text and DOMINANT
    times as much as all text without such words (of its article); one that holds the only article stays if the text
    without such words is at most twice as much (reader comments: only if that is no block); one inside an article that
    names a subject stays unless it is mostly links. A line is free if all elements around it stay: an element adds its own
    lines once, when it and those around it are known to stay.
    """
    own: list[Counter] = [Counter() for _ in named]  # weight of the lines an element holds itself, by article
    weight, links = [0] * len(named), [0] * len(named)
    free: Counter = Counter()
    for line in lines:
        if line.held < 0:
            free[line.article] += line.weight
        else:
            own[line.held][line.article] += line.weight
            weight[line.held] += line.weight
            links[line.held] += line.linked
    inner: list[list[int]] = [[] for _ in named]
    for e in range(len(named) - 1, -1, -1):  # elements are numbered as they open
        if named[e].around >= 0:
            weight[named[e].around] += weight[e]
            links[named[e].around] += links[e]
            inner[named[e].around].append(e)
    total = sum(free.values())
    stays, opened = [False] * len(named), [False] * len(named)
    for e in sorted(range(len(named)), key=lambda e: (named[e].says == "comments", -weight[e], e)):
        says, _, within = named[e]
        rest = free[within] if within else total
        stays[e] = says in ("weak", "subject") and weight[e] >= THRESHOLD and weight[e] > DOMINANT * rest
        stays[e] |= says == "subject" and within > 0 and weight[e] > 2 * links[e]
        if e in holding and total == free[0]:
            stays[e] |= rest < THRESHOLD if says == "comments" else rest <= 2 * weight[e]
        ready = [e] if stays[e] and (named[e].around < 0 or opened[named[e].around]) else []
        while ready:
            f = ready.pop()
            opened[f] = True
            free.update(own[f])
            total += sum(own[f].values())
            ready += [k for k in inner[f] if stays[k]]
    return [line if line.held < 0 or opened[line.held] else line._replace(weight=0, bad=True) for line in lines]


def runs(weights: list[int], threshold: float, areas: list[int]) -> list[int]:
    """For each line the number of the run it lies in, or 0. A run lies in one area."""
    blocks = [sum(weights[k:k + WINDOW]) for k in range(len(weights))]
    found, number, open_ = [0] * len(weights), 0, False
    for k, (weight, block) in enumerate(zip(weights, blocks)):
        if open_ and (not block or areas[k] != areas[k - 1]):
            open_ = False  # dive
        if not open_ and weight and block >= threshold:
            open_, number = True, number + 1  # surge
            before = k - 1
            while before >= 0 and not found[before] and weights[before] and areas[before] == areas[k]:
                found[before] = number
                before -= 1
        if open_:
            found[k] = number
    return found


def distributed(lines: list[Line], raised: list[int]) -> list[int]:
    """Runs of the lines; those with a raised area (not 0) weigh more by the threshold."""
    plain = [line.weight for line in lines]
    most = max((sum(plain[k:k + WINDOW]) for k in range(len(lines))), default=0)
    threshold = min(THRESHOLD, most / 2 or 1)
    return runs([w + (THRESHOLD if area and not line.bad else 0) for w, area, line in zip(plain, raised, lines)],
                threshold, raised)


def trusted(lines: list[Line]) -> bool:
    """Do the article and main elements hold the page's text? Not if a run outside has more than twice the largest one's."""
    each = Counter()
    for line in lines:
        if line.article and not line.bad:
            each[line.article] += line.weight
    if not each:
        return False
    outside = [0 if line.article else line.weight for line in lines]
    sizes = Counter()
    for weight, run in zip(outside, runs(outside, THRESHOLD, [0] * len(lines))):
        sizes[run] += weight if run else 0
    return max(sizes.values(), default=0) <= 2 * max(each.values())


def holder_of(lines: list[Line], found: list[int], spans: list[tuple[str, int, int, int]]) -> tuple[int, int]:
    """Lines [first, end) of the innermost element that holds nearly all text of the runs, if it is no list of links."""
    text, links = [0], [0]
    for line, run in zip(lines, found):
        text.append(text[-1] + (line.weight if run else 0))
        links.append(links[-1] + (0 if line.bad else line.linked))
    best = (-1, 0, 0)
    for name, first, end, depth in spans:
        if name in CONTAINERS and depth > best[0] and text[end] - text[first] >= NEARLY * max(text[-1], 1):
            best = depth, first, end
    _, first, end = best
    return (first, end) if 2 * (links[end] - links[first]) <= text[end] - text[first] else (0, 0)


def main_text(page: str | None) -> str:
    if not page:
        return ""
    lines, named, spans, holding = page_lines(page)
    lines = judged(lines, named, holding)
    if trusted(lines):
        areas = [line.article for line in lines]
        found = distributed(lines, areas)
        touched = {run for run, area in zip(found, areas) if area}
        found = [run if run in touched else 0 for run in found]
    else:
        found = distributed(lines, [0] * len(lines))
        first, end = holder_of(lines, found, spans)
        if end:
            inside = distributed(lines, [int(first <= k < end) for k in range(len(lines))])
            found = [a or b for a, b in zip(found, inside)]
    return " ".join(line.text for line, run in zip(lines, found) if run and not line.bad)


def main_text_column(page: Column) -> Column:
    """Struct of text and n_chars (its code points)."""
    def each(pages: list[str | None]) -> pa.Array:
        texts = [main_text(p) for p in pages]
        return struct_array(text=pa.array(texts, pa.string()), n_chars=pa.array(map(len, texts), pa.int64()))

    return text_udf(lambda: each, "struct<text:string,n_chars:bigint>")(page)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    return (pages.select("page_id", "url", main_text_column(F.col("html")).alias("found"))
            .select("page_id", "url", "found.text", "found.n_chars"))
