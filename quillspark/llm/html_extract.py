"""Main text of pages by equivalence-class template deduction.

Tokens of a page are its tags (name, class and id, and the path of elements around them) and its text nodes. Tokens of
same-host pages that occur equally often in every page share an occurrence vector and form an equivalence class. A class is
valid if it has two tokens or more, holds in most pages of the host, and its tokens follow each other in one order; valid
classes are nested by the order of their tokens into the host's template, and a page that breaks a class's order or nesting
does without it. What lies between template tokens are slots. Blocks
of a template's text nodes are boilerplate wherever they stand; a slot is extracted if the elements that the template puts
around it make it part of the article.

Occurrence vectors are unbounded, so they are compared by a fingerprint that partial aggregation can add up: the sum over
pages of a hash of (page, count). A host with a third of the pages is some rows a mapper, not one group.
"""

from __future__ import annotations

import html as html_entities
import re
from collections import Counter
from collections.abc import Iterator, Set
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import discard, small_batches, written

#: Share of a host's pages in which a class must hold.
SUPPORT = 0.5
#: For text nodes to be boilerplate: share of the host's pages that hold them.
TEXT_SUPPORT = 0.9
#: Template tokens of all hosts up to which they are broadcast; beyond that the join shuffles.
BROADCAST_TOKENS = 1_000_000
#: Hosts whose templates a worker holds.
KNOWN_HOSTS = 256

#: Attributes up to the end of a tag: quotes hold a value after = only.
_REST = r"""((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|))*+)(?:>|\Z)"""
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)""" + _REST, re.DOTALL)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|type)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)

# HTML's elements by what they mean here.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "canvas", "audio", "video", "title", "select"}
#: Of RAW, those that are empty when self-closed, and those whose contents are never text: they go on to the page's end if nothing closes them.
FOREIGN, CODE = {"svg", "math"}, {"script", "style"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5",
    "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
APART = {"nav", "footer", "aside", "form", "head", "menu", "dialog", "button", "fieldset", "search"}
MAIN = {"article", "main"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar"}
# Words of class and id names of what is no article.
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "aside", "footer", "cookie", "cookies", "consent",
    "gdpr", "popup", "modal", "overlay", "newsletter", "signup", "login", "comment", "comments", "commentlist", "disqus", "replies", "respond", "recommended", "recommendations", "trending", "copyright", "disclaimer", "toolbar", "masthead",
    "topbar", "pagination", "pager", "skip", "discussion", "discussions",
}
#: Words that say so only if all words of the name are of these, NAMES or PLACES: 'social-links' does, 'social-sciences' doesn't.
WEAK_NAMES = {"social", "search", "form", "share", "sharing", "related", "promo", "promotion", "widget", "notice", "notices", "subscribe", "subscription", "reply", "responses", "feedback"}
PLACES = {
    "area", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "col", "container", "content", "group", "header", "icon", "icons", "inner", "item", "items", "js", "left", "link", "links", "list", "main", "media", "module", "outer", "panel",
    "post", "posts", "right", "row", "section", "site", "top", "user", "users", "wrap", "wrapper", "articles", "stories", "news", "read", "more", "you", "may", "also", "like", "this", "page", "us", "follow",
}
#: Words of names that say how a page is laid out.
LAYOUT = {"no", "not", "has", "with", "without", "layout"}


def host(url: Column) -> Column:
    """The host of a URL in lower case, without user, port and a leading www.; '' where there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)", 1), F.lit(""))


class _Element:
    __slots__ = ("name", "path", "apart", "main", "link")

    def __init__(self, name: str, path: int, apart: bool, main: bool, link: bool):
        self.name, self.path, self.apart, self.main, self.link = name, path, apart, main, link


def _hash(text: str, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed=seed)


def _says_apart(label: str, inside: bool) -> bool:
    """Whether a name of class or id has a word of NAMES and none of LAYOUT: 'has-sidebar' is no sidebar. Headers inside the article belong to it."""
    for name in label.split():
        words = {w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w}
        whole = words | {re.sub("[^a-z]", "", name.lower())}
        if not LAYOUT.isdisjoint(whole):
            continue
        weak = not WEAK_NAMES.isdisjoint(whole) and words <= WEAK_NAMES | NAMES | PLACES
        if not NAMES.isdisjoint(whole) or weak or ("header" in whole and not inside):
            return True
    return False


def _role(name: str, attributes: str, parent: _Element) -> tuple[bool, str]:
    """Whether an element is apart from the article, and its class and id."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if attributes and "=" in attributes or "hidden" in attributes else {}
    label = f"{found.get('class', '')} {found.get('id', '')}".strip()
    apart = parent.apart or name in APART or (name == "header" and not parent.main) or found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden") == "true"
    if not apart and label and name not in ("html", "body", "article", "main"):
        apart = _says_apart(label, parent.main)
    return apart, label


@lru_cache(maxsize=None)
def _same_tags(name: str) -> re.Pattern:
    """Comments, code, and the tags of one element of RAW."""
    code = "" if name in CODE else r"|<(?:script|style)\b.*?</(?:script|style)\b[^>]*(?:>|\Z)"
    return re.compile(rf"""<!--.*?(?:-->|\Z){code}|<(/?){name}(?=[\s/>]|\Z)""" + _REST, re.DOTALL | re.IGNORECASE)


def _closed(page: str, name: str) -> dict[int, int]:
    """Of each element of this name in a page that is closed, where its tag starts and its closing tag ends; those inside one another are matched."""
    found: dict[int, int] = {}
    opened: list[int] = []
    for m in _same_tags(name).finditer(page):
        if m[2] is None:
            continue
        if not m[1]:
            if not (name in FOREIGN and m[2].endswith("/")):
                opened.append(m.start())
        elif opened:
            found[opened.pop()] = m.end()
    return found


def parsed(page: str) -> Iterator[tuple[str, int, str, _Element]]:
    """(kind, token, data, element around it): kind 'open', 'close' or 'text'; token is its hash with its path, 0 for white space. Text is raw."""
    stack = [_Element("", 0, False, False, False)]
    opened: Counter = Counter()  # open elements by name: a closing tag that closes none isn't looked for
    closed: dict[str, dict[int, int]] = {}
    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        end = m.start() if m else n
        if end > at:
            text = page[at:end]
            yield "text", (0 if text.isspace() else _hash(text.strip(), stack[-1].path)), text, stack[-1]
        if not m:
            return
        at = max(m.end(), end + 1)
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA["):
                yield "text", 0, html_entities.escape(m[0][9:].removesuffix("]]>")), stack[-1]
            continue
        name = name.lower()
        if m[1]:
            if not opened[name]:
                yield "close", 0, name, stack[-1]
                continue
            while stack[-1].name != name:
                opened[stack.pop().name] -= 1
            opened[name] -= 1
            element = stack.pop()
            yield "close", _hash("/" + name, element.path), name, element
            continue
        top = stack[-1]
        if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and top.name == name:
            opened[stack.pop().name] -= 1  # such an element ends where the next begins
            top = stack[-1]
        apart, label = _role(name, m[3], top)
        path = _hash(f"{name} {label}", top.path)
        yield "open", path, name, top
        if name in RAW:
            if name in CODE:
                close = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
                at = close.end() if close else n
            elif not (name in FOREIGN and m[3].endswith("/")):
                if name not in closed:
                    closed[name] = _closed(page, name)
                at = closed[name].get(end, at)  # an element that nothing closes is its tag alone
        elif name not in VOID and not m[3].endswith("/"):
            stack.append(_Element(name, path, apart, top.main or name in MAIN, top.link or name == "a"))
            opened[name] += 1


def _occurrences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(host, token, is_text, pages, fingerprint, place) summed over the pages of a batch; place sums where the token first stands."""
    for b in batches:
        total: dict[tuple[str, int], list] = {}
        for h, i, page in zip(b["host"], b["page_id"], b["html"], strict=True):
            seen: dict[int, list] = {}
            for n, (kind, token, _, _) in enumerate(parsed(page or "")):
                if token:
                    x = seen.get(token)
                    if x is None:
                        seen[token] = [1, n, kind == "text"]
                    else:
                        x[0] += 1
            for token, (count, n, is_text) in seen.items():
                x = total.setdefault((h, token), [is_text, 0, 0, 0])
                x[1] += 1
                x[2] = (x[2] + _hash(f"{i} {count}")) & 0xFFFFFFFFFFFFFFFF
                x[3] += n
        yield pd.DataFrame(
            {"host": [k[0] for k in total], "token": np.array([k[1] for k in total], np.uint64).view(np.int64), "is_text": [x[0] for x in total.values()], "pages": [x[1] for x in total.values()], "fingerprint": np.array([x[2] for x in total.values()], np.uint64).view(np.int64), "place": [x[3] for x in total.values()]}
        )


def templates(pages: DataFrame, support: float = SUPPORT) -> DataFrame:
    """host, tokens (in order), classes, is_text, of each host with a template. pages: page_id, host, html.

    A host's template has no more tokens than 1 / support pages have on average.
    """
    of_host = pages.groupBy("host").agg(F.count("*").alias("n"))
    # sums of hashes wrap around, as long arithmetic does unless told otherwise; decimal sums taken modulo are the same and never fail
    part = pages.select("host", "page_id", "html").mapInPandas(_occurrences, "host string, token long, is_text boolean, pages long, fingerprint long, place long")
    wide = F.col("fingerprint").cast("decimal(20,0)")
    tokens = part.groupBy("host", "token").agg(F.first("is_text").alias("is_text"), F.sum("pages").alias("pages"), F.pmod(F.sum(wide), F.lit(str(2**64)).cast("decimal(21,0)")).alias("fingerprint"), (F.sum("place") / F.sum("pages")).alias("place"))
    kept = tokens.join(of_host, "host").filter((F.col("n") >= 2) & (F.col("pages") >= F.col("n") * support))
    kept = kept.filter(~F.col("is_text") | (F.col("pages") >= F.col("n") * TEXT_SUPPORT))
    entry = F.struct("place", "token", "is_text")
    classes = kept.groupBy("host", "fingerprint").agg(F.sort_array(F.collect_list(entry)).alias("tokens")).filter((F.size("tokens") >= 2) & F.exists("tokens", lambda t: ~t["is_text"]))
    one = F.transform("tokens", lambda t: F.struct(t["place"].alias("place"), t["token"].alias("token"), t["is_text"].alias("is_text"), F.col("fingerprint").alias("class")))
    host_tokens = classes.select("host", one.alias("tokens")).groupBy("host").agg(F.sort_array(F.flatten(F.collect_list("tokens"))).alias("t"))
    return host_tokens.select("host", F.transform("t", lambda x: x["token"]).alias("tokens"), F.transform("t", lambda x: F.xxhash64(x["class"])).alias("classes"), F.transform("t", lambda x: x["is_text"]).alias("is_text"))


Template = dict[int, tuple[int, int, int, bool]]


def _template(tokens, classes, is_text) -> Template:
    """Of each token its class, its place in the class and the class's size, and whether it is text."""
    size: Counter = Counter()
    out: Template = {}
    for t, c, x in zip(tokens, classes, is_text, strict=True):
        out[int(t) & 0xFFFFFFFFFFFFFFFF] = (int(c), size[int(c)], 0, bool(x))
        size[int(c)] += 1
    return {t: (c, n, size[c], x) for t, (c, n, _, x) in out.items()}


def _broken(events: list, template: Template) -> set[int]:
    """The classes whose tokens don't follow each other in order in this page, again and again, or that aren't nested: a class between two tokens of another is complete there."""
    broken: set[int] = set()
    following: dict[int, int] = {}
    stack: list[int] = []  # classes that have begun, innermost last
    for _, token, _, _ in events:
        t = template.get(token)
        if t is None or t[0] in broken:
            continue
        c, n, size, _ = t
        if n != following.get(c, 0):
            broken.add(c)
            continue
        if not n:
            stack.append(c)
        else:
            while stack and stack[-1] != c:
                broken.add(stack.pop())  # it goes on beyond the class around it
        following[c] = (n + 1) % size
        if n == size - 1 and stack:
            stack.pop()
    return broken | {c for c, n in following.items() if n}


def _blocks(page: str, template: Template) -> list[str]:
    """The blocks of the article in page order.

    A slot is what lies between two template tokens. A class that this page breaks is taken apart: an element's tag and its
    closing tag are a class of their own, which is always in order and nested, and its text nodes are in none. Blocks whose
    text nodes are all template are boilerplate, inside the article too; a block that holds anything else is kept whole. A
    page with template text only has no slot that tells its article: tags and names alone do.
    """
    events = list(parsed(page))
    broken = _broken(events, template) if template else set()
    texts = {token for token, t in template.items() if t[3] and t[0] not in broken}
    return _article(events, template.keys(), texts) or (_article(events, template.keys(), set()) if texts else [])


def _article(events: list[tuple[str, int, str, _Element]], template: Set[int], boilerplate: Set[int]) -> list[str]:
    """The blocks of the article. template: the tokens that part slots; boilerplate: those of them that are text."""
    slots: list[dict] = []
    slot: dict | None = None
    words: list[str] = []
    chars = linked = 0
    own = False  # whether the block has text that is no template

    def ended() -> None:
        nonlocal chars, linked, own
        if words and slot is not None and (text := " ".join(html_entities.unescape("".join(words)).split())):
            slot["any"] = True
            if own:
                slot["blocks"].append(text)
                slot["chars"] += chars
                slot["linked"] += linked
        words.clear()
        chars, linked, own = 0, 0, False

    key = None
    for kind, token, data, element in events:
        if kind != "text":
            if data in BLOCK:
                ended()
            elif data == "br":
                words.append(" ")
            if data in BLOCK and token in template:
                slot = None
            continue
        if data.isspace():  # parts words, and is no text of any element
            words.append(data)
            continue
        where = (element.apart, element.main)
        if slot is None or where != key:
            ended()
            key = where
            slots.append(slot := {"apart": element.apart, "main": element.main, "any": False, "blocks": [], "chars": 0, "linked": 0})
        words.append(data)
        own = own or token not in boilerplate
        size = len(data.strip())
        chars += size
        linked += size * element.link
    ended()
    slots = [s for s in slots if not s["apart"] and s["any"]]
    if any(s["main"] for s in slots):
        slots = [s for s in slots if s["main"]]
    else:  # nothing says where the article is: slots of mostly links are menus
        slots = [s for s in slots if 2 * s["linked"] <= s["chars"]]
    return [b for s in slots for b in s["blocks"]]


@small_batches
def extract(pages: DataFrame, support: float = SUPPORT) -> DataFrame:
    """page_id, url, text, n_chars of every page (columns page_id, url, html).

    text is the article's blocks in page order, joined by line feeds: character references decoded, white space inside a
    block made one space, trimmed; '' where there is none. Null, empty and broken html give what can be read of it. Pages
    with a null or unreadable url are one host. Rows with the same page_id are pages each. Other columns are ignored.
    """
    at = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    found = written(templates(at, support), "html-templates")
    tokens = found.agg(F.sum(F.size("tokens"))).first()[0] or 0
    joined = at.join(F.broadcast(found) if tokens <= BROADCAST_TOKENS else found, "host", "left")

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, Template] = {}
        for b in batches:
            out = []
            for h, page, tokens, classes, is_text in zip(b["host"], b["html"], b["tokens"], b["classes"], b["is_text"], strict=True):
                if h not in known:
                    if len(known) >= KNOWN_HOSTS:
                        known.clear()
                    known[h] = {} if tokens is None else _template(tokens, classes, is_text)
                out.append("\n".join(_blocks(page or "", known[h])))
            yield pd.DataFrame({"page_id": b["page_id"].astype("Int64"), "url": b["url"], "text": out, "n_chars": [len(t) for t in out]})

    out = written(joined.select("page_id", "url", "host", "html", "tokens", "classes", "is_text").mapInPandas(texts, "page_id long, url string, text string, n_chars long"), "html-texts")
    discard(found)
    return out
