"""Main text of pages by deduced templates: equivalence classes of tokens with the same occurrence vector on a host.

Tokens are tags and whole text runs, told apart by the containers they lie in. A token's occurrence vector says how often it
occurs on each different page of its host; the vectors of a host are compared through an order-free digest, so they are
summed in every task and a host of any size is no group that one task must hold. Tokens of one vector on at least half of the
pages form a class. On a page a class is valid if its tokens stand there in one order as often as the vector says (ordered)
and no token of a class stands in more than one gap of the class around it (nested); invalid classes are put aside
for that page. Valid classes nest into the template, what lies between their tokens are the slots.

The main text is what the slots of the article hold: slots inside menus, headers, footers, sidebars, notices,
adverts, forms, scripts and reader comments are left out, by the tags and names of the template around them (names of the page, of
its main and article elements and of what holds the article tell nothing of that kind), as is text that the template itself carries
outside the article. Inside it, text of the template is left out if it stands in every article of the host, these differ, and it is at
most a third of the page's article, so near copies of one article keep all of theirs. A page without an article element gets the
container with the most unlinked slot text, and if its slots are empty, with the most unlinked text.

Defined cases: null html counts as empty and gives empty text; pages without a host share the empty host; identical pages
count once for the template and are extracted each; unclosed tags end with their container; an unclosed comment or
script runs to the end; an empty table gives an empty result; only the id, url and html columns are read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revgrain.llm.common import BROADCAST_ROWS, written

TAG = re.compile(
    r"""<!--(?:.*?-->|.*)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[a-zA-Z/][^>]*+>|<[!?][^>]*+>""", re.S
)
ATTRIBUTE = re.compile(r"""(?P<name>class|id|role|itemprop|hidden)(?:\s*=\s*(?:"(?P<a>[^"]*)"|'(?P<b>[^']*)'|(?P<c>[^\s>]+)))?(?=[\s/]|$)""", re.I)
RAW = "script style title textarea noscript iframe template svg math select object xmp noembed noframes"
SILENT = set(RAW.split()) | {"head", "nav", "aside", "footer", "form", "button", "dialog", "menu"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINER = BLOCK - set("p li h1 h2 h3 h4 h5 h6 dd dt hr caption summary td th tr".split())
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar"}
#: Words of class and id names around text that isn't the article; names that begin so count as well.
ASIDE = set("ad ads adv nav navbar navigation menu menus footer search login signup share sharing social related widget pagination pager toolbar popup modal overlay alert gdpr reply replies respond disqus copyright".split())
ASIDE_BEGIN = ("advert", "banner", "sponsor", "promo", "cookie", "consent", "notice", "notification", "sidebar", "breadcrumb", "comment", "newsletter", "subscri", "recommend")
ARTICLE = {"article", "main"}
#: Elements whose class and id names describe the page, so never what is around the article.
PAGE = {"html", "body", "main"}
ARTICLE_NAMES = ("articlebody", "article-body", "post-content", "entry-content", "article-content")


class Scope:
    """A container of a page; ``inside`` and ``silent`` hold for what lies in it once ``settle`` has run."""

    __slots__ = ("up", "name", "article", "named", "barred", "inside", "hushed", "headed", "silent")

    def __init__(self, up: Scope | None, name: str = "", article: bool = False, named: bool = False, barred: bool = False):
        self.up, self.name, self.article, self.named, self.barred = up, name, article, named, barred
        self.inside = self.hushed = self.headed = self.silent = False

    def line(self) -> list[Scope]:
        """The container and those around it, from the inside out."""
        out, s = [], self
        while s is not None:
            out.append(s)
            s = s.up
        return out


class Part(NamedTuple):
    """A tag or text run of a page."""

    kind: str  # "<" or ">" for tags, "t" for text, "b" for the end of a block
    token: int
    text: str
    path: tuple[str, ...]
    scope: Scope
    linked: bool

    @property
    def article(self) -> bool:
        return self.scope.inside

    @property
    def silent(self) -> bool:
        return self.scope.silent


def _marks(name: str, rest: str) -> tuple[str, bool, bool, bool, bool]:
    """What tells a tag apart, whether it is an article, surely so, and whether names or else the tag leave out text below it."""
    if not rest.strip(" /"):
        return name, name in ARTICLE, name in ARTICLE, False, name in SILENT
    said = {m["name"].lower(): (m["a"] or m["b"] or m["c"] or "").lower() for m in ATTRIBUTE.finditer(rest)}
    names = f"{said.get('class', '')} {said.get('id', '')}"
    words = re.findall(r"[a-z]+", names)
    named = name not in PAGE and any(w in ASIDE or w.startswith(ASIDE_BEGIN) for w in words)
    barred = said.get("role") in ROLES or "hidden" in said
    sure = not barred and (name in ARTICLE or said.get("role") in ("main", "article") or "articlebody" in said.get("itemprop", ""))
    article = sure or not (named or barred) and any(n in f"{names} {said.get('itemprop', '')}" for n in ARTICLE_NAMES)
    return f"{name} {names.strip()}".strip(), article, sure, named, barred or name in SILENT


def parse(html: str) -> Iterator[Part]:
    """Tags and text runs of a page in order, with a block end wherever a block begins or ends."""
    stack: list[tuple[str, str, Scope]] = []  # name, marks, scope
    top = Scope(None)
    path: tuple[str, ...] = ()
    digest: dict[tuple, int] = {}
    linked, at, size = 0, 0, len(html)

    def token(kind: str, what: str) -> int:
        key = (path, kind, what)
        if key not in digest:
            digest[key] = xxhash.xxh3_64_intdigest("\x00".join((*path, kind, what))) >> 1
        return digest[key]

    scope = top
    for m in TAG.finditer(html):
        if m.start() < at:
            continue
        if m.start() > at:
            text = entities.unescape(html[at:m.start()])
            yield Part("t", token("t", text.strip()), text, path, scope, linked > 0)
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["end"]:
            if name == "a":
                linked = max(0, linked - 1)
            if name in CONTAINER and any(s[0] == name for s in stack):
                while stack.pop()[0] != name:
                    pass
                path = tuple(s[1] for s in stack)
                scope = stack[-1][2] if stack else top
            yield Part("b" if name in BLOCK else ">", token(">", name), "", path, scope, False)
            continue
        marks, is_article, sure, named, barred = _marks(name, m["rest"])
        if name in RAW.split():
            close = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
            at = close.end() if close else size
            yield Part("b", token("<", marks), "", path, scope, False)
            continue
        if is_article:  # menus and headers that were never closed don't reach into the article
            while stack and stack[-1][0] in ("nav", "header", "head", "menu", "ul", "ol"):
                stack.pop()
            path = tuple(s[1] for s in stack)
            scope = stack[-1][2] if stack else top
        yield Part("b" if name in BLOCK else "<", token("<", marks), "", path, scope, False)
        if name == "a":
            linked += 1
        if name == "br":
            yield Part("t", token("t", ""), " ", path, scope, False)
        if name in CONTAINER and not m["rest"].endswith("/"):
            if sure and named:  # an article's names count only where it lies in another one, as readers' comments do
                named = any(s.name == "article" for s in scope.line())
            scope = Scope(scope, name, is_article, named, barred)
            stack.append((name, marks, scope))
            path = (*path, marks)
    if at < size:
        text = entities.unescape(html[at:])
        yield Part("t", token("t", text.strip()), text, path, scope, linked > 0)


def settle(scopes: list[Scope]) -> None:
    """Hand down from each container, outer ones first, whether what lies in it belongs to an article or is left out."""
    for s in scopes:
        up = s.up
        if up is None:
            continue
        s.inside = up.inside or s.article
        s.hushed = up.hushed or s.barred or s.named
        s.headed = up.headed or s.name == "header"
        s.silent = s.hushed or (s.headed and not s.inside)


def read_page(html: str | None) -> list[Part]:
    """Parts of a page with settled containers.

    If names leave out every article, or all text of a page without one, those around the largest are names of the page's layout
    and don't count: a container that holds the article isn't beside it. Articles shorter than the text outside of them stay left out.
    """
    parts = list(parse(html or ""))
    met: dict[int, Scope] = {}
    for p in parts:
        if id(p.scope) not in met:
            met |= {id(s): s for s in reversed(p.scope.line()) if id(s) not in met}
    scopes = list(met.values())
    settle(scopes)
    articles = [s for s in scopes if s.article]
    while not any(p.kind == "t" and not p.silent and (p.article or not articles) and p.text.strip() for p in parts):
        size: dict[int, int] = {}
        for p in parts:
            if p.kind == "t" and (line := p.scope.line()) and not any(s.barred for s in line):
                for s in line:
                    size[id(s)] = size.get(id(s), 0) + len(p.text.strip())
        holders = {id(s.up) for s in scopes}
        named = [(at, [s for s in at.line() if s.named]) for at in articles or scopes if size.get(id(at)) and (articles or id(at) in holders)]
        named = [(at, around) for at, around in named if around]
        live = sum(len(p.text.strip()) for p in parts if p.kind == "t" and not p.silent and not p.linked)
        at, around = min(named, key=lambda x: (len(x[1]), -size[id(x[0])]), default=(None, []))
        if at is None or size[id(at)] <= live:
            break
        for s in around:
            s.named = False
        settle(scopes)
    return parts


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", url or "")
    return m[1].rpartition("@")[2].lower() if m else ""


def occurrences(pages: DataFrame) -> DataFrame:
    """One row a page: (host, body, article, tokens) with how often each token occurs and whether it is text of an article.

    ``body`` is a digest of all tokens, ``article`` one of the article's text, null without any.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, bodies, articles, tokens = [], [], [], []
            for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                met: dict[int, int] = {}
                said: set[int] = set()
                order, own = xxhash.xxh3_64(), xxhash.xxh3_64()
                for p in read_page(html):
                    if p.kind != "t" or p.text.strip():
                        met[p.token] = met.get(p.token, 0) + 1
                        order.update(p.token.to_bytes(8, "little"))
                        if p.kind == "t" and p.article and not p.silent:
                            said.add(p.token)
                            own.update(p.token.to_bytes(8, "little"))
                hosts.append(host_of(url))
                bodies.append(order.intdigest() >> 1)
                articles.append(own.intdigest() >> 1 if said else None)
                tokens.append([{"token": t, "n": n, "inside": t in said} for t, n in met.items()])
            kind = pa.list_(pa.struct([("token", pa.int64()), ("n", pa.int32()), ("inside", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(bodies, pa.int64()), pa.array(articles, pa.int64()), pa.array(tokens, kind)], names=["host", "body", "article", "tokens"])

    return pages.select("url", "html").mapInArrow(count, "host string, body long, article long, tokens array<struct<token:long,n:int,inside:boolean>>")


def templates(pages: DataFrame) -> DataFrame:
    """One row a host: (host, n_pages, classes), each class its tokens, the number of pages they are on, and which are in every article.

    Pages with the same article have the same tokens in it, so a token is in every different article if it is in that of every page.
    A token on half of the pages or more is one of at most twice as many as a page has, so a row stays as small as a page.
    """
    different = occurrences(pages).dropDuplicates(["host", "body"])
    different = written(different, "page-tokens")
    sizes = different.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_pages"), F.count("article").alias("with_article"), (F.min("article") < F.max("article")).alias("differ")
    )
    flat = different.select("host", "body", F.explode("tokens").alias("t"))
    vectors = flat.groupBy("host", F.col("t.token").alias("token")).agg(
        F.count(F.lit(1)).alias("on"), F.bit_xor(F.xxhash64("body", "t.n")).alias("vector"), F.count_if("t.inside").alias("inside")
    )
    often = vectors.join(sizes, "host").filter((F.col("on") * 2 >= F.col("n_pages")) & (F.col("on") > 1))
    shared = F.when(F.col("differ") & (F.col("inside") == F.col("with_article")), F.col("token"))
    classes = often.groupBy("host", "n_pages", "vector", "on").agg(F.sort_array(F.collect_list("token")).alias("tokens"), F.sort_array(F.collect_list(shared)).alias("shared"))
    return classes.groupBy("host", "n_pages").agg(F.sort_array(F.collect_list(F.struct("on", "tokens", "shared"))).alias("classes"))


def valid_classes(parts: list[Part], classes: list[dict]) -> dict[int, int]:
    """Tokens of the classes that are ordered and nested on this page: token -> number of its class."""
    of = {t: k for k, c in enumerate(classes) for t in c["tokens"]}
    seen: dict[int, list[tuple[int, int]]] = {}
    for i, p in enumerate(parts):
        if p.token in of:
            seen.setdefault(of[p.token], []).append((i, p.token))
    good: dict[int, list[int]] = {}
    for k, places in seen.items():
        order = [t for _, t in places]
        width = len(classes[k]["tokens"])
        if len(order) % width == 0 and order == order[:width] * (len(order) // width) and len(set(order[:width])) == width:
            good[k] = [i for i, _ in places]
    # From the classes with most tokens down: one whose tokens lie in different gaps of a larger class is no part of its slots.
    kept: list[int] = []
    for k in sorted(good, key=lambda k: (-len(classes[k]["tokens"]), k)):
        width = len(classes[k]["tokens"])
        outer = good[kept[0]] if kept else []
        once = not kept or len(outer) == len(classes[kept[0]]["tokens"])
        rounds = [(good[k][at], good[k][at + width - 1]) for at in range(0, len(good[k]), width)]
        # Beside a largest class that comes round several times, a class must not begin in one round and end in another.
        if once or all(sum(a < e < b for e in outer) in (0, len(outer)) for a, b in rounds):
            kept.append(k)
    return {t: k for k in kept for t in classes[k]["tokens"]}


class Block(NamedTuple):
    """A block of text that may belong to the article."""

    path: tuple[str, ...]
    article: bool
    text: str
    linked: int  # letters in links
    own: bool  # not all of it stands in every article of the host


def blocks(parts: list[Part], template: dict[int, int], classes: list[dict]) -> list[Block]:
    """Blocks of slot text, and inside an article those of the template as well."""
    shared = {t for c in classes for t in c["shared"] if t in template}
    out, held, linked, at, own = [], [], 0, None, False
    for p in [*parts, Part("b", 0, "", (), Scope(None), False)]:
        if p.kind == "b":
            if (own or (at and at.article)) and (text := " ".join("".join(held).split())):
                out.append(Block(at.path, at.article, text, linked, own))
            held, linked, at, own = [], 0, None, False
        elif p.kind == "t" and not p.silent:
            if p.token not in shared if p.article else p.token not in template:
                own = own or bool(p.text.strip())
            elif not p.article and p.text.strip():
                continue
            held.append(p.text)
            linked += len(p.text) * p.linked
            at = at or p
    return out


def main_text(html: str | None, classes: list[dict] | None = None) -> str:
    """The article of a page; ``classes`` is the template of its host."""
    parts = read_page(html)
    found = blocks(parts, valid_classes(parts, classes or []), classes or [])
    if any(p.article and not p.silent for p in parts):
        found = [b for b in found if b.article]
        if 3 * sum(len(b.text) for b in found if not b.own) <= sum(len(b.text) for b in found):
            found = [b for b in found if b.own]
    elif found := found or blocks(parts, {}, []):
        weight: dict[tuple[str, ...], int] = {}
        for b in found:
            weight[b.path] = weight.get(b.path, 0) + max(0, len(b.text) - 2 * b.linked)
        best = max(weight, key=lambda x: weight[x])
        found = [b for b in found if b.path[:len(best)] == best and 2 * b.linked <= len(b.text)]
    return "\n".join(b.text for b in found)


def extract(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The main text of every page: (id, url, text)."""
    rows = pages.select(F.col(id_col).alias("id"), "url", "html")
    shapes = written(templates(rows), "page-templates")
    if (shapes.agg(F.sum(F.size(F.flatten("classes.tokens")))).first()[0] or 0) <= BROADCAST_ROWS:
        shapes = F.broadcast(shapes)  # so many numbers at most; a larger table is joined by host

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, c) for h, c in zip(*(batch.column(x).to_pylist() for x in ("html", "classes")))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], names=["id", "url", "text"])

    host = F.udf(host_of, "string", useArrow=True)
    kind = rows.schema["id"].dataType.simpleString()
    hosted = rows.withColumn("host", host("url")).join(shapes, "host", "left")
    return hosted.select("id", "url", "html", "classes").mapInArrow(read, f"id {kind}, url string, text string")
