"""Main text of web pages by equivalence-class template deduction.

A token of a page is a block element in its place (the path of ancestors, each with its number among
its like siblings), or the text of a block with its path. Tokens of a host's pages that occur equally often in every
page form an equivalence class; a class that is large, frequent and, in a page, in its
usual order is valid there. Valid classes, nested by their places, are the host's template: their texts are
boilerplate. What the template leaves open are slots, and the host's pages together say how much text each
slot holds. So the template names the article: the deepest of its elements that holds most of the slots'
text. Marks (article, main) and names only rank slots where the amounts don't decide, and
menus, adverts, forms and so on hold no slots.

Occurrence vectors are never gathered: the vector of a token is represented by the exclusive or of
hash(page, count) over its distinct pages, so classes come from one aggregation with partial results
before the shuffle, however many pages a host has.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidweave.llm.common import cut_lineage, loose_string, prepare, sliced

#: A class must occur on this many of a host's pages, and on this share of them, and have this many tokens.
LEAST_PAGES, LEAST_SHARE, LEAST_TOKENS = 3, 0.5, 2
#: Share of an element's slot text that a container inside it must hold to be the article's place instead: by the
#: host's pages together, inside a marked main place, and by one page alone.
HOST_SHARE, MAIN_SHARE, PAGE_SHARE = 0.6, 0.9, 0.75
#: A container of the template beside loose paragraphs is no part of the article if it holds less than this share.
BESIDE_SHARE = 0.2
#: Templates are broadcast only if they were counted to have no more bytes than this.
BROADCAST_BYTES = 32 << 20
#: The token that every page has, and the path of what has no parent.
PAGE, ROOT = 0, 1

#: Where markup begins; other bare signs are text.
MARK = re.compile(r"<(?=[a-zA-Z!?]|/.)", re.S)
OPEN = re.compile(r"[a-zA-Z][^\s/>]*+")
#: The rest of a tag up to its end. Possessive, so that no text is read twice.
REST = re.compile(r"""((?:[^>=]|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes")}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose content is no article text.
LEFT_OUT = set("head title script style noscript template nav footer aside form iframe object svg math button select textarea menu dialog canvas audio video map xmp noembed noframes".split())
#: An opening tag ends these open elements: the tag, or its kind, and what they must not pass.
CLOSES_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt", "option", "optgroup", "legend", "summary", "figcaption"}
P_WALL = {"button", "table", "td", "th", "article", "section", "div", "main", "body", "nav", "aside", "footer", "header", "form", "blockquote", "li", "figure"}
SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words of class and id values that mark what isn't the article, unless a word of KEEPS stands beside them.
NOISE = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar sidebars rail menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup signin login search comment comments disqus reply replies respond discussion share sharing social related recommended recommendations widget widgets toolbar pagination pager copyright".split()
)
KEEPS = set("content main article body page wrapper container layout has with without no post entry story".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
ARTICLE_NAMES = {"articlebody"}
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

OUT, BODY, MAIN, ARTICLE = range(4)
#: Kinds of tokens: a text; elements of running text, the title's, containers, and the marked containers.
TEXT, FLOW, TITLE, BOX, MAIN_BOX, ARTICLE_BOX = range(6)
BOXES = set("html body div section main center details table tbody tr td th".split())


def _named(attributes: str) -> tuple[bool, bool, str]:
    """Whether the attributes mark an element as noise, as the main place, and its class for the path."""
    found = {}
    for m in ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    role = found.get("role", "").lower()
    noise = "hidden" in found or role in ROLES or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    for value in (found.get("class", ""), found.get("id", "")):
        for name in value.split():
            own = {w.lower() for w in WORDS.findall(name)}
            noise = noise or bool(own & NOISE) and not own & KEEPS
    main = role == "main" or found.get("itemprop", "").lower() in ARTICLE_NAMES
    return noise, main, found.get("class", "")


class Page:
    """elements: (token, index of the parent, kind) of block elements in order, the page itself first;
    blocks: (element, kind of place, text, token, characters outside links);
    order: the place of each token, elements and texts, when it first comes."""

    def __init__(self, source: str):
        self.elements: list[tuple[int, int, int]] = [(ROOT, -1, BOX)]
        self.blocks: list[tuple[int, int, str, int, int]] = []
        self.order: dict[int, int] = {PAGE: 0}
        self._paths = [ROOT]
        self._like: Counter[tuple[int, str]] = Counter()
        self._parts: list[str] = []
        self._linked = 0
        self._read(source)

    def _flush(self, place: int, element: int) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                token = _token(self._paths[element], "#" + text)
                self.order.setdefault(token, len(self.order))
                self.blocks.append((element, place, text, token, max(0, len(text) - self._linked)))
            self._parts, self._linked = [], 0

    def _element(self, parent: int, tag: str, name: str, kind: int) -> int:
        named = f"{tag}.{' '.join(w for w in name.split() if not any(c.isdigit() for c in w))}"
        self._like[parent, named] += 1
        token = _token(self.elements[parent][0], f"{named}#{self._like[parent, named]}")
        self.order.setdefault(token, len(self.order))
        self.elements.append((token, parent, kind))
        self._paths.append(_token(self._paths[parent], named))
        return len(self.elements) - 1

    def _read(self, source: str) -> None:
        # open elements: (tag, place of their content, block element that holds it); where each tag is open
        stack: list[tuple[str, int, int]] = [("", BODY, 0)]
        opened: dict[str, list[int]] = {}
        at, n = 0, len(source)

        def close(down_to: int) -> None:
            while len(stack) > down_to:
                opened[stack.pop()[0]].pop()

        def deepest(tags: set[str]) -> int:
            return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

        while at < n:
            found = MARK.search(source, at)
            mark = found.start() if found else -1
            stop = mark if mark >= 0 else n
            _, place, element = stack[-1]
            if stop > at and place != OUT:
                self._parts.append(entities.unescape(source[at:stop]))
                if opened.get("a"):
                    self._linked += stop - at
            if mark < 0:
                break
            ends = source[mark + 1] == "/"
            name = OPEN.match(source, mark + 1 + ends)
            if name is None:  # comments and declarations separate nothing
                close_at, size = (source.find("-->", mark + 2), 3) if source.startswith("<!--", mark) else (source.find(">", mark), 1)
                at = close_at + size if close_at >= 0 else n
                continue
            rest = REST.match(source, name.end())
            if rest is None:
                break  # a tag without an end
            at, tag = rest.end(), name[0].lower()
            if ends:
                if tag in BLOCKS:
                    self._flush(place, element)
                if opened.get(tag):
                    down_to = opened[tag][-1]
                    if any(t in BLOCKS for t, _, _ in stack[down_to:]):
                        self._flush(place, element)
                    close(down_to)
                continue
            if tag in BLOCKS:
                self._flush(place, element)
                closed, wall = SAME.get(tag, (None, None))
                if closed is None and tag in CLOSES_P:
                    closed, wall = {"p"}, P_WALL
                if closed and (i := deepest(closed)) > deepest(wall):
                    close(i)
                _, place, element = stack[-1]
            elif tag == "br" and place != OUT:
                self._parts.append(" ")
            noise, main, named = _named(rest[1]) if rest[1] else (False, False, "")
            if tag in VOID or rest[1].endswith("/") and tag not in BLOCKS:
                continue
            if tag in RAW and (place == OUT or tag in LEFT_OUT):
                end = RAW[tag].search(source, at)
                at = end.end() if end else n
                continue
            kind = TITLE if tag == "h1" else BOX if tag in BOXES else FLOW
            if place == OUT or tag in LEFT_OUT or noise and tag not in ("body", "html", "main") or tag == "header" and place == BODY:
                inner = OUT
            elif tag == "article":
                inner, kind = ARTICLE, ARTICLE_BOX
            elif (tag == "main" or main) and place == BODY:
                inner, kind = MAIN, MAIN_BOX
            else:
                inner = place
            if tag in BLOCKS and inner != OUT:
                element = self._element(element, tag, named, kind)
            opened.setdefault(tag, []).append(len(stack))
            stack.append((tag, inner, element))
        _, place, element = stack[-1]
        self._flush(place, element)

    def sizes(self, left_out: set[int] = frozenset()) -> list[int]:
        """Characters outside links in each element and all that it holds, but for texts that are ``left_out``."""
        out = [0] * len(self.elements)
        for element, _, _, token, size in self.blocks:
            if token not in left_out:
                out[element] += size
        for i in range(len(out) - 1, 0, -1):
            out[self.elements[i][1]] += out[i]
        return out

    def tokens(self) -> dict[int, tuple[int, int, int, int, int]]:
        """For each token its parent, kind, times, place and characters."""
        sizes = self.sizes()
        out = {PAGE: (ROOT, TEXT, 1, 0, sizes[0])}
        for i, (token, parent, kind) in enumerate(self.elements[1:], 1):
            out[token] = (self.elements[parent][0], kind, 1, self.order[token], sizes[i])
        for element, _, _, token, size in self.blocks:
            seen = out.get(token)
            out[token] = (seen[0], TEXT, seen[2] + 1, seen[3], seen[4] + size) if seen else (self.elements[element][0], TEXT, 1, self.order[token], size)
        return out

    def content(self) -> int:
        """A hash of the page's texts: pages of the same texts are copies."""
        return _token(ROOT, "\n".join(f"{place}{text}" for _, place, text, _, _ in self.blocks))

    def text(self, template: Template | None = None) -> str:
        """What the template leaves open of the article's place. A place that is template as a whole is kept."""
        if not self.blocks:
            return ""
        boilerplate = self.valid(template) if template else set()
        chosen = self._slots(template) if template and template.decided else None
        if chosen is None:
            return self._alone(boilerplate)
        open_ = [x for x in chosen if x[3] not in boilerplate] or chosen
        return "\n".join(x[2] for x in self._ranked(open_))

    def _ranked(self, blocks: list[tuple[int, int, str, int, int]]) -> list[tuple[int, int, str, int, int]]:
        """Blocks of the marked article and of the main place that holds it; all where others have more text than these."""
        size = [sum(len(x[2]) for x in blocks if x[1] == p) for p in (BODY, MAIN, ARTICLE)]
        return blocks if size[0] > size[1] + size[2] else [x for x in blocks if x[1] >= MAIN]

    def _slots(self, template: Template) -> list[tuple[int, int, str, int, int]] | None:
        """Blocks of the place that the template names; None where the page has no such place."""
        inside = [template.main == ROOT]
        for token, parent, _ in self.elements[1:]:
            inside.append((token == template.main or inside[parent]) and token not in template.beside)
        if not any(inside):
            return None
        return [x for x in self.blocks if inside[x[0]] or self.elements[x[0]][0] in template.titles]

    def _alone(self, boilerplate: set[int]) -> str:
        """Without a place named by a template: the article and the main place that holds it, or the rest of the body
        too where it has more text than these. Without marks, the container that holds most of the page's text."""
        own = [x for x in self.blocks if x[3] not in boilerplate]
        best = max(x[1] for x in self.blocks)
        if best != BODY and not any(x[1] == best for x in own):
            own = [x for x in self.blocks if x[1] == best or x[3] not in boilerplate]
        if best != BODY:
            return "\n".join(x[2] for x in self._ranked(own))
        sizes = self.sizes(boilerplate)
        children: dict[int, list[int]] = {}
        for i, (_, parent, _) in enumerate(self.elements[1:], 1):
            children.setdefault(parent, []).append(i)
        kinds = [kind for _, _, kind in self.elements]
        main, titles = _descend(0, children, sizes, kinds, lambda _: PAGE_SHARE)
        inside = [main == 0]
        for i, (_, parent, _) in enumerate(self.elements[1:], 1):
            inside.append(i == main or inside[parent])
        return "\n".join(x[2] for x in own if inside[x[0]] or x[0] in titles)

    def valid(self, template: Template) -> set[int]:
        """Tokens of the classes that are valid on this page: all there, in their usual order, and nested,
        that is, the nearest template elements around their tokens are of the class itself and of one other
        valid class at most: the class lies in one slot of that one."""
        ordered = []
        for tokens in template.classes:
            places = [self.order.get(t, -1) for t in tokens]
            if places[0] >= 0 and all(a < b for a, b in zip(places, places[1:])):
                ordered.append(tokens)
        home = {t: i for i, tokens in enumerate(ordered) for t in tokens}
        holder = {PAGE: 0}
        for element, _, _, token, _ in self.blocks:
            holder.setdefault(token, element)
        kept = set(range(len(ordered)))
        while True:
            # of each element, the class of the nearest element of the template, itself included, and around it
            near, around = [-1], {}
            for token, parent, _ in self.elements[1:]:
                around[token] = near[parent]
                near.append(i if (i := home.get(token, -1)) in kept else near[parent])
            about = lambda t: around[t] if t in around else near[holder[t]]  # noqa: B023, E731
            nested = {i for i in kept if len({about(t) for t in ordered[i]} - {i}) <= 1}
            if nested == kept:
                return {t for i in kept for t in ordered[i]}
            kept = nested


def _descend(start: int, children: dict[int, list[int]], sizes, kinds, share) -> tuple[int, set[int]]:
    """From an element into the container that holds ``share`` of its text, as long as there is one; an article
    isn't left. Titles beside unmarked containers stay with them."""
    at, titles = start, set()
    while kinds[at] != ARTICLE_BOX:
        boxes = [c for c in children.get(at, ()) if kinds[c] >= BOX]
        best = max(boxes, key=lambda c: sizes[c], default=None)
        if best is None or not 0 < sizes[best] >= share(kinds[at]) * sizes[at]:
            break
        if kinds[best] == BOX:
            titles |= {c for c in children[at] if kinds[c] == TITLE}
        else:
            titles = set()
        at = best
    return at, titles


class Template:
    """A host's classes, and the place of its articles.

    classes: tokens in their usual order; main: the element that holds the slots of the article; beside: containers
    in it that don't belong to the article; titles: elements outside that do; decided: whether anything lies outside."""

    def __init__(self, classes: list[list[dict]]):
        self.classes = [[t["token"] for t in tokens] for tokens in classes]
        known = {t["token"]: t for tokens in classes for t in tokens}
        page = known.get(PAGE)
        parent = {t: x["parent"] for t, x in known.items()}
        kinds = {t: x["kind"] for t, x in known.items()} | {ROOT: BOX}
        sizes = {t: x["chars"] for t, x in known.items()} | {ROOT: page["chars"] if page else 0}
        for token, x in known.items():
            if x["kind"] == TEXT and token != PAGE:  # the template's own texts are in no slot
                at = parent[token]
                while at in known or at == ROOT:
                    sizes[at] -= x["chars"]
                    at = parent.get(at)
        children: dict[int, list[int]] = {}
        for token in sorted(known):
            if kinds[token] != TEXT:
                children.setdefault(parent[token], []).append(token)
        self.main, self.titles = _descend(ROOT, children, sizes, kinds, lambda kind: MAIN_SHARE if kind == MAIN_BOX else HOST_SHARE)
        self.beside: set[int] = set()
        boxes = [c for c in children.get(self.main, ()) if kinds[c] == BOX]
        if kinds[self.main] == BOX and sizes[self.main] - sum(sizes[c] for c in boxes) >= 0.5 * sizes[self.main] > 0:
            self.beside = {c for c in boxes if sizes[c] < BESIDE_SHARE * sizes[self.main]}
        self.decided = sizes[ROOT] > 0 and (kinds[self.main] > BOX or bool(self.beside) or sizes[self.main] < sizes[ROOT])

@lru_cache(512)
def _template(written: str) -> Template:
    return Template(json.loads(written))


def _token(path: int, name: str) -> int:
    return xxhash.xxh64_intdigest(f"{path:x}/{name}") - (1 << 63)


def host_of(url: Column) -> Column:
    """The host of a url in lower case; the empty string for null and odd ones."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[^:/?#]+://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.int8(), pa.int32(), pa.int32(), pa.int64()]
    for batch in sliced(batches):
        contents, columns = [], [[] for _ in kinds]
        for source in batch.column(1).to_pylist():
            page = Page(source or "")
            found = page.tokens()
            contents.append(page.content())
            for column, values in zip(columns, [list(found), *zip(*found.values())]):
                column.append(values)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(contents, pa.int64()), *[pa.array(c, pa.list_(k)) for c, k in zip(columns, kinds)]], ["host", "page", "token", "parent", "kind", "n", "at", "chars"])


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, classes): each host's classes of tokens in their usual order; hosts without any are left out.

    The tokens that a host can have here are bounded by a page's tokens over LEAST_SHARE."""
    prepare(pages.sparkSession)
    taken = pages.select(host_of(F.col(url_col)).alias("_host"), F.col(html_col).alias("_html"))
    # A host's copies of one page are one page: they agree by being copies, not by a template.
    seen = taken.mapInArrow(_tokens, "host string, page bigint, token array<bigint>, parent array<bigint>, kind array<tinyint>, n array<int>, at array<int>, chars array<bigint>").dropDuplicates(["host", "page"])
    each = seen.select("host", "page", F.explode(F.arrays_zip("token", "parent", "kind", "n", "at", "chars")).alias("t")).select("host", "page", "t.*")
    vectors = each.groupBy("host", "token").agg(
        F.bit_xor(F.xxhash64("page", "n")).alias("vector"), F.count("*").alias("pages"), F.sum("n").alias("times"), F.avg("at").alias("at"), F.min("parent").alias("parent"), F.max("kind").alias("kind"), F.sum("chars").alias("chars")
    )
    often = cut_lineage(vectors.where(F.col("pages") >= LEAST_PAGES))
    hosts = often.where(F.col("token") == PAGE).select("host", F.col("pages").alias("all_pages"))
    frequent = often.join(hosts, "host").where(F.col("pages") >= LEAST_SHARE * F.col("all_pages"))
    classes = frequent.groupBy("host", "vector", "pages", "times").agg(F.array_sort(F.collect_list(F.struct("at", "token", "parent", "kind", "chars"))).alias("t")).where(F.size("t") >= LEAST_TOKENS)
    return classes.groupBy("host").agg(F.array_sort(F.collect_list("t")).alias("classes"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        texts = [Page(source or "").text(_template(written) if written else None) for source, written in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["_id", "_url", "text"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: the id and url columns, and text, blocks joined by line feeds.

    Null html and pages without text give the empty text; a null or odd url belongs to the
    host ''. Repeated rows each give a row. An empty table gives none; other columns are left out.
    A page's time is linear in its length but for the order of its template's classes.
    """
    prepare(pages.sparkSession)
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    found = cut_lineage(templates(pages, url_col, html_col).select("host", F.to_json("classes").alias("template")))
    size = found.agg(F.sum(F.length("template") + F.length("host"))).first()[0] or 0
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"), host_of(F.col(url_col)).alias("_host"))
    known = F.broadcast(found) if size <= BROADCAST_BYTES else found.withColumn("host", loose_string("host"))
    joined = rows.join(known, F.col("_host") == F.col("host"), "left").select("_id", "_url", "_html", "template")
    out = joined.mapInArrow(_extract, f"_id {kinds[id_col]}, _url {kinds[url_col]}, text string")
    return out.withColumnsRenamed({"_id": id_col, "_url": url_col})
