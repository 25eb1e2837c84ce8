"""Main text of web pages by union-free regular-expression inference.

A page becomes a stream of tags and text places.  Streams of one host are
aligned one after the other into a wrapper, a regular expression without
alternatives:

* neighbouring equal groups of a stream fold into a repeated group, and a
  single group folds where the other side already repeats it;
* tags that stand on one side only become an optional group;
* text becomes a place, whatever it says.

Every page of a host is then read with the host's wrapper (as an automaton
over its positions), which gives each text the place it fills.  A block of
text that is the same on the host's pages is a constant of the template: it
stands at one place on at least ``LEAST`` pages and on ``SHARE`` of those that
have the place.  Pages that say the same count once.  What is no constant
fills a slot, and is content where the tags allow it: inside the article, and
outside menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and comments.  The ``h1`` of an article is its title and stays, also
where all pages of a host have the same.

Skew: a task folds its own pages of a host, so that one partial wrapper for
each host and task leaves it, equal ones only once; these are aligned in two
levels.  Pages meet their wrapper in a join that deals a large host over
many tasks.  Constants are counted by host, place and hash of the text, added
up before the shuffle; a host has at most 1 / ``SHARE`` times the constants
that its pages have blocks.

Defined results: NULL or empty html gives an empty text and no characters; a
page without a host in its url (or with NULL url) belongs to the nameless
host; every row is kept, repeated ones too.  A page that its host's wrapper
cannot read (none that took part) is read as a wrapper of its own, without
constants; a host of fewer than ``LEAST`` different pages has none either.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import cut_lineage

from .batches import slices
from .links import Scratch, salted_left_join
from .registry import load, query

SLOT = "#"              # a slot's token goes on with the open elements that decide on it
LONGEST_GROUP = 24      # nodes of a group that may repeat
FOLDS = 16              # partial folds of one host's wrappers
LEAST = 3               # different pages that have to share a constant
SHARE = 0.8             # of the different pages that have a constant's place

# HTML element names by their role.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark "
                   "nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
TEXT_BLOCKS = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 td th tr caption blockquote pre address "
                        "figcaption summary".split())
# Where an open element ends without its end tag.  A start tag ends the open
# elements of its entry that lie above the innermost one of the entry's bounds.
P_ENDS = TEXT_BLOCKS | frozenset("address article aside center details dialog dir div dl fieldset "
                                 "figure footer form header hgroup hr main menu nav ol search "
                                 "section table tbody tfoot thead ul".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol menu dl table".split())
CELLS = frozenset("td th caption".split())
ROWS = CELLS | frozenset("tr tbody thead tfoot".split())
ENDED_BY = {"li": (frozenset(["li"]), LISTS), "tr": (CELLS | {"tr"}, frozenset(["table"])),
            **dict.fromkeys(("dt", "dd"), (frozenset(["dt", "dd"]), LISTS)),
            **dict.fromkeys(CELLS, (CELLS, frozenset(["table"]))),
            **dict.fromkeys(("tbody", "thead", "tfoot"), (ROWS, frozenset(["table"])))}
VOID = frozenset("area base br col embed hr img input link meta param source track".split())
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "select",
       "object", "math", "canvas", "audio", "video")
ROOTS = frozenset(("article", "main"))
BOILERPLATE = frozenset("nav header footer aside form menu dialog button fieldset head".split())
# Words of class, id and role attributes that mark boilerplate.
MARKS = frozenset("ad ads advert adverts advertisement adsense sponsor sponsored promo promotion "
                  "banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header "
                  "masthead cookie cookies consent gdpr notice notices alert popup modal overlay "
                  "newsletter subscribe subscription signup login share sharing social related "
                  "recommended comment comments disqus reply replies respond widget toolbar "
                  "pagination pager complementary contentinfo search".split())
COMMENTS = frozenset(("comment", "comments", "disqus", "reply", "replies", "respond"))
# Words that name no subject beside a mark in one compound (share-bar, ad-box-top).
PLAIN = frozenset("area bar block body bottom box btn button buttons col column container content "
                  "desktop el form global group head holder icon icons inner item items js layer left "
                  "link links list main mobile outer page panel post posts right row section site small "
                  "slot top ui unit user wrap wrapper zone".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?:svg|math)(?=[\s/])(?:[^<>\"']|\"[^\"]*\"|'[^']*')*(?<=/)>"     # empty
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"
    r".*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>",
    re.S | re.I)
MARKED = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:\s|^)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _tag(name: str, attrs: str) -> str:
    """Start tag as a token; ``!`` stands behind the ones marked boilerplate.

    A class, id or role marks an element when all words of one of its names
    are marks or plain (``ad``, ``share-bar``); a name with any other word in
    it tells of a subject (``social-issues``, ``comment-free``).  The id of a
    block of text is the target of a link and marks nothing; of an article or
    main element only names of comments do.
    """
    if not attrs:
        return name
    marks = COMMENTS if name in ROOTS else MARKS
    for m in MARKED.finditer(attrs):
        if m[1].lower() == "id" and name in TEXT_BLOCKS:
            continue
        for one in (m[2] or m[3] or m[4] or "").split():
            words = set(WORD.findall(CAMEL.sub("-", one).lower()))
            if words & marks and words <= MARKS | PLAIN:
                return name + "!"
    return name + "!" if HIDDEN.search(attrs) and name not in ROOTS else name


def stream(html: str) -> tuple[tuple[str, ...], list[list[str]]]:
    """Tokens of a page, and the blocks of text behind each of its slots."""
    tokens: list[str] = []
    slots: list[list[str]] = []
    line: list[str] = []
    blocks: list[str] = []
    open_: list[str] = []

    def end_slot():
        end_block()
        if blocks:
            tokens.append(SLOT + "/".join(x for x in open_ if _decides(x)))
            slots.append(blocks.copy())
            blocks.clear()

    def end_block():
        text = " ".join(unescape("".join(line)).split())
        line.clear()
        if text:
            blocks.append(text)

    def last_open(names, bounds):
        """Place of the innermost open element of ``names`` above ``bounds``."""
        for k in range(len(open_) - 1, -1, -1):
            name = open_[k].rstrip("!")
            if name in names:
                return k
            if name in bounds or name in ROOTS:
                break
        return None

    def close(k: int):
        if any(_decides(x) for x in open_[k:]):
            end_slot()
        del open_[k:]

    def ended_by(name: str):
        """Ends the text blocks that a start tag ends."""
        if name in P_ENDS:
            k = last_open(("p",), LISTS | CELLS | {"button"})
            if k is not None:
                close(k)
            if open_ and open_[-1].rstrip("!") in LEAVES:
                close(len(open_) - 1)
        names, bounds = ENDED_BY.get(name, ((), ()))
        while names and (k := last_open(names, bounds)) is not None:
            close(k)

    def end_text(name: str):
        """The end tag of a text block; it ends what is open inside it too."""
        end_block()
        k = last_open((name,), ("table",) if name in ROWS else LISTS | CELLS)
        if k is not None:
            close(k)
        elif name not in LEAVES and open_ and open_[-1].rstrip("!") in LEAVES:
            close(len(open_) - 1)

    def put(token: str):
        end_slot()
        tokens.append(token)
        if token[0] == "/":
            for k in range(len(open_) - 1, -1, -1):
                if open_[k].rstrip("!") == token[1:]:
                    del open_[k:]
                    break
            return
        ended_by(token.rstrip("!"))
        if token in ROOTS and not any(x in ROOTS for x in open_):
            open_.clear()       # whatever was left open before an article
        open_.append(token)

    at = 0
    for m in TOKEN.finditer(html):
        line.append(html[at:m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name or name in INLINE:
            continue
        if name in VOID:
            end_block()
            ended_by(name)
        elif m["end"] and name in TEXT_BLOCKS:
            end_text(name)      # no token, as these end tags may be missing
        elif m["end"]:
            put("/" + name)
        else:
            put(_tag(name, m["attrs"]))
    line.append(html[at:])
    end_slot()
    return tuple(tokens), slots


def _decides(element: str) -> bool:
    return element in ROOTS or element in BOILERPLATE or element[-1] == "!"


# --- wrappers: tuples of tokens, ("+", wrapper) and ("?", wrapper) -----------------------------

def fold(nodes: tuple) -> tuple:
    """Neighbouring equal groups become repeated groups, short ones first."""
    nodes = list(nodes)
    size = 1
    while size <= min(LONGEST_GROUP, len(nodes)):
        out, i, found = [], 0, False
        while i < len(nodes):
            group, n = nodes[i:i + size], 1
            if len(group) == size:
                while nodes[i + n * size:i + (n + 1) * size] == group:
                    n += 1
            if n > 1:
                out.append(("+", tuple(group)) if size > 1 or group[0][0] != "+" else group[0])
                i += n * size
                found = True
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
        size = 1 if found and size > 1 else size + 1
    return tuple(nodes)


def _fold_like(nodes: tuple, other: tuple) -> tuple:
    """Single groups that ``other`` repeats become repeated groups."""
    nodes = list(nodes)
    for node in other:
        if isinstance(node, tuple) and node[0] == "+":
            group = list(node[1])
            i = 0
            while i + len(group) <= len(nodes):
                if nodes[i:i + len(group)] == group:
                    nodes[i:i + len(group)] = [node]
                i += 1
    return fold(tuple(nodes))


def _items(nodes: tuple) -> list[tuple]:
    """Nodes with the number of the optional group they are in."""
    out = []
    for g, node in enumerate(nodes):
        if isinstance(node, tuple) and node[0] == "?":
            out += [(x, g) for x in node[1]]
        else:
            out.append((node, None))
    return out


def _key(node):
    return ("+", _key(node[1][0])) if isinstance(node, tuple) else node


def _merge(x, y):
    return ("+", align(x[1], y[1])) if isinstance(x, tuple) else x


def align(a: tuple, b: tuple) -> tuple:
    """The wrapper that reads what ``a`` reads and what ``b`` reads."""
    if a == b:
        return a
    a, b = _fold_like(a, b), _fold_like(b, a)
    left, right = _items(a), _items(b)
    match = SequenceMatcher(None, [_key(x) for x, _ in left], [_key(x) for x, _ in right],
                            autojunk=False)
    codes = match.get_opcodes()
    both_left = {i for op, i1, i2, _, _ in codes if op == "equal" for i in range(i1, i2)}
    both_right = {j for op, _, _, j1, j2 in codes if op == "equal" for j in range(j1, j2)}

    def whole(items, both):
        """Groups that are matched altogether or not at all stay together."""
        seen: dict = {}
        for i, (_, g) in enumerate(items):
            seen.setdefault(g, set()).add(i in both)
        return {g for g, s in seen.items() if g is not None and len(s) == 1}

    keep_left, keep_right = whole(left, both_left), whole(right, both_right)
    out: list[tuple] = []      # (node, group or None)
    for n, (op, i1, i2, j1, j2) in enumerate(codes):
        if op == "equal":
            for i, j in zip(range(i1, i2), range(j1, j2), strict=True):
                (x, g), (y, h) = left[i], right[j]
                group = None
                if g is not None or h is not None:
                    group = (("l", g) if g in keep_left and h is None else
                             ("r", h) if h in keep_right and g is None else ("e", n, i))
                out.append((_merge(x, y), group))
            continue
        for i in range(i1, i2):
            g = left[i][1]
            out.append((left[i][0], ("d", n) if g is None else
                        ("l", g) if g in keep_left else ("d", n, i)))
        for j in range(j1, j2):
            h = right[j][1]
            out.append((right[j][0], ("i", n) if h is None else
                        ("r", h) if h in keep_right else ("i", n, j)))
    nodes: list = []
    last = None
    for node, group in out:
        if group is None:
            nodes.append(node)
        elif group == last:
            nodes[-1] = ("?", (*nodes[-1][1], node))
        else:
            nodes.append(("?", (node,)))
        last = group
    return tuple(nodes)


class Automaton:
    """Positions of a wrapper, which may follow which, and which slots are
    content."""

    def __init__(self, wrapper: tuple):
        self.tokens: list[str] = []
        self.follow: list[set[int]] = []
        self.first, self.last, self.empty = self._sequence(wrapper)
        # (outside boilerplate, and inside an article or main element too)
        self.content = [self._verdict(t) for t in self.tokens]

    def _sequence(self, nodes):
        first: set[int] = set()
        last: set[int] = set()
        empty = True
        for node in nodes:
            if isinstance(node, tuple):
                f, e, n = self._sequence(node[1])
                if node[0] == "+":
                    for p in e:
                        self.follow[p] |= f
                else:
                    n = True
            else:
                self.tokens.append(node)
                self.follow.append(set())
                f = e = {len(self.tokens) - 1}
                n = False
            for p in last:
                self.follow[p] |= f
            first = first | f if empty else first
            last = last | e if n else set(e)
            empty = empty and n
        return first, last, empty

    @staticmethod
    def _verdict(token: str) -> tuple[bool, bool]:
        if token[0] != SLOT:
            return False, False
        path = token[1:].split("/") if len(token) > 1 else []
        good = all(x in ROOTS for x in path)
        return good, good and bool(path)

    def places(self, tokens) -> list[int] | None:
        """The position that each slot of the stream fills, or None if the
        wrapper does not read it."""
        if not tokens:
            return []
        steps: list[dict[int, int]] = []
        now = {p: -1 for p in self.first if self.tokens[p] == tokens[0]}
        for t in tokens[1:]:
            if not now:
                return None
            steps.append(now)
            then: dict[int, int] = {}
            for p in sorted(now):
                for q in self.follow[p]:
                    if self.tokens[q] == t and q not in then:
                        then[q] = p
            now = then
        steps.append(now)
        ends = [p for p in now if p in self.last]
        if not ends:
            return None
        p, out = min(ends), []
        for t, step in zip(reversed(tokens), reversed(steps), strict=True):
            if t[0] == SLOT:
                out.append(p)
            p = step[p]
        return out[::-1]

    def allowed(self, places: list[int]) -> list[bool]:
        """Whether the tags allow each place as content.  Where places lie in
        an article, only those are."""
        inside = any(self.content[p][1] for p in places)
        return [self.content[p][inside] for p in places]

    def read(self, tokens) -> list[bool] | None:
        """Whether the tags allow each slot of the stream as content, or None
        if the wrapper does not read it."""
        places = self.places(tokens)
        return None if places is None else self.allowed(places)


def _load(x):
    return tuple(v if isinstance(v, str) else (v[0], _load(v[1])) for v in x)


@lru_cache(maxsize=512)
def _automaton(wrapper: str) -> Automaton:
    return Automaton(_load(json.loads(wrapper)))


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(),
                          "big", signed=True)


@lru_cache(maxsize=512)
def _constants(written: str) -> frozenset[tuple[int, int]]:
    return frozenset(tuple(map(int, x.split(":"))) for x in written.split(",") if x)


def blocks_of(html: str | None, wrapper: str | None) -> Iterator[tuple[int | None, bool, str]]:
    """Place, whether it is an article's title, and text of every block that
    the tags allow as content.  The place is None where no wrapper reads it."""
    tokens, slots = stream(html or "")
    machine = _automaton(wrapper) if wrapper else None
    places = machine.places(tokens) if machine else None
    known = places is not None
    if not known:
        machine = Automaton(fold(tokens))
        places = machine.places(tokens) or []
    before = [a for a, b in zip(("", *tokens), tokens, strict=False) if b[0] == SLOT]
    for keep, place, tag, blocks in zip(machine.allowed(places), places, before, slots,
                                        strict=False):
        if keep:
            for n, text in enumerate(blocks):
                title = n == 0 and tag == "h1" and machine.content[place][1]
                yield place if known else None, title, text


def main_text(html: str | None, wrapper: str | None, constants: str | None = None) -> str:
    """The content of a page, one block to a line."""
    fixed = _constants(constants or "")
    return "\n".join(text for place, title, text in blocks_of(html, wrapper)
                     if title or not fixed or (place, _hash(text)) not in fixed)


def _host(url):
    """Host of a url, lower-cased; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?"
                                               r"([^/:?#]*)", 1), F.lit("")))


def infer(df: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host`` and ``wrapper`` of all pages."""
    src = df.select(_host(F.col(url_col)).alias("host"),
                    F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def local(batches):
        wrappers: dict[str, tuple] = {}
        seen: set[tuple] = set()
        for b in slices(batches, 1):
            for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                nodes = fold(stream(html)[0])
                if (host, nodes) not in seen:
                    seen.add((host, nodes))
                    wrappers[host] = align(wrappers[host], nodes) if host in wrappers else nodes
        names = sorted(wrappers)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()),
             pa.array([json.dumps(wrappers[h]) for h in names], pa.string())],
            names=["host", "wrapper"])

    def together(group):
        out = None
        for w in sorted(group["wrapper"]):
            nodes = _load(json.loads(w))
            out = nodes if out is None else align(out, nodes)
        one = group.iloc[:1][["host"]].copy()
        one["wrapper"] = json.dumps(out)
        return one

    schema = "host string, wrapper string"
    parts = src.mapInArrow(local, schema).distinct()
    some = (parts.withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(FOLDS)))
            .groupBy("host", "part").applyInPandas(together, schema))
    return some.groupBy("host").applyInPandas(together, schema)


def constants(pages: DataFrame) -> DataFrame:
    """``host`` and ``constants`` (place:hash, by commas) of the pages, given
    as ``host``, ``html`` and ``wrapper``."""
    def local(batches):
        for b in slices(batches, 1):
            host, page, place, text = [], [], [], []
            for h, html, wrapper in zip(*(c.to_pylist() for c in b.columns), strict=True):
                blocks = list(blocks_of(html, wrapper))
                says = _hash("\n".join(x for _, _, x in blocks))
                found = {(p, _hash(x)) for p, title, x in blocks if p is not None and not title}
                found |= {(p, None) for p, _ in found}
                host += [h] * len(found)
                page += [says] * len(found)
                place += [p for p, _ in found]
                text += [x for _, x in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(host, pa.string()), pa.array(page, pa.int64()),
                 pa.array(place, pa.int32()), pa.array(text, pa.int64())],
                names=["host", "page", "place", "text"])

    with Scratch(pages.sparkSession) as scratch:
        # text is NULL in the row that counts all pages of a place
        found = scratch.write(
            pages.select("host", "html", "wrapper")
            .mapInArrow(local, "host string, page long, place int, text long").distinct()
            .groupBy("host", "place", "text").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= LEAST)
            .withColumn("spot", F.struct("host", "place")))
        texts = found.filter("text IS NOT NULL")
        pages_of = found.filter("text IS NULL").select("spot", F.col("n").alias("pages"))
        return cut_lineage(
            salted_left_join(texts, pages_of, "spot", "text", merge=False)
            .filter(F.col("n") >= F.col("pages") * SHARE)
            .select("host", F.concat_ws(":", "place", "text").alias("one"))
            .groupBy("host").agg(F.concat_ws(",", F.sort_array(F.collect_list("one")))
                                 .alias("constants")))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col`` and ``text`` of every page."""
    wrappers = cut_lineage(infer(df, url_col, html_col))
    src = df.select(F.col(id_col).alias("k"), F.col(url_col).alias("u"),
                    F.col(html_col).alias("html"), _host(F.col(url_col)).alias("host"))
    src = src.withColumn("by", F.xxhash64("k", "u"))
    fixed = constants(salted_left_join(src, wrappers, "host", "by", merge=False))
    wrappers = cut_lineage(wrappers.join(fixed, "host", "left"))
    rows = (salted_left_join(src, wrappers, "host", "by", merge=False)
            .select("k", "u", "html", "wrapper", "constants"))

    def run(batches):
        for b in slices(batches, 2):
            text = [main_text(*x) for x in
                    zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string())],
                                             names=["k", "u", "text"])

    schema = T.StructType([T.StructField("k", src.schema["k"].dataType),
                           T.StructField("u", src.schema["u"].dataType),
                           T.StructField("text", T.StringType())])
    return rows.mapInArrow(run, schema).toDF(id_col, url_col, "text")


@query("op4_wrapper_extraction")
def op4_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    out = extract(load(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
