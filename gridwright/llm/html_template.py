"""Main text of web pages by templates deduced from pages of one host.

*Tokens* are opening and closing tags of elements in their role: the path of open
elements (with class and id, digits dropped).  A token's occurrence vector holds
how often it occurs on each page of the host.  Tokens with equal vectors form an
equivalence class; a vector is known by a signature, the exclusive or of a hash of
page and count over all pages, which adds up in any order and place.  Classes of
tokens that occur once on each page that has them are used.  The class of all
pages is the skeleton, others are the layouts of some pages.

A class is *valid* if its tokens are in one order on all its pages, and if it is
nested: from its first token to its last it stays in one gap between neighbouring
tokens of any other class.  A class that isn't is broken into its elements, each a
class of its own (an element's two tags are always in order and nested).

The innermost gaps are the slots (:class:`Slots`).  A gap with the same text on
each of ``FEW`` pages or more that have text there is template text, and so is the
text of a role that is the same on as many: it is extracted within ``article`` and
``main`` only, and gives no weight.  Slots are weighed by the prose in them: text
outside of links and of elements set aside.  A containing element of a class is a
*region* if two thirds of its pages' weight lie in the slots from its one tag to
the other; the innermost region of a page is extracted, with all text in its slots.
Names of elements only break ties: a region never goes inside an ``article`` or
``main``; one that holds half of the region's prose, or of that of a page without
region, stands for it; and elements for menus, headers, footers, sidebars,
notices, adverts, forms and reader comments are set aside, by their
tags or where a class or id says nothing else (``ad-box``, not ``related-work``).
Outside of a region its pages' heading (``h1``) is extracted too, if it differs.

Signatures are summed per batch, then per host in Spark: no host's pages are
gathered.  So are the classes' orders, the gaps' texts and the weights, by another
pass over the pages of hosts of ``FEW`` pages or more (of fewer there is no telling
what is the same), and one more for hosts where classes were broken or gaps
closed.  Classes, regions and template text are a table of host and role, whatever
their share of the host's pages.  It is broadcast if it is within
``TEMPLATE_BYTES``; else the pages' roles are joined with it by host and role,
and each page gets its own of them.

Null and empty html give an empty text.  Urls without host share the template
of the empty host.  Repeated rows are pages each, but cancel in pairs in the
signatures (classes that meet so are told apart by their order); ties in depth go to the slot with more prose, then to the first; a
null id passes through; an empty table gives an empty result; other columns play
no part.  The time for a very long page follows its length.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.scratch import Scratch
from gridwright.llm.skew import join_counted
from gridwright.llm.texts import record_batch, slices

FEW = 4
TEMPLATE_BYTES = 16 << 20
HOST = r"(?s)^.*?://([^/?#]*)"
NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
END = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
ELEMENT, TEMPLATE, REGION, MEMBER, AFTER_OPEN, AFTER_CLOSE = range(6)
GAPS = f"what in ({AFTER_OPEN}, {AFTER_CLOSE})"
BREAKS = 2
# fixed values: elements of HTML by how they behave
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("script style noscript template textarea iframe svg title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ITEMS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
ARTICLES = frozenset(("article", "main"))
CONTAINERS = frozenset("html body div section td center".split()) | ARTICLES
ASIDE = frozenset("head nav header footer aside form button select dialog menu script style noscript template textarea iframe svg title".split())

# how sites call what isn't the article, and what says nothing beside such a name
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo menu nav navbar navigation breadcrumb breadcrumbs sidebar aside complementary footer contentinfo header masthead "
    "cookie cookies consent notice alert popup modal newsletter subscribe share sharing social related comment comments replies disqus login search".split()
)
NEUTRAL_WORDS = frozenset(
    "area article articles bar bars block blocks body bottom box boxes button buttons column container content form group icons inner item items left link links list main module outer "
    "page panel policy post posts right row section site slot text thread top unit user widget widgets wrap wrapper".split()
)


def set_aside(word: str) -> bool:
    """Whether a class or id names something beside the article, and nothing more."""
    parts = [x.lower() for x in PART.findall(word)]
    return any(x in ASIDE_WORDS for x in parts) and all(x in ASIDE_WORDS or x in NEUTRAL_WORDS for x in parts)


@dataclass(slots=True)
class Element:
    """An open element; ``role`` is a hash of its path, the flags hold for what is inside."""

    name: str
    role: int
    depth: int
    parent: Element | None
    aside: bool
    article: bool
    free: bool  # no article around it
    link: bool
    region: Element | None = None
    mass: int = 0
    content: int = 0


def digest(x: str) -> int:
    h = xxhash.xxh64_intdigest(x)
    return h - (1 << 64) if h >> 63 else h


ROOT_ROLE = 0
"""The role of the page itself."""


class Reader:
    """Pages as elements and texts, closed as browsers close them; remembers tags and roles between pages."""

    def __init__(self) -> None:
        self.tags: dict[tuple[str, str], tuple[str, bool]] = {}
        self.roles: dict[tuple[int, str], int] = {}

    def tag(self, name: str, attributes: str) -> tuple[str, bool]:
        """A tag's own role, and whether it is set aside."""
        words = [w for v in ATTRIBUTE.findall(attributes) for w in v.strip("\"'").split()] if attributes else []
        top = name in ("html", "body") or name in ARTICLES
        return ".".join([name, *(x.lower() for w in words for x in PART.findall(w))]), not top and (name in ASIDE or any(map(set_aside, words)))

    def read(self, page: str) -> Iterator[tuple[str, Element, str | None, bool]]:
        """``open``, ``close`` or ``text``, the element, the text (or None), and whether a block ends there."""
        if len(self.tags) > 100_000 or len(self.roles) > 100_000:
            self.tags.clear()
            self.roles.clear()
        root = Element("", ROOT_ROLE, 0, None, False, False, True, False)
        stack: list[Element] = [root]
        inside: dict[str, list[int]] = {}  # by name: where in the stack it stands
        at, quotes, n, last = 0, True, len(page), page.rfind(">")

        def innermost(names: tuple[str, ...]) -> int:
            return max((inside[x][-1] for x in names if inside.get(x)), default=0)

        def pop(to: int) -> Iterator[tuple[str, Element, str | None, bool]]:
            breaks = False
            while len(stack) > to:
                gone = stack.pop()
                inside[gone.name].pop()
                breaks = breaks or gone.name not in INLINE
                yield "close", gone, None, breaks

        while at < n:
            mark = page.find("<", at)
            if mark != at:
                yield "text", stack[-1], page[at : mark if mark >= 0 else n], False
                if mark < 0:
                    break
                at = mark
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                at = n if end < 0 else end + 3
                continue
            closing = page.startswith("</", at)
            named = NAME.match(page, at + 1 + closing)
            if not named or at > last:
                if named or at > last or page[at + 1 : at + 2] not in ("!", "?", "/"):  # no tag
                    yield "text", stack[-1], "<", False
                    at += 1
                else:
                    at = page.find(">", at) + 1
                continue
            name, end = named[0].lower(), named.end()
            while quotes:  # the first > outside of quotes
                mark = END.search(page, end)
                if mark and mark[0] == ">":
                    end = mark.start()
                    break
                end = page.find(mark[0], mark.end()) + 1 if mark else 0
                quotes = end > 0  # else quotes don't pair: from here on they are read as any character
            if not quotes:
                end = page.find(">", named.end())
            attributes, at = page[named.end() : end], end + 1
            if closing:
                if to := innermost((name,)):
                    yield from pop(to)
                elif name == "br" or name not in INLINE:
                    yield "break", stack[-1], None, True
                continue
            if name in CLOSES_P:
                if to := innermost(("p",)):
                    yield from pop(to)
            elif name in ITEMS:
                same, bounds = ITEMS[name]
                if (to := innermost(same)) > innermost(bounds):
                    yield from pop(to)
            own, aside = self.tags.get((name, attributes)) or self.tags.setdefault((name, attributes), self.tag(name, attributes))
            over = stack[-1]
            role = self.roles.get((over.role, own)) or self.roles.setdefault((over.role, own), digest(f"{over.role}>{own}"))
            new = Element(name, role, over.depth + 1, over, over.aside or aside, over.article or name in ARTICLES, not over.article, over.link or name == "a")
            yield "open", new, " " if name in ("br", "wbr") else None, name not in INLINE
            if name in HIDDEN:
                shut = re.compile(f"</{name}\\s*>", re.I).search(page, at)
                at = shut.end() if shut else n
                yield "close", new, None, False
            elif name in VOID or attributes.endswith("/"):
                yield "close", new, None, False
            else:
                inside.setdefault(name, []).append(len(stack))
                stack.append(new)
        yield from pop(1)
        yield "close", root, None, True


@dataclass(slots=True)
class Known:
    """What is known of a host's roles: template text, regions, the classes of those that occur once, and gaps that are template text."""

    template: frozenset[int] = frozenset()
    regions: frozenset[int] = frozenset()
    classes: dict[int, int] = field(default_factory=dict)
    left: dict[int, int] = field(default_factory=dict)  # by class: its tokens
    shut: frozenset[tuple[int, int]] = frozenset()


NOTHING = Known()


def knowledge(column: pa.ListArray) -> Iterator[Known]:
    """What is known, row by row; rows of one host mostly share it."""
    seen: dict[tuple[bytes, ...], Known] = {}
    offsets, fields = column.offsets.to_pylist(), [column.values.field(i).to_numpy() for i in range(3)]
    for i, there in enumerate(column.is_valid().to_pylist()):
        parts = [f[offsets[i] : offsets[i + 1]] for f in fields] if there else []
        key = tuple(x.tobytes() for x in parts)
        if key not in seen:
            rows = list(zip(*(x.tolist() for x in parts)))
            classes = {role: own for role, what, own in rows if what == MEMBER}
            left: dict[int, int] = {}
            for own in classes.values():
                left[own] = left.get(own, 0) + 2
            of = lambda kind: frozenset(role for role, what, _ in rows if what == kind)  # noqa: E731, B023
            seen[key] = Known(of(TEMPLATE), of(REGION), classes, left, frozenset((role, what) for role, what, _ in rows if what in (AFTER_OPEN, AFTER_CLOSE)))
        yield seen[key]


class Slots:
    """Walks along a page's tokens: ``gap`` is the token in front of the innermost gap, ``order`` each class's tokens, ``broken`` classes that cross others."""

    def __init__(self, known: Known):
        self.known = known
        self.gap: tuple[int, int] | None = None
        self.order: dict[int, int] = {}
        self.broken: set[int] = set()
        self.open: list[list] = []  # class, token in front, open elements, tokens to come
        self.place: dict[int, int] = {}
        self.token(ROOT_ROLE, AFTER_OPEN)

    def leave(self) -> None:
        """The innermost class ends, and broken ones around it."""
        del self.place[self.open.pop()[0]]
        while self.open and self.open[-1][0] in self.broken:
            del self.place[self.open.pop()[0]]

    def token(self, role: int, side: int) -> None:
        own = self.known.classes.get(role)
        if own is None or own in self.broken:
            return
        if self.known.left[own] > 2:
            self.order[own] = hash((self.order.get(own, 0), role, side))
        if own not in self.place:
            self.place[own] = len(self.open)
            self.open.append([own, None, 0, self.known.left[own]])
        while self.open[-1][0] != own:  # a class began in this one's gap and hasn't ended
            if self.open[-1][2]:  # the token is in an element of it, others are outside
                self.broken.add(own)
                return
            self.broken.add(self.open[-1][0])
            self.leave()
        last = self.open[-1]
        last[1] = (role, side)
        last[2] += 1 if side == AFTER_OPEN else -1
        last[3] -= 1
        if not last[3]:
            self.leave()
        self.gap = self.open[-1][1] if self.open else None


def blocks(page: str, reader: Reader, known: Known) -> Iterator[str]:
    """The blocks of the page's slots, in order."""
    shown: list[tuple[Element, str, bool]] = []
    slots, regions = Slots(known) if known.shut else None, known.regions
    best, article_mass, all_mass = None, 0, 0
    for kind, e, text, breaks in reader.read(page):
        if slots and kind in ("open", "close"):
            slots.token(e.role, AFTER_OPEN if kind == "open" else AFTER_CLOSE)
        if kind == "open":
            e.region = e if e.role in regions else e.parent.region
        elif kind == "close" and e.region is e and e.mass:
            if best is None or (e.depth, e.mass) > (best.depth, best.mass):
                best = e
            if e.parent.region is not None:
                e.parent.region.mass += e.mass
        if text and not e.aside:
            same = not e.article and (e.role in known.template or slots is not None and slots.gap in known.shut)
            shown.append((e, "" if same else text, breaks))
            if kind == "text" and (size := len(text.strip())):
                all_mass += size
                article_mass += size * e.article
                if e.region is not None:
                    e.region.mass += size
        elif breaks:
            shown.append((e, "", True))
    if best is None:
        article = 2 * article_mass >= all_mass > 0
    else:
        article = 2 * sum(len(t.strip()) for e, t, _ in shown if e.region is best and e.article) >= best.mass
    held: list[str] = []
    for e, text, breaks in shown:
        if breaks and held:
            yield " ".join("".join(held).split())
            held = []
        here = (best is None or e.region is best) and (e.article or not article) or best is not None and not article and e.name == "h1"
        if text and here:
            held.append(html.unescape(text))
    if held:
        yield " ".join("".join(held).split())


def extract(page: str | None, reader: Reader, known: Known = NOTHING) -> str:
    """The main text: non-empty blocks on a line each."""
    return "\n".join(x for x in blocks(page or "", reader, known) if x)


SUMS = "host string, role bigint, what int, signature bigint, pages bigint, total bigint, depth int, container boolean, article boolean, texts bigint, low bigint, high bigint, mass bigint, page_mass bigint, sub_low bigint, sub_high bigint"
_KINDS = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}


def tokens(pages: DataFrame) -> DataFrame:
    """``host``, ``role`` and what adds up to its vector's signature, text and weight, of every batch of ``pages(host, html, name[, known])``.

    ``name`` tells pages of equal content apart; repeated rows of one name cancel
    in pairs.  Text that is ``known`` as template text has no weight.  Where classes
    are known, there are also the orders of their tokens (``what`` is ``MEMBER``,
    ``role`` the class; the widest range for a class that crosses another), and the
    texts of their gaps (``AFTER_OPEN`` or ``AFTER_CLOSE`` of the role in front).
    """
    columns = ["host", "html", "name", *(["known"] if "known" in pages.columns else [])]
    schema = pa.schema([(x.split()[0], _KINDS[x.split()[1]]) for x in SUMS.split(", ")])

    def measure(page: str, reader: Reader, known: Known, gaps: dict[tuple[int, int], list]) -> dict[int, list]:
        """By role: count, depth, container, article, weight, hash of all text inside, direct texts; ``gaps`` gets if in an article and a hash, twice."""
        slots = Slots(known) if known.classes else None
        found: dict[int, list] = {}
        texts: dict[int, list[str]] = {}
        for kind, e, text, _ in reader.read(page):
            if slots and kind in ("open", "close"):
                slots.token(e.role, AFTER_OPEN if kind == "open" else AFTER_CLOSE)
            if kind == "text":
                if not e.aside and (size := len(text.strip())):
                    h = digest(text)
                    texts.setdefault(e.role, []).append(text)
                    if slots and slots.gap:
                        gap = gaps.setdefault(slots.gap, [False, 0])
                        gap[0], gap[1] = gap[0] or e.article, (gap[1] * 31 + h) & 0xFFFFFFFFFFFFFFFF
                    if not e.link and (e.article or e.role not in known.template and not (slots and slots.gap in known.shut)):
                        e.mass += size
                        e.content = (e.content * 31 + h) & 0xFFFFFFFFFFFFFFFF
            elif kind == "close":
                if e.parent is not None:
                    e.parent.mass += e.mass
                    if e.mass:
                        e.parent.content = (e.parent.content * 31 + e.content) & 0xFFFFFFFFFFFFFFFF
                own = found.get(e.role)
                if own is None:
                    found[e.role] = [1, e.depth, e.name in CONTAINERS and not e.aside and e.free, e.article, e.mass, e.content]
                else:
                    own[0] += 1
                    own[4] += e.mass
                    own[5] ^= e.content
        for role, t in texts.items():
            found.setdefault(role, [1, 0, False, False, 0, 0]).append("\n".join(t))
        for (role, side), (article, h) in gaps.items():
            gaps[role, side] = [article, h - (1 << 63), h - (1 << 63)]
        for own, h in slots.order.items() if slots else ():
            gaps[own, MEMBER] = [False, h, h] if own not in slots.broken else [False, -(1 << 63), (1 << 63) - 1]
        return found

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in slices(batches):
            sums: dict[tuple[str, int, int], list] = {}
            held = knowledge(batch.column(3)) if batch.num_columns > 3 else repeat(NOTHING)
            for host, page, name, known in zip(*(c.to_pylist() for c in batch.columns[:3]), held):
                page, gaps = page or "", {}
                own = f"{name} {xxhash.xxh64_hexdigest(page)}"
                found = measure(page, reader, known, gaps)
                page_mass = found[ROOT_ROLE][4]
                for role, (n, depth, container, article, mass, content, *text) in found.items():
                    n = 1 if role == ROOT_ROLE else n
                    content -= 1 << 63
                    text = text[0] if text else None
                    x = digest(text) if text is not None else None
                    mark = digest(f"{own} {n}")
                    s = sums.get((host, role, ELEMENT))
                    if s is None:
                        sums[host, role, ELEMENT] = [mark, 1, n, depth, container, article, int(x is not None), x, x, mass, page_mass, content, content]
                        continue
                    s[0] ^= mark
                    s[1] += 1
                    s[2] += n
                    if x is not None:
                        s[6] += 1
                        s[7], s[8] = (x, x) if s[7] is None else (min(s[7], x), max(s[8], x))
                    s[9] += mass
                    s[10] += page_mass
                    s[11], s[12] = min(s[11], content), max(s[12], content)
                for (role, what), (article, low, high) in gaps.items():
                    s = sums.setdefault((host, role, what), [0, 0, 0, 0, False, False, 0, low, high, 0, 0, 0, 0])
                    s[1], s[5], s[6], s[7], s[8] = s[1] + 1, s[5] or article, s[6] + 1, min(s[7], low), max(s[8], high)
            if sums:
                keys, rows = list(sums), list(sums.values())
                yield record_batch([*map(list, zip(*keys)), *(list(x) for x in zip(*rows))], schema)

    return pages.select(*columns).mapInArrow(apply, SUMS)


def classes(pages: DataFrame) -> DataFrame:
    """The tokens of every host: ``host, role, what``, the class's ``signature, pages, total``, and sums over all pages."""
    return tokens(pages).groupBy("host", "role", "what").agg(
        F.bit_xor("signature").alias("signature"), F.sum("pages").alias("pages"), F.sum("total").alias("total"), F.min("depth").alias("depth"),
        F.max("container").alias("container"), F.max("article").alias("article"), F.sum("texts").alias("texts"), (F.min("low") < F.max("high")).alias("differs"),
        F.sum("mass").alias("mass"), F.sum("page_mass").alias("page_mass"), (F.min("sub_low") < F.max("sub_high")).alias("varies"),
    )


def members(found: DataFrame, hosts: DataFrame) -> DataFrame:
    """The roles of :func:`classes` that occur once on each page that has them, as ``MEMBER`` of the class of equal vectors (``value``, its least role)."""
    once = join_counted(found.where("pages = total"), hosts, "host", "roles", found.count()).select("host", "role", "signature", "pages")
    first = once.groupBy("host", "signature", "pages").agg(F.min("role").alias("value"))
    return once.join(first, ["host", "signature", "pages"]).select("host", "role", F.lit(MEMBER).alias("what"), "value", "pages")


def regions(found: DataFrame) -> DataFrame:
    """The roles of :func:`classes` that are regions: once on each page that has them, with two thirds of the weight."""
    # on few pages there is no telling what is the same
    region = f"what = {ELEMENT} and role <> {ROOT_ROLE} and container and pages = total and mass > 0 and (varies or pages < {FEW}) and mass * 3 >= page_mass * 2"
    return found.where(region).select("host", "role", F.lit(REGION).alias("what"), F.lit(0).cast("bigint").alias("value"), "pages")


def template(pages: DataFrame, scratch: Scratch, template_bytes: int = TEMPLATE_BYTES) -> DataFrame:
    """``host``, ``role``, ``what`` is known of it, a ``value`` (the class) and ``pages``, of ``pages(host, html, name)``.

    The rows of a class are there for hosts with gaps that are template text.
    Pages of hosts whose classes broke or that have such gaps are weighed again;
    after ``BREAKS`` turns all classes of a host that still has broken ones are.
    """
    found = scratch.cut(classes(pages))
    size = F.max(F.when(F.col("role") == ROOT_ROLE, F.col("pages"))).alias("n")
    large = scratch.cut(found.groupBy("host").agg(size, F.count("*").alias("roles"), F.max("differs").alias("any")).where(f"n >= {FEW}").drop("n"))
    same = found.where(f"texts >= {FEW} and not differs and not article").select("host", "role", "pages")
    same = join_counted(same, large.where("any"), "host", "roles", found.count()).select("host", "role", F.lit(TEMPLATE).alias("what"), F.lit(0).cast("bigint").alias("value"), "pages")
    same = scratch.cut(same)
    done = same.unionByName(regions(found.join(large, "host", "left_anti")))
    todo = scratch.cut(same.unionByName(members(found, large)))
    turn = 0
    while todo.limit(1).count():
        sums = scratch.cut(classes(attached(pages, todo, scratch, template_bytes).where("known is not null")))
        wrong = scratch.cut(sums.where(f"what = {MEMBER} and differs").select("host", F.col("role").alias("value")))
        shut = sums.where(f"{GAPS} and texts >= {FEW} and not differs and not article").select("host", "role", "what", F.lit(0).cast("bigint").alias("value"), "pages")
        shut = scratch.cut(shut.join(todo.where(GAPS), ["host", "role", "what"], "left_anti").join(wrong, "host", "left_anti"))
        again = wrong.select("host").union(shut.select("host")).distinct()
        closed = todo.where(GAPS).select("host").distinct()
        ready = todo.where(f"{GAPS} or what = {MEMBER}").join(closed, "host", "left_semi").join(again, "host", "left_anti")
        done = done.unionByName(regions(sums.join(again, "host", "left_anti"))).unionByName(ready)
        apart = wrong.select("host", *(["value"] if turn < BREAKS else [])).distinct().withColumn("apart", F.lit(True))
        broken = todo.join(wrong, "host", "left_semi").join(apart, apart.columns[:-1], "left")
        broken = broken.withColumn("value", F.when(F.col("apart") & (F.col("what") == MEMBER), F.col("role")).otherwise(F.col("value"))).drop("apart")
        more = todo.join(shut, "host", "left_semi").unionByName(shut)
        todo, turn = scratch.cut(broken.unionByName(more)), turn + 1
    return scratch.cut(done)


def attached(pages: DataFrame, known: DataFrame, scratch: Scratch, template_bytes: int) -> DataFrame:
    """``pages`` with ``known``, roles of the page's host and what they are: all of it, or those on the page if all are too large to broadcast."""
    size = known.agg(F.sum(F.length("host") + 48).alias("b"), F.sum("pages").alias("n")).first()
    if (size.b or 0) <= template_bytes:
        return pages.join(F.broadcast(known.groupBy("host").agg(F.collect_list(F.struct("role", "what", "value")).alias("known"))), "host", "left")
    keyed = pages.withColumn("key", F.xxhash64("host", "html"))
    tag = F.struct("host", "role").alias("tag")
    met = join_counted(page_roles(keyed).select("key", tag), known.select(tag, "what", "value", "pages"), "tag", "pages", size.n)
    own = met.groupBy("key").agg(F.collect_set(F.struct("tag.role", "what", "value")).alias("known"))
    counts = keyed.groupBy("key").agg(F.count("*").alias("n"))
    own = scratch.cut(counts.join(own, "key", "left"))
    return join_counted(keyed, own, "key", "n", own.agg(F.sum("n").alias("n")).first().n or 0)


def page_roles(pages: DataFrame) -> DataFrame:
    """``key``, ``host`` and ``role`` of every element of a page."""
    schema = pa.schema([("key", pa.int64()), ("host", pa.string()), ("role", pa.int64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in slices(batches):
            for key, host, page in zip(*(c.to_pylist() for c in batch.columns)):
                roles = list({e.role for _, e, *_ in reader.read(page or "")})
                yield record_batch([[key] * len(roles), [host] * len(roles), roles], schema)

    return pages.select("key", "host", "html").mapInArrow(apply, "key bigint, host string, role bigint")


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", template_bytes: int = TEMPLATE_BYTES) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page."""
    scratch = Scratch(pages.sparkSession, "templates")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), HOST, 1).alias("host"))
    named = rows.select("host", "html", F.concat_ws(" ", "page_id", "url").alias("name"))
    both = attached(rows, template(named, scratch, template_bytes), scratch, template_bytes)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in slices(batches):
            texts = [extract(page, reader, known) for page, known in zip(batch.column(2).to_pylist(), knowledge(batch.column(3)))]
            yield record_batch([batch.column(0), batch.column(1), texts, [len(x) for x in texts]], schema)

    return both.select("page_id", "url", "html", "known").mapInArrow(apply, "page_id bigint, url string, text string, n_chars bigint")
