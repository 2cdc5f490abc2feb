"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: its tags and its strings (the text of a block), each told apart by the
path of elements that holds it. Tokens that occur on the same pages of a host, equally often on each,
have the same occurrence vector and form an equivalence class. Vectors are never gathered: each token has
the number of pages and of occurrences, and the sum of a hash of (page, occurrences), which partial
aggregation adds up map-side, so a host that holds a third of all pages is no hot spot. Classes on a
SHARE of a host's pages, and on two at least, make its templates: a host can have several, parts may be
missing from some pages, and odd pages don't matter. Pages without any token don't count, and equal ones
count once. On a page a class is valid if its tokens come in the same order in every repetition, and
classes nest into a tree whose gaps are the slots.

What the template says: (1) Strings of a template are dropped. (2) From the root inwards, the part that
comes once a page and holds most of what the host's pages say is the article's element. (3) A slot outside
it is dropped if most of its strings come again on other pages of the host, clearly more often than those
in the article do: menus, adverts and notices are drawn from a small stock.

What a host's pages can't tell (a host of one page; comments, which differ on every page) is left to what
the markup says: elements and roles that are never part of an article, class or id words that name such a
part, and <article> or <main>, outside of which nothing counts. Strings on fewer than SURE_PAGES pages or on
less than half of the host's may also be lines that some articles or near copies share: in an article they
stay, and elsewhere too where they make up most of the text. If all strings of an article belong to the
template (a host of equal pages), they are its text.

Defined results: null html is empty; a null url or one without host makes a host of its own kind; a
page without article text has an empty string; broken markup is repaired as browsers do (unclosed and
stray tags, no more than DEPTH elements deep), an unclosed quote ends at the tag's end, and a tag without
end is text; very long pages are read whole, in time proportional to their length; ties between parts
that hold as much go to the first by hash; an empty table gives an empty result; repeated rows are
extracted alike; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from hashlib import blake2b

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.base import batched, placed, saved, with_numbers

#: The share of a host's pages that a template needs, and pages from which its strings are surely no text of near copies.
SHARE, SURE_PAGES = 0.25, 5
#: The share of strings that come again from which a slot is boilerplate, and by how much it must exceed the article's.
AGAIN, CLEARLY = 0.5, 0.25
#: Templates' tokens up to which they are broadcast (20 bytes each).
BROADCAST_TOKENS = 500_000
DEPTH = 512

# HTML's element names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table div section article body html td th nav aside header footer main form select".split())
OUTSIDE = frozenset("head nav header footer aside form menu dialog button select option textarea script style noscript template iframe svg math object canvas audio video title".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form toolbar".split())
#: Whole words of class or id that name a part outside the article; <html>, <body>, <main> and <article> aren't judged by them, but for COMMENT.
NAMED = re.compile(
    r"(?:site|global|top)[-_](?:header|banner)|header|masthead"
    r"|(?:(?:site|page|main|global|top|bottom|left|right|primary|secondary|sticky|user|reader|post|article|entry|story|blog|social|cookie|js)[-_])*"
    r"(?:ads?|adverts?|advertisements?|advertising|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|disqus|footer|gdpr|menu|modal|nav|navbar|navigation|newsletter|notices?|pagination|popup|promos?|promoted|related|replies|share|sharing|sidebar|social|sponsored|sponsors?|subscribe|toc|toolbar|widgets?)"
    r"(?:[-_](?:[0-9]+|area|bar|block|box|container|content|form|inner|item|links?|list|menu|notice|posts?|section|slot|thread|unit|widget|wrap|wrapper))*",
    re.I,
)
COMMENT = re.compile(r"(?:(?:user|reader|post|article|entry|story|blog)[-_])*(?:comments?|reply|replies)(?:[-_](?:[0-9]+|item|list|thread))*", re.I)

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*+>|<\?[^>]*+>|<(/?+)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"']\S*+)))?+")
#: White space inside a block, as HTML has it, and the no-break space that a reference may stand for.
BLANK = re.compile(r"[\s\u00a0]+")


def mark(*parts: object) -> int:
    """A signed 64-bit hash."""
    return int.from_bytes(blake2b("\x00".join(map(str, parts)).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


class Token:
    """A tag (text is None) or a string, with the path of the element that holds it and what the markup says of it.

    outside: by element or role; named: by class or id; depth: inside so many <article> or <main>; within: in the article's element.
    """

    __slots__ = ("hash", "text", "path", "parent", "outside", "named", "depth", "within")

    def __init__(self, hash_: int, text: str | None, path: int, parent: int, of: Element):
        self.hash, self.text, self.path, self.parent = hash_, text, path, parent
        self.outside, self.named, self.depth, self.within = of.outside, of.named, of.depth, of.within


class Element:
    __slots__ = ("name", "path", "outside", "named", "depth", "within")

    def __init__(self, name: str, path: int, outside: bool, named: bool, depth: int, within: bool):
        self.name, self.path, self.outside, self.named, self.depth, self.within = name, path, outside, named, depth, within


class Page:
    """The tokens of a page. article: the path of the article's element, if the host's template has one."""

    def __init__(self, source: str, article: int | None = None):
        self.tokens: list[Token] = []
        self.article = article
        self.stack: list[Element] = [Element("", 0, False, False, 0, False)]
        self.held: dict[str, int] = {}  # how many open elements have a name
        self.text: list[str] = []
        self.marks: dict[tuple, int] = {}
        at = seek = 0
        last = source.rfind(">")
        while (lt := source.find("<", seek)) >= 0:
            # Without an end after it no "<" is a tag, and only an unclosed comment is none of the text.
            m = MARKUP.match(source, lt) if lt < last or source.startswith("<!--", lt) else None
            if m is None:
                if lt > last and source.find("<!--", lt) < 0:
                    break
                seek = lt + 1
                continue
            if lt > at:
                self.text.append(source[at:lt])
            at = seek = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                self.close(name)
                continue
            self.open(name, m[3])
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*+>", re.I).search(source, at)
                at = seek = end.end() if end else len(source)
                self.close(name)
        if at < len(source):
            self.text.append(source[at:])
        self.flush()

    def hashed(self, *parts) -> int:
        found = self.marks.get(parts)
        if found is None:
            found = self.marks[parts] = mark(*parts)
        return found

    def flush(self) -> None:
        """End a block."""
        if self.text:
            text = BLANK.sub(" ", entities.unescape("".join(self.text))).strip()
            self.text = []
            if text:
                top = self.stack[-1]
                self.tokens.append(Token(self.hashed("s", top.path, text), text, top.path, top.path, top))

    def open(self, name: str, attributes: str) -> None:
        if name == "br":
            self.text.append(" ")
            return
        if name in INLINE:
            return
        self.flush()
        if name in CLOSES_P:
            self.pop_to(("p",), SCOPE)
        if name in SIBLINGS:
            self.pop_to(SIBLINGS[name], SCOPE - {"td", "th"} if name == "tr" else SCOPE - set(SIBLINGS[name]))
        words, role = [], ""
        if attributes and not attributes.isspace():
            for a in ATTRIBUTE.finditer(attributes):
                key = a[1].lower()
                if key in ("class", "id"):
                    words += (a[2] or a[3] or a[4] or "").split()
                elif key == "role":
                    role = (a[2] or a[3] or a[4] or "").strip().lower()
                elif key == "hidden":
                    role = "dialog"
        top = self.stack[-1]
        inner = name in ("article", "main") or role in ("main", "article")
        # An article's own header holds its title.
        outside = top.outside or (name in OUTSIDE and not (name == "header" and top.depth)) or role in ROLES
        judge = COMMENT if inner or name in ("html", "body") else NAMED
        named = top.named or (name not in ("html", "body") and any(judge.fullmatch(w) for w in words))
        path = self.hashed("t", top.path, name, *words)
        own = Element(name, path, outside, named, top.depth + inner, top.within or path == self.article)
        self.tokens.append(Token(path, None, path, top.path, own))
        if name not in VOID and len(self.stack) <= DEPTH:
            self.stack.append(own)
            self.held[name] = self.held.get(name, 0) + 1

    def cut(self, k: int) -> None:
        for x in self.stack[k:]:
            self.held[x.name] -= 1
        del self.stack[k:]

    def pop_to(self, names: tuple[str, ...], scope) -> None:
        if not any(self.held.get(n) for n in names):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].name in names:
                self.cut(k)
                return
            if self.stack[k].name in scope:
                return

    def close(self, name: str) -> None:
        if name in INLINE or name == "br":
            return
        self.flush()
        if not self.held.get(name):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].name == name:
                path = self.stack[k].path
                self.cut(k)
                top = self.stack[-1]
                self.tokens.append(Token(self.hashed("/", path), None, path, top.path, top))
                return


def template(tokens: list, classes: dict[int, int]) -> set[int]:
    """Of a page's tokens the places that belong to valid classes, nested. classes: class of a token hash."""
    places: dict[int, list[int]] = {}
    for k, t in enumerate(tokens):
        if t.hash in classes:
            places.setdefault(classes[t.hash], []).append(k)
    found: set[int] = set()
    # From the class with the widest span inwards; one whose repetitions differ in order, or that
    # crosses a gap of the class around it, isn't part of the tree.
    gap = [0] * (len(tokens) + 1)
    for own in sorted(places.values(), key=lambda p: (p[0] - p[-1], p[0])):
        period = len({tokens[k].hash for k in own})
        order = [tokens[k].hash for k in own]
        if len(own) % period or any(order[k] != order[k % period] for k in range(len(own))):
            continue
        if any(len({gap[k] for k in own[r : r + period]}) > 1 for r in range(0, len(own), period)) and own[0] not in found:
            if len({gap[k] for k in own}) != len(own):
                continue
        found.update(own)
        if len(own) > 1:
            stamp = len(found) * (len(tokens) + 1)
            edges = iter([*own, len(tokens)])
            edge, n = next(edges), 0
            for k in range(own[0], own[-1]):
                if k == edge:
                    n, edge = n + 1, next(edges)
                gap[k] = stamp + n
    return found


class Template:
    """What a host's pages tell: the class of each token of its templates, which of them near copies may share, the article's element, and the slots to drop."""

    def __init__(self, classes: dict[int, int] | None = None, unsure=(), article: int | None = None, dropped=()):
        self.classes, self.unsure, self.article, self.dropped = classes or {}, frozenset(unsure), article, frozenset(dropped)


def main_text(source: str | None, known: Template, markup: bool = True) -> str:
    """The strings of the slots that are the article's, in page order. markup: whether names and elements decide what the template leaves open."""
    tokens = Page(source or "", known.article).tokens
    strings = [(k, t) for k, t in enumerate(tokens) if t.text is not None and not (t.outside and markup)]
    strings = [(k, t) for k, t in strings if t.within or t.path not in known.dropped]
    if markup:
        strings = [(k, t) for k, t in strings if not t.named]
        if any(t.depth and not t.outside and not t.named for t in tokens):
            strings = [(k, t) for k, t in strings if t.depth]
    if known.classes and strings:
        fixed = template(tokens, known.classes)
        # In the article a string must be on most pages to be no line that some articles share.
        fixed -= {k for k, t in strings if (t.within or t.depth) and t.hash in known.unsure}
        size = lambda found: sum(len(t.text) for _, t in found)
        if 2 * size([x for x in strings if x[0] in fixed and x[1].hash in known.unsure]) > size(strings):
            fixed = {k for k in fixed if tokens[k].hash not in known.unsure}
        strings = [x for x in strings if x[0] not in fixed] or strings
    return "\n\n".join(t.text for _, t in strings)


def named(pages: DataFrame) -> DataFrame:
    """pages with their host as _tm_host, lower-cased; empty where the url is null or has none."""
    url = F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return pages.withColumn("_tm_host", F.lower(url))


SEEN = ["host", "token", "pages", "total", "vector", "path", "parent", "mass", "string", "main"]


def occurrences(pages: DataFrame) -> DataFrame:
    """Of each token of a host: its occurrence vector (pages, total and a hash of both by page), its path and that path's parent, and:

    mass: for an element, the characters of the strings in it that the markup doesn't leave out; string: whether
    it is a string; main: whether it is one in the article by the markup. pages: placed.
    """

    def run(batches):
        import pyarrow as pa

        for t in batched(batches, 8_000_000):
            held: dict[tuple[str, int], list[int]] = {}
            for host, source in zip(t.column("_tm_host").to_pylist(), t.column("html").to_pylist(), strict=True):
                own: dict[int, list[int]] = {}
                above: dict[int, int] = {}
                for x in Page(source).tokens:
                    n = own.get(x.hash)
                    if n is None:
                        n = own[x.hash] = [0, x.path, x.parent, 0, int(x.text is not None), 0]
                    n[0] += 1
                    if x.text is None:
                        above.setdefault(x.path, x.parent)
                    elif not x.outside and not x.named:
                        n[5] = 1
                        at = x.path
                        while at and at in own:
                            own[at][3] += len(x.text)
                            at = above[at]
                if own:
                    own[0] = [1, 0, 0, 0, 0, 0]  # token 0 counts the host's pages that have any
                page, by_count = mark(source), {}
                for h, (n, *facts) in own.items():
                    if n not in by_count:
                        by_count[n] = mark(page, n)
                    x = held.get((host, h))
                    if x is None:
                        x = held[host, h] = [0, 0, 0, *facts[:2], 0, facts[3], 0]
                    x[0] += 1
                    x[1] += n
                    x[2] = (x[2] + by_count[n]) % (1 << 62)
                    x[5] += facts[2]
                    x[7] |= facts[4]
            keys, values = list(held), list(held.values())
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), *[pa.array([x[i] for x in values], pa.int64()) for i in range(8)]], SEEN)

    digest = F.unhex(F.sha2("html", 256)).alias("digest")
    one = pages.where("html is not null").groupBy("_tm_host", digest).agg(F.min(F.struct("_tm_file", "_tm_row")).alias("at")).select("at.*", F.lit(1).alias("n"))
    once = with_numbers(pages, one, "_tm_one").where("_tm_one = 1").select("_tm_host", "html")
    counted = once.mapInArrow(run, "host string, " + ", ".join(f"{c} long" for c in SEEN[1:]))
    vector = F.pmod(F.sum(F.col("vector").cast("decimal(38,0)")), F.lit(1 << 62).cast("decimal(38,0)")).cast("long")
    first = [F.min(c).alias(c) for c in ("path", "parent")]
    return counted.groupBy("host", "token").agg(F.sum("pages").alias("pages"), F.sum("total").alias("total"), vector.alias("vector"), *first, F.sum("mass").alias("mass"), F.max("string").alias("string"), F.max("main").alias("main"))


def article_element(elements: list[dict], pages: int) -> int | None:
    """From the root inwards the part that comes once a page, on half of the pages at least, and holds half of the text of the one around it."""
    inside: dict[int, list[dict]] = {}
    for e in elements:
        if e["total"] == e["pages"] and 2 * e["pages"] >= pages:
            inside.setdefault(e["parent"], []).append(e)
    at, mass, depth = 0, sum(e["mass"] for e in inside.get(0, [])), 0
    while True:
        best = max(inside.get(at, []), key=lambda e: (e["mass"], -e["path"]), default=None)
        if best is None or not best["mass"] or 2 * best["mass"] < mass:
            return at if depth > 2 else None  # not the root and the body
        at, mass, depth = best["path"], best["mass"], depth + 1


def templates(pages: DataFrame) -> DataFrame:
    """One row per host that has a template: host, tokens, classes, unsure, article, dropped (see Template). pages: placed, with their host."""
    seen = saved(occurrences(pages), "occurrences")
    size = seen.where("token = 0").select(F.col("host").alias("_tm_host"), F.col("pages").alias("_tm_pages"))
    own = seen.where("token != 0 and pages >= 2").join(size, seen["host"] == size["_tm_host"]).where(F.col("pages") >= SHARE * F.col("_tm_pages"))
    unsure = (F.col("pages") < SURE_PAGES) | (2 * F.col("pages") < F.col("_tm_pages"))
    # Tokens on a share of the pages are at most as many as an average page has, over the share.
    fact = F.struct("token", F.xxhash64("pages", "total", "vector").alias("class"), unsure.alias("unsure"), "pages", "total", "path", "parent", "mass", "string", "main")
    grouped = own.groupBy("host", "_tm_pages").agg(F.collect_list(fact).alias("t"))
    # Of every slot, by the path of the element that holds its strings: how many there are, and how many come on other pages too.
    again = F.when(F.col("pages") >= 2, F.col("pages")).otherwise(0)
    slots = seen.where("string = 1").groupBy("host", "path").agg(F.sum("pages").alias("n"), F.sum(again).alias("again"))
    on = own.where("string = 0").select(F.col("host").alias("_tm_h"), F.col("path").alias("_tm_p")).distinct()
    slots = slots.join(on, (F.col("host") == F.col("_tm_h")) & (F.col("path") == F.col("_tm_p"))).groupBy(F.col("host").alias("_tm_h")).agg(F.collect_list(F.struct("path", "n", "again")).alias("slots"))
    both = grouped.join(slots, F.col("host") == F.col("_tm_h"), "left").select("host", F.col("_tm_pages").alias("pages"), "t", "slots")

    def run(batches):
        import pyarrow as pa

        longs = pa.list_(pa.int64())
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                elements = [t for t in row["t"] if not t["string"] and t["token"] == t["path"]]
                article = article_element(elements, row["pages"])
                above = {e["path"]: e["parent"] for e in elements}

                def within(path: int, article=article, above=above) -> bool:
                    for _ in range(DEPTH + 1):
                        if not path or path == article:
                            return path == article and article is not None
                        path = above.get(path, 0)
                    return False

                dropped = []
                slots = row["slots"] or []
                if article is not None:
                    inner = [s for s in slots if within(s["path"])]
                    usual = sum(s["again"] for s in inner) / max(1, sum(s["n"] for s in inner))
                    least = max(AGAIN, usual + CLEARLY)
                    dropped = [s["path"] for s in slots if not within(s["path"]) and s["again"] >= least * s["n"]]
                # Only strings are dropped, so a template without one in an article changes nothing.
                told = [t for t in row["t"]] if any(t["main"] for t in row["t"]) else []
                if told or article is not None:
                    out.append((row["host"], [t["token"] for t in told], [t["class"] for t in told], [t["unsure"] for t in told], article, dropped))
            kinds = [pa.string(), longs, longs, pa.list_(pa.bool_()), pa.int64(), longs]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], ["host", "tokens", "classes", "unsure", "article", "dropped"])

    return saved(both.mapInArrow(run, "host string, tokens array<long>, classes array<long>, unsure array<boolean>, article long, dropped array<long>"), "templates")


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    given = named(placed(pages.select("page_id", "url", "html")))
    known = templates(given)
    small = (known.agg(F.sum(F.size("tokens") + F.size("dropped") + 1)).first()[0] or 0) <= BROADCAST_TOKENS
    wanted = given.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "_tm_host")
    wanted = wanted.join(F.broadcast(known) if small else known, F.col("_tm_host") == known["host"], "left").select("page_id", "url", "html", "host", "tokens", "classes", "unsure", "article", "dropped")

    def run(batches):
        import pyarrow as pa

        last, template_ = None, Template()
        for batch in batches:
            out = []
            hosts = batch.column("host").to_pylist()
            tokens, numbers, doubts, article, dropped, source = (batch.column(c) for c in ("tokens", "classes", "unsure", "article", "dropped", "html"))
            for k, at in enumerate(hosts):
                if at != last:
                    last, template_ = at, Template()
                    if at is not None:
                        own = tokens[k].as_py()
                        template_ = Template(dict(zip(own, numbers[k].as_py(), strict=True)), [h for h, x in zip(own, doubts[k].as_py(), strict=True) if x], article[k].as_py(), dropped[k].as_py())
                out.append(main_text(source[k].as_py(), template_))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return wanted.mapInArrow(run, "page_id long, url string, text string, n_chars long")
