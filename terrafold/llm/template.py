"""Main text of web pages by deduced templates.

Tokens. A page is read as tags, each named by the path of its enclosing elements and by whether it is marked
as boilerplate, and as blocks of text, each named by its element's path and its content.

Equivalence classes. Tokens of one host whose occurrence vectors (how often on each page)
agree form a class. The vectors are never built: each page adds a hash of (page, count) to its
tokens' two 32-bit sums, the sums are added by (host, token) over all pages map-side and then
in one exchange, and equal sums mean equal vectors. A host with a third of all pages is
one row for each token and task.

Template. The class of the tokens that are once on every page is the root. Every other class is nested in that of
its tokens' enclosing element; tokens of equal vectors in elements of different classes are classes of their own, so all
classes are valid. A class whose enclosing element has its own vector, with one tag in each of these elements, is a part of the class
around it. A class that is more than once on a page is a list of records: those of its tags that are equally often in each
element and never twice in a row there, and the parts inside them, are one record, and what holds for its text as a whole
holds for all of them. Any other tag stands for itself. A tag most of whose text is in links is a menu, and so is a record if that
holds for the text of its tags and for all text inside it. An article or main tag of such a list is no slot, but an entry, if most of all
text in it is in links. The slots are the other article and main tags; the places are all tags that have text and are in no
menu. A text block of the root class is template text, unless the host's pages have less than half as many other
blocks: pages that are (near) copies of each other keep their text.

Extraction. Text in elements comes out of slots, entries and places only, so without classes there is none. What is inside slots is the
article, with the entries unless the page has an article (or a main that holds no article) with text outside them. A page with no
slot gives its places, without template text, and its entries; if that is nothing, its menus and template text too. Menus, headers,
footers, asides, forms, scripts, adverts, notices and reader comments are boilerplate by element, role, class or id, wherever they stand, and are no slots; nothing else is
dropped. A class, id or role marks boilerplate if all words of one of its names do ("cookie-notice", not
"has-sidebar"), but never html, body, main, an article or what encloses one. Only lists of
comments or related articles are marked though articles are in them, if another stands outside.

A null or empty page, or one without such text, gives the empty text. A null or odd url makes
the host ''. Repeated pages are separate rows with equal texts. Time and memory grow in proportion to a page's length,
however deep its elements nest.
"""

from __future__ import annotations

import functools
import html as html_module
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import free, salted_join, settled, slices, texts_of

#: Share of a slot's text in links from which it is a menu.
LINKS = 0.6
#: Bytes of all templates up to which they are sent to every task.
TEMPLATE_BYTES = 16 << 20

# Element names
BREAKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template svg math object canvas".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog select button fieldset head search".split())
CONTENT = frozenset(("article", "main"))
# Words of class, id and role attributes that mark boilerplate
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies disqus footer gdpr header "
    "login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo related search share sharing sidebar signup social sponsor "
    "sponsored subscribe toolbar widget".split()
)
# Those of them that may mark a list of articles
LISTS = frozenset("comment comments related".split())
# Elements that class, id and role never mark
UNMARKED = frozenset("html body main article".split())
# A closing tag of the first closes open elements of the second at an opening tag
CLOSES = {"li": "li", "dt": "dd", "dd": "dt", "tr": "tr", "td": "td", "th": "th", "option": "option"}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)", re.S
)
_ATTRS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[^\W\d_]+")


@functools.lru_cache(100_000)
def _marked(attrs: str) -> int:
    """2 if a name of class, id or role marks a list of articles, 1 if one marks other boilerplate, else 0."""
    names = [set(_WORD.findall(x)) for _, a, b, c in _ATTRS.findall(attrs) for x in (a or b or c).lower().split()]
    return max((2 if x <= LISTS else int(x <= MARKS) for x in names if x), default=0)


def _digest(key: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"), 0) & ((1 << 63) - 1)


@functools.lru_cache(100_000)
def _path(above: int, name: str) -> int:
    """The token of an element named so inside the path ``above`` (0: none)."""
    return _digest(f"{above:x}/{name}") | 1


def _mixed(a: int, b: int) -> int:
    x = (a + 2) * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF
    return (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF


class Page:
    """The elements of a page in order, and its text blocks."""

    def __init__(self, source: str):
        #: For each element: its parent (-1 for none), name, boilerplate or not, token (path)
        self.above: list[int] = []
        self.names: list[str] = []
        self.bad: list[bool] = []
        self.paths: list[int] = []
        #: For each element: 1 if an article is inside it, 2 if a main is, 3 if both
        self.holds: list[int] = []
        #: For each block: its element (-1 for none), text, characters of it in links
        self.blocks: list[tuple[int, str, int]] = []
        self._own: list[bool] = []  # boilerplate by element
        self._marks: list[int] = []
        self._stack: list[tuple[str, int]] = []
        self._open_names: Counter = Counter()
        self._parts: list[str] = []
        self._links = self._linked = 0
        at = 0
        while (m := _TAG.search(source, at)) is not None:
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                continue
            name = name.lower()
            if m[1] or m[4]:
                self._close(name)
                continue
            attrs = m[3] if m[2] else m[6]
            if name in RAW:
                if not attrs.rstrip().endswith("/"):
                    end = re.compile(rf"</{name}\s*>", re.I).search(source, at)
                    at = end.end() if end else len(source)
                self._parts.append(" ")
            elif name in BREAKS:
                self._open(name, attrs)
            elif name == "br":
                self._parts.append(" ")
            elif name == "a":
                self._links = 1
        if at < len(source):
            self._text(source[at:])
        self._flush()
        self._settle()

    def _text(self, raw: str) -> None:
        self._parts.append(raw)
        if self._links:
            self._linked += len(raw.strip())

    def _flush(self) -> None:
        if self._parts:
            text = " ".join(html_module.unescape("".join(self._parts)).split())
            self._parts = []
            if text:
                self.blocks.append((self._stack[-1][1] if self._stack else -1, text, min(self._linked, len(text))))
        self._linked = 0

    def _pop(self, at: int) -> None:
        for name, _ in self._stack[at:]:
            self._open_names[name] -= 1
        del self._stack[at:]

    def _open(self, name: str, attrs: str) -> None:
        self._flush()
        if self._stack and self._stack[-1][0] == "p":
            self._pop(-1)
        for old in (CLOSES.get(name), name if name in CLOSES else None):
            if old and self._stack and self._stack[-1][0] == old:
                self._pop(-1)
        self._own.append(name in BOILERPLATE and not (name == "header" and any(self._open_names[x] for x in CONTENT)))
        self._marks.append(_marked(attrs) if attrs and name not in UNMARKED else 0)
        self.above.append(self._stack[-1][1] if self._stack else -1)
        self.names.append(name)
        if name not in VOID:
            self._stack.append((name, len(self.names) - 1))
            self._open_names[name] += 1

    def _close(self, name: str) -> None:
        if name == "a":
            self._links = 0
        if name not in BREAKS:
            return
        self._flush()
        if self._open_names[name]:
            at = len(self._stack) - 1
            while self._stack[at][0] != name:
                at -= 1
            self._pop(at)

    def _settle(self) -> None:
        """Verdicts, which depend on the articles inside an element, and paths, which have the verdicts in them."""
        n = len(self.names)
        holds = self.holds = [0] * n
        for i in range(n - 1, -1, -1):
            if self.above[i] >= 0:
                holds[self.above[i]] |= holds[i] | {"article": 1, "main": 2}.get(self.names[i], 0)
        lists = [mark == 2 and holds[i] == 1 for i, mark in enumerate(self._marks)]
        if any(lists):
            # Does an article stand outside lists and boilerplate elements?
            out: list[bool] = []
            for i, above in enumerate(self.above):
                out.append((above < 0 or out[above]) and not self._own[i] and not lists[i])
            if not any(out[i] and not holds[i] and name in CONTENT for i, name in enumerate(self.names)):
                # As what the list is in may be the article, nothing is taken from it.
                lists = [False] * n
        for i, (above, name) in enumerate(zip(self.above, self.names)):
            over = above >= 0 and self.bad[above]
            bad = over or self._own[i] or (self._marks[i] > 0 and (not holds[i] or lists[i]))
            self.paths.append(_path(self.paths[above] if above >= 0 else 0, f"{name}!" if bad and not over else name))
            self.bad.append(bad)

    def good(self) -> Iterator[tuple[int, int, str, int]]:
        """(element, its path, text, linked characters) of the blocks that aren't boilerplate."""
        for i, text, linked in self.blocks:
            if i < 0 or not self.bad[i]:
                yield i, self.paths[i] if i >= 0 else 0, text, linked


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", url or "")
    return m[1].rpartition("@")[2].lower() if m else ""


def block_token(path: int, text: str) -> int:
    return _digest(f"{path:x}\n{text}")


def page_tokens(page: Page) -> list[tuple[int, ...]]:
    """(token, parent, kind, times, characters, linked characters, turns, elements, characters and linked ones of all text inside,
    spread); kind: 0 the page itself, 1 a tag, 2 an article or main tag, 3 a text block. Characters are those of the blocks right in a
    tag, turns the times that it doesn't follow a tag of the same token in its element, elements those that it is in; spread
    stands for its times in each of them."""
    out = [(0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0)]
    parents = {p: page.paths[a] if a >= 0 else 0 for p, a in zip(page.paths, page.above)}
    kinds = {p: 2 if name in CONTENT and not bad else 1 for p, name, bad in zip(page.paths, page.names, page.bad)}
    chars, linked, texts, turns = Counter(), Counter(), Counter(), Counter()
    n = len(page.paths)
    inner, inner_linked = [0] * (n + 1), [0] * (n + 1)  # the last for blocks in no element
    for i, path, text, in_links in page.good():
        chars[path] += len(text)
        linked[path] += in_links
        texts[block_token(path, text), path] += 1
        inner[i] += len(text)
        inner_linked[i] += in_links
    inside, inside_linked = Counter(), Counter()
    for i in range(n - 1, -1, -1):
        inner[page.above[i]] += inner[i]
        inner_linked[page.above[i]] += inner_linked[i]
        inside[page.paths[i]] += inner[i]
        inside_linked[page.paths[i]] += inner_linked[i]
    last: dict[int, int] = {}
    for path, above in zip(page.paths, page.above):
        turns[path] += last.get(above) != path
        last[above] = path
    elements, spread = Counter(), Counter()
    for (path, above), n in Counter(zip(page.paths, page.above)).items():
        elements[path] += 1
        spread[path] += _mixed(above, n)
    out += [(p, parents[p], kinds[p], n, chars[p], linked[p], turns[p], elements[p], inside[p], inside_linked[p], spread[p]) for p, n in Counter(page.paths).items()]
    return out + [(t, path, 3, n, 0, 0, 0, 0, 0, 0, 0) for (t, path), n in texts.items()]


_FIELDS = ("parent", "kind", "pages", "times", "chars", "linked", "turns", "elements", "inner", "inner_linked", "spread", "v1", "v2")
_TOKENS = "host string, token long, parent long, kind int, " + ", ".join(f"{c} long" for c in _FIELDS[2:])


def tokens(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """(host, token) sums over all pages; v1 and v2 stand for the occurrence vector, spread for that of its elements."""
    source = pages.select(F.col(key).cast("string").alias("k"), F.col(url).alias("u"), F.col(html).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                total: dict[tuple[str, int], list[int]] = {}
                for k, u, h in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts_of(part, 2).to_pylist()):
                    host = host_of(u)
                    for token, parent, kind, n, *sums, spread in page_tokens(Page(h)):
                        w = _digest(f"{k} {spread}") & 0xFFFFFFFF if spread else 0
                        x = _digest(f"{k} {n}")
                        row = total.setdefault((host, token), [parent, kind, *[0] * (len(_FIELDS) - 2)])
                        for j, value in enumerate((1, n, *sums, w, x & 0xFFFFFFFF, x >> 32), 2):
                            row[j] += value
                rows = list(total.items())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.int64())]
                    + [pa.array([v[j] for _, v in rows], pa.int32() if j == 1 else pa.int64()) for j in range(len(_FIELDS))],
                    ["host", "token", *_FIELDS],
                )

    got = source.mapInArrow(run, _TOKENS)
    return got.groupBy("host", "token").agg(F.min("parent").alias("parent"), F.min("kind").alias("kind"), *[F.sum(c).alias(c) for c in _FIELDS[2:]])


#: What a class says of each of its tags
_MEMBER = ("token", "parent", "kind", "times", "turns", "spread", "chars", "linked", "inner", "inner_linked", "nested")
#: What the template has of a host
SLOTS, ENTRIES, PLACES, MENUS, FIXED = range(5)


def classes(table: DataFrame) -> DataFrame:
    """(host, v1, v2, p1, p2, tokens, root, listed, members): the classes of tags, by their vector and that of the enclosing element.
    ``listed``: more than once on a page; ``nested`` members: one in each enclosing element."""
    tags = table.filter("kind IN (1, 2)").select("host", "v1", "v2", "pages", "elements", *_MEMBER[:-1])
    over = tags.select("host", F.col("token").alias("parent"), F.col("v1").alias("p1"), F.col("v2").alias("p2"))
    page = table.filter("kind = 0").select("host", F.col("v1").alias("r1"), F.col("v2").alias("r2"))
    nested = tags.join(over, ["host", "parent"], "left").join(page, "host")
    root = F.expr("v1 = r1 AND v2 = r2")
    # The tokens that are once on every page are one class, wherever they stand.
    own = nested.withColumn("root", root).withColumns({c: F.when(root, None).otherwise(F.col(c)) for c in ("p1", "p2")})
    own = own.withColumn("nested", F.expr("coalesce(p1 = v1 AND p2 = v2 AND elements = times, false)"))
    listed = F.first(F.expr("times > pages")).alias("listed")
    return own.groupBy("host", "v1", "v2", "p1", "p2").agg(F.sort_array(F.collect_list("token")).alias("tokens"), F.first("root").alias("root"), listed, F.collect_list(F.struct(*_MEMBER)).alias("members"))


def records(members: list[tuple], listed: bool) -> list[list[tuple]]:
    """The tags of one vector by records; those of a class that isn't a list each stand for themselves."""
    if not listed:
        return [[m] for m in members]
    heads: dict[int, tuple[int, int, int]] = {}
    parents: dict[int, int] = {}
    for token, parent, _, times, turns, spread, *_, nested in members:
        if nested:
            parents[token] = parent
        else:
            heads[token] = (parent, spread, 0 if turns == times else token)
    for token in parents:
        chain = [token]
        while chain[-1] not in heads:
            chain.append(parents[chain[-1]])
        for part in chain:
            heads[part] = heads[chain[-1]]
    out: dict[tuple[int, int, int], list[tuple]] = {}
    for m in members:
        out.setdefault(heads[m[0]], []).append(m)
    return list(out.values())


def decided(members: list[tuple], listed: bool) -> Iterator[tuple[int, int]]:
    """(token, SLOTS, ENTRIES, PLACES or MENUS) of the tags of one vector; a tag may have two, or none."""
    for record in records(members, listed):
        chars, linked = (sum(m[j] for m in record) for j in (6, 7))
        menu = chars > 0 and linked >= LINKS * chars
        if len(record) > 1:
            menu &= sum(m[9] for m in record if not m[10]) >= LINKS * sum(m[8] for m in record if not m[10])
        for token, _, kind, _, _, _, own, _, inner, inner_linked, _ in record:
            if kind == 2:
                yield token, ENTRIES if listed and menu and inner_linked >= LINKS * inner else SLOTS
            if own:
                yield token, MENUS if menu else PLACES


def templates(table: DataFrame) -> DataFrame:
    """A row for each host: what its classes make of its tags, and its template text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, members, listed in zip(*(batch.column(j).to_pylist() for j in range(3))):
                rows += [(host, *x) for x in decided([tuple(m[c] for c in _MEMBER) for m in members], listed)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.string(), pa.int64(), pa.int32()))], ["host", "token", "k"])

    vectors = classes(table).groupBy("host", "v1", "v2").agg(F.flatten(F.collect_list("members")).alias("members"), F.first("listed").alias("listed"))
    tags = vectors.select("host", "members", "listed").mapInArrow(run, "host string, token long, k int")
    root = table.filter("kind = 0").select("host", F.col("v1").alias("r1"), F.col("v2").alias("r2"), "pages")
    texts = table.filter("kind = 3").select("host", "token", "times", "v1", "v2").join(root, "host").withColumn("same", F.expr("v1 = r1 AND v2 = r2"))
    few = texts.groupBy("host").agg(F.sum(F.when(F.col("same"), F.col("times"))).alias("s"), F.sum(F.when(~F.col("same"), F.col("times"))).alias("o")).filter("s <= 2 * o").select("host")
    fixed = texts.filter("same").select("host", "token").join(few, "host").select("host", "token", F.lit(FIXED).alias("k"))
    rows = tags.unionByName(fixed).unionByName(root.select("host", F.lit(0).cast("long").alias("token"), F.lit(-1).alias("k")))
    names = ("slots", "entries", "places", "menus", "fixed")
    return rows.groupBy("host").agg(*[F.collect_list(F.when(F.col("k") == k, F.col("token"))).alias(c) for k, c in enumerate(names)])


def main_text(source: str, template: tuple[frozenset, ...] | None) -> str:
    """The text of a page by a template (slots, entries, places, menus, fixed); without a template, none."""
    if template is None:
        return ""
    slots, entries, places, menus, fixed = template
    page = Page(source)
    inside: list[bool] = []
    listed: list[bool] = []
    owned: list[bool] = []  # in an article, or in a main that holds none
    for above, path, name, holds in zip(page.above, page.paths, page.names, page.holds):
        over = above >= 0
        inside.append(path in slots or (over and inside[above]))
        listed.append(path in entries or (over and listed[above]))
        owned.append((path in slots and (name == "article" or not holds & 1)) or (over and owned[above]))
    good = list(page.good())
    if any(inside):
        own = any(i >= 0 and owned[i] and not listed[i] for i, *_ in good)
        found = [b for b in good if b[0] >= 0 and (not own if listed[b[0]] else inside[b[0]])]
    else:
        found = [b for b in good if (b[0] >= 0 and listed[b[0]]) or ((b[0] < 0 or b[1] in places) and not (fixed and block_token(b[1], b[2]) in fixed))]
        found = found or [b for b in good if b[0] < 0 or b[1] in places or b[1] in menus]
    return "\n".join(b[2] for b in found)


def own_template(source: str) -> tuple[frozenset, ...]:
    """The template of a host with this page alone."""
    tags = [r for r in page_tokens(Page(source)) if r[2] in (1, 2)]
    times = {r[0]: r[3] for r in tags}
    vectors: dict[int, list[tuple]] = {}
    for token, parent, kind, n, chars, linked, turns, elements, *inner, spread in tags:
        vectors.setdefault(n, []).append((token, parent, kind, n, turns, spread, chars, linked, *inner, times.get(parent) == n == elements))
    found = [x for n, members in vectors.items() for x in decided(members, n > 1)]
    return tuple(frozenset(t for t, k in found if k == j) for j in (SLOTS, ENTRIES, PLACES, MENUS, FIXED))


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), key: str = "page_id", url: str = "url", html: str = "html", disabled: bool = False) -> DataFrame:
    """``keep``, the main text and its length in code points (``text``, ``n_chars``), for every page.

    ``disabled`` leaves the templates out, which leaves no slots and so no text: for tests of what they decide.
    """
    found = settled(templates(settled(tokens(pages, key, url, html))))
    size = found.agg(F.sum(F.octet_length("host") + 8 * (F.size("slots") + F.size("entries") + F.size("places") + F.size("menus") + F.size("fixed")) + 64)).first()[0] or 0
    if disabled:
        found = found.limit(0)
    names = [free(keep, f"__{x}") for x in ("host", "html", "slots", "entries", "places", "menus", "fixed")]
    host = F.lower(F.regexp_replace(F.regexp_extract(F.coalesce(url, F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), "^.*@", ""))
    source = pages.select(*keep, host.alias(names[0]), F.col(html).alias(names[1]))
    found = found.toDF(names[0], *names[2:])
    joined = source.join(F.broadcast(found), names[0], "left") if size <= TEMPLATE_BYTES else salted_join(source, found, [names[0]], list(keep))
    joined = joined.select(*keep, *names)
    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField("text", T.StringType(), False), T.StructField("n_chars", T.LongType(), False)])
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, n + 1):
                own: dict[str, tuple | None] = {}
                texts = []
                for i, (at, h) in enumerate(zip(part.column(n).to_pylist(), texts_of(part, n + 1).to_pylist())):
                    if at not in own:
                        lists = [part.column(j)[i].as_py() for j in range(n + 2, n + 7)]
                        own[at] = None if lists[0] is None else tuple(map(frozenset, lists))
                    texts.append(main_text(h, own[at]))
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return joined.mapInArrow(run, schema)
