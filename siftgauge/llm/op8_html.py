"""Main text of web pages by deduction of each host's template.

1. A page becomes tokens: tags (name, class, id and role), end tags and whole text nodes.  A token's role is told apart by
   its place: the tags around it are part of what it is known by.
2. Per host, a token's occurrence vector says how often each page has it.  Vectors are compared by two sums over the
   pages of page number * count, which aggregate partially, so that no host is ever in one task.  Tokens with equal
   vectors that at least half of the host's pages have, at least two pages and two tokens, form an equivalence class.
3. A class is valid if on every page its tokens come in one order, once in each repetition.  Two valid classes nest if on
   every page the one stands in the same gap between two tokens of the other.  Where classes do neither, roles are told
   apart by position: if all tokens of the classes that cross come in one order on the pages, the n-th time of a token
   is a role of its own, and they are one class.  Of classes that still cross, the smaller goes.
   What is left, each class below the gap of the innermost class around it, is the host's template.
4. The gaps of the template are slots, and what no class has stands in them.  A page's text is what its slots hold
   there, less the slots that their tags show to be menus, headers, footers, sidebars, notices, adverts, forms, scripts,
   styles or reader comments (a list of tags and of words in class, id and role), and less slots that a repeated class
   puts into links.  Where slots lie inside an article or main element these alone are the text, whole: a passage
   that pages of a host share there is no template text.  A host with one page has one slot, the page.

Blocks end at block-level tags; references are decoded; white space in a block becomes one space; empty blocks go.
Defined results: null or empty html gives an empty text; unclosed elements end with their parent; a tag that never ends
is text; a quote without its pair is no quote; a page without url belongs to the host ""; repeated rows are extracted
each, and count as pages of their own; an empty table gives an empty result; further columns do not matter.  Work
grows in proportion to the length of a page.
"""

from __future__ import annotations

import html
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Tables

#: Template tokens up to which all hosts' templates are broadcast (some 100 bytes each); beyond it pages meet them by a join.
MOST_BROADCAST = 200_000
_START = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_EDGE = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
_RAW_END = {name: re.compile(rf"</{name}(?![a-zA-Z0-9-])", re.I) for name in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set("address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_DROPPED = {"nav", "header", "footer", "aside", "form", "menu", "button", "select", "dialog", "head", "svg", "canvas", "object", "audio", "video", "math"} | _RAW
_ROLE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adslot|adbox|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|sidebar|side|menu|nav\w*|breadcrumbs?|comments?|commentlist|replies|respond|disqus|footer|foot|header|masthead|share\w*|sharing|social|related|recommended|subscribe|newsletter|signup|login|search\w*|widget\w*|pagination|pager|complementary|contentinfo|navigation)(?:$|[\s_-]|\d)", re.I)
#: End tags that a new tag of the set implies.
_IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, what): ("open", tag, class/id/role), ("close", tag, ""), ("text", "", raw text)."""
    at, quoted = 0, True
    while m := _START.search(page, at):
        comment, slash, name = m.groups()
        if comment:
            end = page.find("-->", m.end())
            end = len(page) if end < 0 else end + 3
        else:
            end = m.end()
            while quoted and name:
                edge = _EDGE.search(page, end)
                if edge and edge[0] == ">":
                    end = edge.start()
                    break
                end = page.find(edge[0], edge.end()) + 1 if edge else 0
                if not end:  # Quotes without end: from here on none counts.
                    quoted, end = False, m.end()
            end = page.find(">", end) + 1
            if not end:
                break
        if m.start() > at:
            yield "text", "", page[at : m.start()]
        at = end
        if not name:
            continue
        name = name.lower()
        if slash:
            yield "close", name, ""
            continue
        rest = page[m.end() : end - 1]
        yield "open", name, " ".join(a or b or c for _, a, b, c in _ATTRIBUTE.findall(rest)) if rest else ""
        if name in _RAW and not rest.endswith("/"):
            close = _RAW_END[name].search(page, at)
            at = (page.find(">", close.end()) + 1 if close else 0) or len(page)
            yield "close", name, ""
    if at < len(page):
        yield "text", "", page[at:]


def _drops(name: str, what: str, in_article: bool) -> bool:
    if name == "header":
        return not in_article
    return name in _DROPPED or bool(what and name not in ("html", "body", "article", "main") and _ROLE.search(what))


@dataclass(slots=True)
class Event:
    """A token in its place: `path` names the elements around it, the flags say what they are."""

    kind: str
    name: str
    what: str
    path: int
    dropped: bool
    inside: bool
    linked: bool

    def key(self) -> int | None:
        what = " ".join(self.what.split()) if self.kind == "text" else self.what
        if self.kind == "text" and not what:
            return None
        return xxhash.xxh3_64_intdigest(f"{self.path} {self.kind} {self.name}\0{what}") - (1 << 63)


def events(page: str) -> list[Event]:
    """All tokens of a page but end tags that end nothing."""
    stack: list[tuple[str, int, bool, bool, bool]] = []  # tag, path, dropped, inside the article, inside a link
    open_, out = Counter(), []
    top = ("", 0, False, False, False)
    for kind, name, what in tokens(page):
        if kind == "close":
            if not open_[name]:
                if name in _BLOCK:
                    out.append(Event("gap", name, "", 0, *top[2:]))
                continue
            while True:
                ended = stack.pop()
                open_[ended[0]] -= 1
                if ended[0] == name:
                    break
            top = stack[-1] if stack else ("", 0, False, False, False)
        elif kind == "open" and name in _IMPLIED and stack and top[0] in _IMPLIED[name]:
            open_[stack.pop()[0]] -= 1
            top = stack[-1] if stack else ("", 0, False, False, False)
        out.append(Event(kind, name, what, *top[1:]))
        if kind == "open" and name not in _VOID:
            path = xxhash.xxh3_64_intdigest(f"{top[1]} {name}\0{what}")
            top = (name, path, top[2] or _drops(name, what, top[3]), top[3] or name in ("article", "main"), top[4] or name == "a")
            stack.append(top)
            open_[name] += 1
    return out


def repetitions(found: list[int]) -> list[int] | None:
    """The order in which a class's tokens come, if all its repetitions on the page are in it."""
    order = list(dict.fromkeys(found))
    return order if len(found) % len(order) == 0 and found == order * (len(found) // len(order)) else None


def gap_of(inner: list[int], size: int, outer: list[int], outer_size: int) -> int:
    """The gap of `outer` (places of a class of `outer_size` tokens) that has all of `inner`; 0: outside of it, -1: none."""
    gaps = set()
    for k in range(0, len(inner), size):
        a, b = bisect(outer, inner[k]), bisect(outer, inner[k + size - 1])
        if a != b:
            return -1
        gaps.add(a % outer_size)
    return gaps.pop() if len(gaps) == 1 else -1


def crossing(gaps: dict[tuple[int, int], int]) -> list[list[int]]:
    """Groups of classes of a page that cross, directly or by others of the group."""
    group: dict[int, list[int]] = {}
    for (a, b), g in gaps.items():
        if a < b and g < 0 and gaps[b, a] < 0 and (x := group.setdefault(a, [a])) is not (y := group.setdefault(b, [b])):
            x += y
            for c in y:
                group[c] = x
    return [sorted(x) for c, x in group.items() if c == min(x)]


def nest(classes: dict[int, list[int]], gaps: dict[tuple[int, int], int]) -> list[tuple[int, int, int, int, int, int]]:
    """(token, class, place in it, its size, parent class, gap) of the largest set of classes that nest.

    `gaps`[inner, outer] is the gap that all pages agree on, or -1; classes that share no page are not in it.  Classes
    made of others have their tokens, so they are not taken with them.
    """
    valid: list[int] = []
    taken: set[int] = set()
    fits = lambda a, b: (a, b) not in gaps or gaps[a, b] >= 0 or gaps[b, a] >= 0
    for c in sorted(classes, key=lambda c: (-len(classes[c]), c)):
        if taken.isdisjoint(classes[c]) and all(fits(c, v) for v in valid):
            valid.append(c)
            taken.update(classes[c])
    around = {c: [v for v in valid if v != c and gaps.get((c, v), 0) > 0] for c in valid}
    out = []
    for c in valid:
        parent = max(around[c], key=lambda v: (len(around[v]), -v), default=0)
        out += [(t, c, k, len(classes[c]), parent, gaps.get((c, parent), 0)) for k, t in enumerate(classes[c])]
    return out


def extract(page: str, template: dict[int, tuple[int, list[int], int, int, int]]) -> str:
    """The text of a page; `template`: token -> (class, places in it, size of the class, parent class, gap of the parent)."""
    parsed = events(page)
    has_main = any(e.inside for e in parsed) or any(e.kind == "open" and e.name in ("article", "main") for e in parsed)
    keys = [e.key() for e in parsed] if template else [None] * len(parsed)
    fixed: list[tuple[int, int, int] | None] = []
    times: Counter[int] = Counter()
    for k in keys:
        t = template.get(k)
        fixed.append(t and (t[0], t[1][times[k] % len(t[1])], t[2]))
        times[k] += 1
    found: dict[int, list[int]] = {}
    for k, t in zip(keys, fixed, strict=True):
        if t:
            found.setdefault(t[0], []).append(t[1])
    # On this page a class counts if its tokens come as the template has them; it repeats if they do so more than once.
    size = {t[0]: t[2] for t in fixed if t}
    right = {c for c, places in found.items() if places == list(range(size[c])) * (len(places) // size[c])}
    repeats = {c for c in right if len(found[c]) > size[c]}
    slots: list[int] = []  # classes around the place, each in one of its gaps
    blocks, block = [], []

    def close_block() -> None:
        words = html.unescape("".join(block)).split()
        if words:
            blocks.append(" ".join(words))
        block.clear()

    for e, t in zip(parsed, fixed, strict=True):
        of_template = t is not None and t[0] in right
        if of_template:
            if t[1] == 0 and t[2] > 1:
                slots.append(t[0])
            elif t[1] == t[2] - 1 and t[0] in slots:
                del slots[slots.index(t[0]) :]
        if e.kind == "text":
            if e.dropped:
                continue
            menu = e.linked and any(c in repeats for c in slots)
            if e.inside if has_main else not of_template and not menu:
                block.append(e.what)
        elif e.name in _BLOCK:
            close_block()
        elif e.name == "br":
            block.append(" ")
    close_block()
    return "\n".join(blocks)


def _with_template(pages: DataFrame, found: DataFrame, column: str) -> DataFrame:
    small = found.agg(F.coalesce(F.sum(F.size(column)), F.lit(0))).first()[0] <= MOST_BROADCAST
    return pages.join(F.broadcast(found) if small else found, "h", "left")


class _Held:
    """What is known of the hosts of this task, made once from each host's column."""

    def __init__(self, make) -> None:
        self.make, self.by_host = make, {}

    def of(self, host: int, value: pa.Scalar):
        if host not in self.by_host:
            if len(self.by_host) > 1000:
                self.by_host.clear()
            self.by_host[host] = self.make(value.as_py() or [])
        return self.by_host[host]


def classes_of(pages: DataFrame, tables: Tables) -> DataFrame:
    """(h, tokens): per host the tokens of its equivalence classes as structs of token and class."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for host, mark, page in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                x, y = mark & 0xFFFFFF, (mark >> 24) & 0xFFFFFF
                for key, n in Counter(k for e in events(page or "") if e.kind != "gap" and (k := e.key()) is not None).items():
                    for column, value in zip(out, (host, key, x * n, y * n, n), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["h", "token", "x", "y", "n"])

    seen = pages.select("h", "mark", "html").mapInArrow(vectors, "h long, token long, x long, y long, n long")
    totals = seen.groupBy("h", "token").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("pages")).where("pages > 1")
    sizes = pages.groupBy("h").agg(F.count(F.lit(1)).alias("size"))
    common = totals.join(sizes, "h").where("2 * pages >= size").select("h", "token", F.xxhash64("x", "y", "n", "pages").alias("class"))
    large = common.groupBy("h", "class").agg(F.collect_list("token").alias("of")).where(F.size("of") > 1)
    return tables.write(large.groupBy("h").agg(F.flatten(F.collect_list(F.expr("transform(of, t -> struct(t AS token, class))"))).alias("tokens")))


def templates(pages: DataFrame, tables: Tables) -> DataFrame:
    """(h, template): per host its nested classes, as structs of what `extract` needs."""
    found = classes_of(pages, tables)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Orders and gaps that the pages of a batch agree on; a class's own row has its order."""
        held = _Held(lambda tokens: {t["token"]: t["class"] for t in tokens})
        for batch in batches:
            orders: dict[tuple, tuple] = {}
            gaps: dict[tuple, list[int]] = {}
            mixed: dict[tuple, set] = {}
            for host, page, of in zip(batch.column("h").to_pylist(), batch.column("html").to_pylist(), batch.column("tokens"), strict=True):
                known = held.of(host, of)
                places: dict[int, list[int]] = {}
                seen: dict[int, list[int]] = {}
                for k, e in enumerate(events(page or "")):
                    key = e.key() if e.kind != "gap" else None
                    if key in known:
                        places.setdefault(known[key], []).append(k)
                        seen.setdefault(known[key], []).append(key)
                sound = {}
                for c, keys in seen.items():
                    order = repetitions(keys)
                    orders[host, c, tuple(order or ())] = (host, c)
                    if order:
                        sound[c] = len(order)
                here = {(a, b): gap_of(places[a], size, places[b], outer) for a, size in sound.items() for b, outer in sound.items() if a != b}
                made = []
                for group in crossing(here):
                    both = sorted((k, key) for c in group for k, key in zip(places[c], seen[c], strict=True))
                    c = xxhash.xxh3_64_intdigest(repr(group)) - (1 << 63)
                    order = tuple(key for _, key in both)
                    # Two orders show that pages do not agree.
                    if len(kinds := mixed.setdefault((host, c), set())) < 2 and order not in kinds:
                        kinds.add(order)
                        orders[host, c, order] = (host, c)
                    places[c], sound[c] = [k for k, _ in both], len(both)
                    made.append((c, group))
                for c, group in made:
                    for b in sound.keys() - set(group) - {c}:
                        here[c, b], here[b, c] = gap_of(places[c], sound[c], places[b], sound[b]), gap_of(places[b], sound[b], places[c], sound[c])
                for (a, b), g in here.items():
                    both = gaps.setdefault((host, a, b), [g, g])
                    both[0], both[1] = min(both[0], g), max(both[1], g)
            rows = [(h, c, c, 0, 0, list(order)) for h, c, order in orders] + [(h, a, b, *g, []) for (h, a, b), g in gaps.items()]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (*[pa.int64()] * 3, pa.int32(), pa.int32(), pa.list_(pa.int64())), strict=True)], ["h", "a", "b", "low", "high", "tokens"])

    checked = _with_template(pages.select("h", "html"), found, "tokens").where("tokens IS NOT NULL").mapInArrow(check, "h long, a long, b long, low int, high int, tokens array<bigint>")
    agreed = checked.groupBy("h", "a", "b").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("tokens").alias("first"), F.max("tokens").alias("last"))
    agreed = agreed.select("h", F.struct("a", "b", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(-1).alias("gap"), F.when((F.col("a") == F.col("b")) & (F.col("first") == F.col("last")), F.col("first")).alias("order")).alias("x"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for relations in batch.column("of").to_pylist():
                classes = {x["a"]: x["order"] for x in relations if x["a"] == x["b"] and x["order"]}
                rows.append([dict(zip(("token", "class", "place", "size", "parent", "gap"), t, strict=True)) for t in nest(classes, {(x["a"], x["b"]): x["gap"] for x in relations if x["a"] in classes and x["b"] in classes and x["a"] != x["b"]})])
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(rows, pa.list_(pa.struct([(c, pa.int64()) for c in ("token", "class", "place", "size", "parent", "gap")])))], ["h", "template"])

    by_host = agreed.groupBy("h").agg(F.collect_list("x").alias("of"))
    out = tables.write(by_host.mapInArrow(build, "h long, template array<struct<token: bigint, class: bigint, place: bigint, size: bigint, parent: bigint, gap: bigint>>"))
    tables.drop(found)
    return out


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of (page_id, url, html)."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.xxhash64(host).alias("h"), F.xxhash64("page_id", "url").alias("mark"))
    found = templates(rows, Tables(pages.sparkSession, "templates"))
    joined = _with_template(rows.drop("mark"), found, "template").select("page_id", "url", "html", "h", "template")

    def by_token(template: list[dict]) -> dict[int, tuple]:
        out: dict[int, tuple] = {}
        for t in template:
            out.setdefault(t["token"], (t["class"], [], t["size"], t["parent"], t["gap"]))[1].append(t["place"])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(by_token)
        for batch in batches:
            texts = [extract(page or "", held.of(h, template)) for page, h, template in zip(batch.column("html").to_pylist(), batch.column("h").to_pylist(), batch.column("template"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
