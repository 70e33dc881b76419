"""Template deduction against a plain version, slots with and without an article, hostile pages and defined results."""

import re
import time
from collections import Counter, defaultdict

import pytest

from siftgauge.llm import op8_html as op

STORY = "<h1>Head {k} &amp; more</h1><p>first{k} <b>bold{k}</b> {k}<br>line{k}<p>second&nbsp;{k}"
PAGE = "<html><head><title>t{k}</title><script>var a='</p>{k}'</script></head><body><nav><ul><li><a href=/a>menu {k}</a></li></ul></nav><!-- x --><div class=\"ad\">buy {k}</div><article>" + STORY + "</article><footer>&copy; h {k}</footer></body></html>"
WANT = "Head {k} & more\nfirst{k} bold{k} {k} line{k}\nsecond {k}"


def run(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "c", "d") for r in rows], "page_id long, url string, html string, h int, template string, mark string").repartition(3)
    return op.extract_pages(docs)


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in run(spark, rows).collect()}


@pytest.mark.parametrize("page", [PAGE, PAGE.replace("<article>", "<div>").replace("</article>", "</div>"), PAGE.replace("<article>", "").replace("</article>", "")])
def test_story_with_and_without_an_article_element(spark, page):
    got = texts(spark, [(k, f"http://h/{k}", page.replace("{k}", str(k))) for k in range(6)])
    assert got == {k: WANT.replace("{k}", str(k)) for k in range(6)}


def test_template_without_any_label(spark):
    """Nothing but the template tells menu links and the notice from the story: no listed tag or class name."""
    page = "<div><div><a>Home {j}</a></div><div><a>Shop {j}</a></div></div><div><p>All rights at h</p></div><section><h1>T{k}</h1><p>story {k}</p></section><div>Made by h</div>"
    got = texts(spark, [(k, f"http://h/{k}", page.replace("{k}", str(k)).replace("{j}", str(k % 3))) for k in range(8)])
    assert got == {k: f"T{k}\nstory {k}" for k in range(8)}
    # A lone page has no template: all of it is one slot.
    assert texts(spark, [(1, "http://lone/1", page.replace("{k}", "9"))])[1].startswith("Home")


def test_a_passage_shared_in_articles_stays(spark):
    got = texts(spark, [(k, "http://h/x", f"<article><p>shared</p><p>own {k % 2}</p></article><p>notice</p>") for k in range(6)])
    assert got == {k: f"shared\nown {k % 2}" for k in range(6)}


def plain_classes(pages):
    """Sets of tokens with equal occurrence vectors, of tokens on half of the pages."""
    vectors = defaultdict(dict)
    for k, page in enumerate(pages):
        for key, n in Counter(x for e in op.events(page) if e.kind != "gap" and (x := e.key()) is not None).items():
            vectors[key][k] = n
    classes = defaultdict(set)
    for key, v in vectors.items():
        if len(v) > 1 and 2 * len(v) >= len(pages):
            classes[tuple(sorted(v.items()))].add(key)
    return {frozenset(c) for c in classes.values() if len(c) > 1}


def test_classes_and_nesting_equal_a_plain_version(spark):
    from pyspark.sql import functions as F

    pages = ["<ul>" + "".join(f"<li><a>x{k}{j}</a><i>y{k}{j}</i></li>" for j in range(k % 3 + 1)) + f"</ul><p>{k}</p><em>same</em>" + "<hr>" * (k % 2) for k in range(7)]
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(pages)], "k long, html string").select(F.lit(5).cast("long").alias("h"), F.xxhash64("k").alias("mark"), "html")
    tables = op.Tables(spark, "test")
    found = defaultdict(set)
    for t in op.classes_of(rows, tables).first()["tokens"]:
        found[t["class"]].add(t["token"])
    assert {frozenset(c) for c in found.values()} == plain_classes(pages)
    template = op.templates(rows, tables).first()["template"]
    key = {op_key: e for p in pages for e in op.events(p) if e.kind != "gap" and (op_key := e.key()) is not None}
    order = defaultdict(list)
    for t in sorted(template, key=lambda t: t["place"]):
        order[t["class"]].append((key[t["token"]].kind, key[t["token"]].name))
    item = [("open", "li"), ("open", "a"), ("close", "a"), ("open", "i"), ("close", "i"), ("close", "li")]
    inner = next(c for c, tokens in order.items() if tokens == item)
    outer = next(c for c, tokens in order.items() if tokens[:2] == [("open", "ul"), ("close", "ul")])
    assert {(t["parent"], t["gap"]) for t in template if t["class"] == inner} == {(outer, 1)}


def test_classes_that_cross_do_not_nest():
    assert op.gap_of([1, 2], 2, [0, 3], 2) == 1 and op.gap_of([0, 3], 2, [1, 2], 2) == -1 and op.gap_of([4, 5], 2, [0, 3], 2) == 0
    assert op.gap_of([1, 4], 1, [0, 2, 3, 5], 2) == 1 and op.gap_of([1, 3], 1, [0, 2, 4], 3) == -1
    crossing = op.nest({1: [10, 11, 12], 2: [20, 21]}, {(1, 2): -1, (2, 1): -1})
    assert {t[1] for t in crossing} == {1}
    assert op.repetitions([1, 2, 1, 2]) == [1, 2] and op.repetitions([1, 2, 2, 1]) is None


def test_defined_results(spark):
    rows = [(9, None, None), (8, None, ""), (7, "u", "plain &lt;text"), (7, "u", "plain &lt;text"), (None, "http://x/", "<p>a</p>"), (6, "http://y/", "<p " * 20_000), (5, "http://z/", "<div>" * 3000 + "deep" + "</b>" * 3000), (4, "http://w/", "x " * 1_000_000)]
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in run(spark, rows).collect()), key=str)
    assert got == sorted([(9, "", 0), (8, "", 0), (7, "plain <text", 11), (7, "plain <text", 11), (None, "a", 1), (6, ("<p " * 20_000).strip(), 59_999), (5, "deep", 4), (4, ("x " * 1_000_000).strip(), 1_999_999)], key=str)
    assert run(spark, []).where("page_id > 0").count() == 0


@pytest.mark.parametrize("page", ["<a " * 100_000, '<a ">" ' * 50_000, "</script" * 50_000, "<script>" + "</script" * 50_000, "<a>" * 50_000 + "</b>" * 50_000, "<!" * 100_000, '<a "' * 50_001])
def test_work_is_linear(page):
    began = time.time()
    op.extract(page, {})
    assert time.time() - began < 8


def test_every_tag_and_text_is_read_in_order():
    page = PAGE + "<p title='>'>x</p><p title=it's>y</p>"
    assert [t[1] for t in op.tokens(page) if t[0] == "open"] == [m.lower() for m in re.findall(r"<([a-zA-Z][a-z0-9]*)", page.replace("'</p>", ""))]


def test_crossing_classes_are_told_apart_by_position(spark):
    """Equal boxes of a fixed layout are no list: the notice in the first is template, what varies in the others is not."""
    page = "<hr><div><p>Notice</p></div><div><p>story {k}</p></div><em>by</em><div><p>more {k}</p></div>"
    got = texts(spark, [(k, "http://h/x", page.replace("{k}", str(k))) for k in range(5)])
    assert got == {k: f"story {k}\nmore {k}" for k in range(5)}
    # As many boxes as a page likes: they stay one class, and the pages do not agree on an order with it.
    page = "<hr><div><p>Notice</p></div>"
    got = texts(spark, [(k, "http://h/x", page + "".join(f"<div><p>own {k} {j}</p></div>" for j in range(k + 1))) for k in range(5)])
    assert all(f"own {k} {j}" in got[k].split("\n") for k in range(5) for j in range(k + 1))
    assert op.crossing({(1, 2): -1, (2, 1): -1, (2, 3): -1, (3, 2): -1, (1, 3): 1, (3, 1): -1, (4, 1): 0, (1, 4): 0}) == [[1, 2, 3]]
