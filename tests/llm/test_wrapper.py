"""Wrapper induction on planted sites, and texts that cleaning must not lose."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.llm import markup, wrapper


def page(host, i):
    menu = "".join(f"<li>{host} link {j}</li>" for j in range(1 + i % 3))
    extra = "<p>only here and there</p>" if i % 4 == 0 else ""
    return f"<div><ul>{menu}</ul><h1>Site {host}</h1>{extra}<p>story number {i} of {host}</p><footer>All rights with {host}</footer></div>"


def test_constant_nodes_go_and_slots_stay():
    found, n = wrapper.induce([page("a", i) for i in range(20)])
    slim, constant = wrapper._constant(found, n)
    assert n == 20 and constant == 4  # two of the links, the heading and the footer
    import json

    w = json.dumps(wrapper._dump(slim))
    out = markup.clean_text(wrapper.without_template(page("a", 7), w))
    assert "story number 7 of a" in out and "rights" not in out and "Site" not in out
    assert "only here and there" in wrapper.without_template(page("a", 8), w)
    assert wrapper.without_template("plain", w) == "plain" and wrapper.without_template(None, w) is None


def test_columns_with_hosts(spark, rows):
    data = [(i, h, page(h, i)) for i, h in enumerate(["a"] * 12 + ["b"] * 12)] + [(90, "c", page("c", 1)), (91, None, "<b>x</b>"), (92, "a", None), (93, "a", ""), (94, "a", "a < b"), (0, "a", page("a", 0))]
    df = spark.createDataFrame(data, "id long, host string, text string").withColumn("q_host", F.lit(1)).withColumn("q_text", F.lit(2))
    found = {r.q_host: (r.q_pages, r.q_constant > 0) for r in wrapper.wrappers(df, "id", "text", "host").collect()}
    assert found == {"a": (13, True), "b": (12, True), "c": (1, False), None: (1, False)}
    got = {}
    for k, t in rows(markup.clean_column(df, "id", "text", "host")):
        got.setdefault(k, []).append(t)
    assert len(got[0]) == 2 and "rights" not in got[3][0] and "story number 3" in got[3][0]
    assert "rights" in got[90][0] and got[91] == ["x"] and got[92] == [None] and got[93] == [""] and got[94] == ["a < b"]
    assert wrapper.wrappers(df.limit(0), "id", "text", "host").count() == 0


def test_every_page_of_a_host_counts(spark):
    def site(h, n, notice, links=1, copies=0):
        menu = "".join(f"<li>{h} link {j}</li>" for j in range(links))
        made = [f"<div><ul>{menu}</ul><p>story {i} of {h}</p>{'<footer>notice</footer>' if i < notice else ''}</div>" for i in range(n)]
        return [(h, t) for t in made + made[-1:] * copies]

    data = [r for i in range(8) for r in site(f"h{i}", 400, 200 - i % 2)]  # exactly half of the pages have the notice, or one less
    data += site("large", 12, 12, links=700) + site("again", 100, 100, copies=300) + site(None, 100, 100)
    data += [("again", "<div><p>one more</p></div>")] * 401
    df = spark.createDataFrame([(i, h, t) for i, (h, t) in enumerate(data)], "id long, host string, text string").repartition(3)
    found = {r.q_host: (r.q_pages, r.q_constant) for r in wrapper.wrappers(df, "id", "text", "host").collect()}
    assert found == {f"h{i}": (400, 2 - i % 2) for i in range(8)} | {"large": (12, 701), "again": (801, 1), None: (100, 2)}
    host = {i: h for i, (h, _) in enumerate(data)}
    left, stories = {}, 0
    for i, t in markup.clean_column(df, "id", "text", "host").collect():
        left[host[i]] = left.get(host[i], 0) + ("notice" in t)
        stories += "story" in t
        assert "link" not in t or host[i] == "again"
    assert left == {f"h{i}": 199 * (i % 2) for i in range(8)} | {"large": 0, "again": 400, None: 0}
    assert stories == len(data) - 401


def test_parts_in_other_orders_and_wide_pages():
    pages = [f"<h1>head</h1>{'<p>a</p><b>x</b>' * (i % 3)}<p>{i}</p>" + "<i>y</i>" * (80 * (i % 2)) + "<hr>foot" for i in range(40)]
    whole, n = wrapper.induce(pages, None, None)
    halves = [wrapper._constant(*wrapper.induce(pages[i::2], None, None))[0] for i in (0, 1)]
    match = wrapper.Match(wrapper._folded(halves))
    counts = Counter(t for p in pages for _, t in match.matched(match.shape(wrapper.tree(p))))
    assert n == 40 and counts["head"] == counts["foot"] == 40
    wrapper_ = json.dumps(wrapper._dump(wrapper._constant(whole, n)[0]))
    held, wrapper.CELLS = wrapper.CELLS, 10
    try:
        wrapper._LOADED.clear()
        few = wrapper.without_template(pages[5], wrapper_)
    finally:
        wrapper.CELLS = held
        wrapper._LOADED.clear()
    assert few == wrapper.without_template(pages[5], wrapper_) and "head" not in few and "foot" not in few and "<p>5</p>" in few


def test_deep_and_broken_pages():
    deep = "<div>" * 3000 + "x" + "</p></div>" * 10
    assert wrapper.tree(deep) is not None
    found, n = wrapper.induce([f"<p>one {i}<p>two" for i in range(10)] + [deep])
    assert n == 10 and wrapper._constant(found, n)[1] == 1


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Use the <script> tag for code. Everything after this matters.", "Use the <script> tag for code. Everything after this matters."),
        ("see <style> or <template> here\nand the rest of a long post", "see <style> or <template> here\nand the rest of a long post"),
        ("a <!-- b then the rest of the text", "a <!-- b then the rest of the text"),
        ("<pre> never closed and\n\nmore <b>x</b>", "never closed and\n\nmore x"),
        ("<script>var a = 1</script>x <script> y", "x <script> y"),
        ("[x](http://en.wikipedia.org/wiki/Foo_(bar)) ok", "x ok"),
        ("[[File:x.png|thumb|a [[b|c]] cap]] z", "a c cap z"),
        ("see __all__ of it", "see all of it"),
    ],
)
def test_no_text_is_lost(raw, want):
    assert markup.clean_text(raw) == want
