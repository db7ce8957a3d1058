import json

import pytest
from pyspark.sql import functions as F

from tracewell.sources.xes import read_xes

HEAD = """<?xml version="1.0" encoding="UTF-8"?>
<!-- a header with <trace> and </trace> in a comment -->
<log xes.version="1.0">
<global scope="trace"><string key="channel" value="web"/></global>
<global scope="event"><string key="org:resource" value="nobody"/><string key="note" value="0042"/></global>
"""


def event(name, extra="", minute=0):
    return f'<event><string key="concept:name" value="{name}"/><date key="time:timestamp" value="2024-01-01T00:{minute:02d}:00Z"/>{extra}</event>'


def trace(name, *events, extra=""):
    return f'<trace><string key="concept:name" value="{name}"/>{extra}{"".join(events)}</trace>'


def _read(spark, tmp_path, *documents, **how):
    for i, text in enumerate(documents):
        (tmp_path / f"{i}.xes").write_text(text)
    return read_xes(spark, str(tmp_path), how.pop("case", {}), how.pop("event", {}), **how)


def _names(df):
    return sorted((r.case_id, r.activity) for r in df.collect())


def test_repeated_keys(spark, tmp_path):
    doc = trace("c", event("a", '<string key="tag" value="x"/><int key="n" value="1"/><string key="tag" value="y"/>'), event("b"))
    rows = _read(spark, tmp_path, doc, event={"tag": "string", "n": "int"}, repeated={"tags": "tag"}).orderBy("order_key").collect()
    assert [(r.activity, r.tag, r.n, r.tags) for r in rows] == [("a", "x", 1, ["x", "y"]), ("b", None, None, [])]


def test_nested_values(spark, tmp_path):
    inner = '<string key="person" value="P"><string key="unit" value="007"><int key="floor" value="3"/></string><string key="unit" value="2"/></string>'
    items = '<list key="items"><values><string key="item" value="1.0"/><string key="item" value="two"/></values></list>'
    df = _read(spark, tmp_path, trace("c", event("a", inner + items), event("b")), nested={
        "unit": (("person", "unit"), "string"), "floor": (("person", "unit", "floor"), "int"), "second": (("items", 1), "string"), "too_deep": (("person", "unit", "floor", "x"), "int")},
        event={"person": "string"}, tree=True).orderBy("order_key")
    first, other = df.collect()
    assert (first.person, first.unit, first.floor, first.second, first.too_deep) == ("P", "007", 3, "two", None)
    assert (other.unit, other.floor, other.second) == (None, None, None)
    tree = json.loads(df.select(F.to_json("event_tree").alias("t")).first().t)
    person = next(a for a in tree["string"] if a["_key"] == "person")
    assert [x["_value"] for x in person["string"]] == ["007", "2"]  # text as it is, not a number
    assert json.loads(df.select(F.to_json("case_tree").alias("t")).first().t)["string"][0]["_value"] == "c"


def test_defaults_of_each_file(spark, tmp_path):
    with_head = HEAD + trace("c1", event("a"), event("b", '<string key="org:resource" value="me"/>'), extra='<string key="channel" value="shop"/>') + trace("c2", event("a")) + "</log>"
    without = trace("c3", event("a"))
    how = {"case": {"channel": "string"}, "event": {"org:resource": "string", "note": "string"}}
    rows = {(r.case_id, r.activity): (r.channel, r["org:resource"], r.note) for r in _read(spark, tmp_path, with_head, without, **how).collect()}
    assert rows == {("c1", "a"): ("shop", "nobody", "0042"), ("c1", "b"): ("shop", "me", "0042"), ("c2", "a"): ("web", "nobody", "0042"), ("c3", "a"): (None, None, None)}
    plain = _read(spark, tmp_path, with_head, without, defaults=False, **how).filter("note is null")
    assert plain.count() == 4


def test_ends_inside_comments_and_sections(spark, tmp_path):
    doc = HEAD + trace("c1", event("a"), "<!-- old: </trace><trace>" + event("gone") + "</trace> -->", event("b")) + "<!-- " + trace("gone", event("gone")) + trace(
        "gone too", event("gone")) + " -->" + trace("c2", "<![CDATA[ </trace> <!-- ]]>", event("c")) + trace("c3", event("d", "<!-- a --><!-- b </trace> -->")) + "</log>"
    for splits in ("128m", "512"):  # the file in one task, and in many
        spark.conf.set("spark.sql.files.maxPartitionBytes", splits)
        try:
            assert _names(_read(spark, tmp_path, doc, trace("other", event("x")))) == [("c1", "a"), ("c1", "b"), ("c2", "c"), ("c3", "d"), ("other", "x")]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_all_four_in_one_document(spark, tmp_path):
    odd = '<string key="tag" value="x"><string key="deep" value="1"/></string><string key="tag" value="y"/>'
    doc = HEAD + trace("c1", event("a", odd), "<!-- </trace> -->", event("b")) + trace("c2", event("c")) + "</log>"
    rows = _read(spark, tmp_path, doc, case={"channel": "string"}, event={"tag": "string", "note": "string"}, nested={"deep": (("tag", "deep"), "int")}).collect()
    assert sorted((r.case_id, r.activity, r.channel, r.tag, r.note, r.deep) for r in rows if r.tag) == [("c1", "a", "web", "x", "0042", 1)]
    assert len(rows) == 3 and all(r.note == "0042" for r in rows)


def test_malformed_traces_fail(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)malformed|MALFORMED"):
        _read(spark, tmp_path, trace("c", "<event><string key=</event>")).collect()
