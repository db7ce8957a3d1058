"""XES event logs through Spark's XML functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.columns import is_zoneless
from tracewell.functions.tables import measured_broadcast
from tracewell.session import cut_lineage
from tracewell.spec import ACTIVITY, CASE, ORDER_KEY, POS, TS

# Fixed values of the format: attribute element names and standard keys.
ATTRIBUTE_TAGS = ("string", "date", "int", "float", "boolean", "id")
CASE_KEY = "concept:name"
TIME_KEY = "time:timestamp"
TRACE_END = "</trace>"

# Events per written trace element, so that no task holds a whole huge case.
EVENTS_PER_TRACE = 1000

# Elements that hold other attributes without a value of their own.
HOLDERS = ("list", "container")
# Levels of attributes inside attributes that are read.
DEPTH = 3

_FILE, _PLACE = "__file", "__place"
_MARKED = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>"


def _attribute(depth: int) -> T.StructType:
    """An attribute and, inside, attributes down to the depth; arrays throughout, since a lone element would otherwise be
    inferred as a struct. Values stay text: inference would make 7 of 007."""
    fields = [T.StructField("_key", T.StringType()), T.StructField("_value", T.StringType())]
    if depth > 1:
        inner = _holder(depth - 1)
        fields += [*inner.fields, T.StructField("values", inner)]
    return T.StructType(fields)


def _holder(depth: int) -> T.StructType:
    return T.StructType([T.StructField(tag, T.ArrayType(_attribute(depth))) for tag in ATTRIBUTE_TAGS + HOLDERS])


def trace_schema(depth: int = DEPTH) -> T.StructType:
    event = _holder(depth)
    return T.StructType([*event.fields, T.StructField("event", T.ArrayType(event))])


def _attributes(holder: Column, depth: int) -> Column:
    """The attributes directly inside an element, tag by tag."""
    none = F.lit([]).cast(T.ArrayType(_attribute(depth)))
    return F.concat(*[F.coalesce(holder[t], none) for t in ATTRIBUTE_TAGS + HOLDERS])


def _inside(attribute: Column, depth: int) -> Column:
    """The attributes inside an attribute, those of its `values` element included."""
    return F.concat(_attributes(attribute, depth - 1), F.coalesce(_attributes(attribute["values"], depth - 1), F.lit([]).cast(T.ArrayType(_attribute(depth - 1)))))


def _named(attributes: Column, key: str) -> Column:
    return F.filter(attributes, lambda a: a["_key"] == key)


def _at_path(attributes: Column, path: Sequence[str | int], depth: int) -> Column:
    """The value of the first attribute on a path of keys, or places in a list, into nested attributes."""
    step, rest = path[0], path[1:]
    found = F.get(attributes, F.lit(step)) if isinstance(step, int) else F.get(_named(attributes, step), F.lit(0))
    if not rest:
        return found["_value"]
    if depth == 1:
        return F.lit(None).cast("string")
    return _at_path(_inside(found, depth), rest, depth - 1)


def _first_of_each(attributes: Column) -> Column:
    """Key -> value; of a repeated key the first one."""
    keys = F.transform(attributes, lambda a: a["_key"])
    firsts = F.filter(attributes, lambda a, i: a["_key"].isNotNull() & (F.array_position(keys, a["_key"]) == i + 1))
    return F.map_from_entries(F.transform(firsts, lambda a: F.struct(a["_key"], a["_value"])))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The text of the files cut after each trace end, with the file and an order inside it."""
    text = spark.read.option("lineSep", TRACE_END).text(path)
    return text.select("value", F.col("_metadata.file_path").alias(_FILE), F.struct(
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth")).alias(_PLACE))


def _open_mark(value: Column) -> Column:
    """'-->' or ']]>', whichever a piece that begins outside of any still waits for at its end; null if none."""
    rest = F.regexp_replace(value, _MARKED, "")
    comment, cdata = F.instr(rest, "<!--"), F.instr(rest, "<![CDATA[")
    return F.when((comment > 0) & ((cdata == 0) | (comment < cdata)), "-->").when(cdata > 0, "]]>")


def _whole(pieces: DataFrame) -> DataFrame:
    """Pieces joined again where the cut was inside a comment or a CDATA section.

    A piece with an open mark is joined with those after it up to the first that closes the mark. What is sorted file by
    file are places and marks of such pieces only.
    """
    while True:
        marks = pieces.select(_FILE, _PLACE, _open_mark(F.col("value")).alias("open"), F.col("value").contains("-->").alias("c"), F.col("value").contains("]]>").alias("d"))
        marks = cut_lineage(marks.filter(F.col("open").isNotNull() | F.col("c") | F.col("d")))
        if marks.filter(F.col("open").isNotNull()).isEmpty():
            return pieces
        after = W.partitionBy(_FILE).orderBy(_PLACE).rowsBetween(1, W.unboundedFollowing)
        before = W.partitionBy(_FILE).orderBy(_PLACE).rowsBetween(W.unboundedPreceding, -1)
        ends = marks.select("*", F.when(F.col("open") == "-->", F.min(F.when(F.col("c"), F.col(_PLACE))).over(after)).when(
            F.col("open") == "]]>", F.min(F.when(F.col("d"), F.col(_PLACE))).over(after)).alias("end")).filter("end is not null")
        spans = ends.select(F.col(_FILE).alias("f"), F.col(_PLACE).alias("start"), "end", F.max("end").over(before).alias("covered"))
        spans = cut_lineage(spans.filter(F.col("covered").isNull() | (F.col("covered") < F.col("start"))))
        if spans.isEmpty():  # nothing closes: the document is malformed, which its parser says
            return pieces
        within = (F.col(_FILE) == F.col("f")) & (F.col(_PLACE) >= F.col("start")) & (F.col(_PLACE) <= F.col("end"))
        met = pieces.join(measured_broadcast(spans.select("f", "start", "end")), within, "left")
        joined = met.filter("f is not null").groupBy(_FILE, F.col("start").alias(_PLACE)).agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(_PLACE, "value"))), lambda p: p["value"]), TRACE_END).alias("value"))
        pieces = cut_lineage(met.filter("f is null").select("value", _FILE, _PLACE).unionByName(joined.select("value", _FILE, _PLACE)))


def _defaults(pieces: DataFrame, depth: int) -> DataFrame:
    """(file, case_defaults, event_defaults): the values that the header of a file gives for all its traces and events."""
    head = F.substring_index(F.regexp_replace("value", _MARKED, ""), "<trace", 1)
    heads = pieces.select(F.col(_FILE).alias("__of"), head.alias("head")).filter(F.col("head").contains("<global"))

    def scope(name: str) -> Column:
        xml = F.regexp_extract("head", rf"(?s)<global[^>]*scope\s*=\s*[\"']{name}[\"'][^>]*>.*?</global>", 0)
        read = F.from_xml(xml, _holder(depth), {"attributePrefix": "_", "mode": "FAILFAST"})
        return F.when(xml != "", _first_of_each(_attributes(read, depth)))

    return heads.groupBy("__of").agg(F.max("head").alias("head")).select("__of", scope("trace").alias("case_defaults"), scope("event").alias("event_defaults"))


def read_xes(
    spark: SparkSession,
    path: str,
    case_attributes: Mapping[str, str],
    event_attributes: Mapping[str, str],
    nested: Mapping[str, tuple[Sequence[str | int], str]] | None = None,
    repeated: Mapping[str, str] | None = None,
    defaults: bool = True,
    depth: int = DEPTH,
    tree: bool = False,
) -> DataFrame:
    """XES files -> one row per event, the case attributes repeated on every event.

    The text is cut at the end of each trace, so Spark splits a document of any size over many tasks, with or without a
    root element; a cut inside a comment or a CDATA section is joined again. A malformed trace fails the read. An event's
    place in its trace becomes the order key unless an `order_key` attribute is named.

    Of a repeated key the first value counts; `repeated` maps output columns to keys whose values are all wanted, as an
    array. `nested` maps output columns to a path of keys (or places, in a list) into attributes of attributes, down to
    `depth`, and a type. With `defaults` the file's <global> values stand where a trace or an event has none.
    `tree` adds `case_tree` and `event_tree`, all that was read of both as VARIANT. Whether there are open comments and
    headers is looked up first, in one pass over the text.
    """
    pieces = _pieces(spark, path)
    signs = pieces.agg(F.max(_open_mark(F.col("value")).isNotNull()).alias("open"), F.max(F.col("value").contains("<global")).alias("globals")).first()
    if signs["open"]:
        pieces = _whole(pieces)
    clean = F.regexp_replace("value", _MARKED, "")
    text = pieces.select(_FILE, clean.alias("text")).withColumn("start", F.regexp_instr("text", F.lit(r"<trace[\s>]"))).filter("start > 0")
    xml = text.select(_FILE, F.concat(F.substring("text", F.col("start"), F.length("text")), F.lit(TRACE_END)).alias("xml"))
    traces = xml.select(_FILE, F.from_xml("xml", trace_schema(depth), {"attributePrefix": "_", "mode": "FAILFAST"}).alias("t"))
    events = traces.select(_FILE, "t", _attributes(F.col("t"), depth).alias("case"), F.posexplode("t.event").alias("place", "e"))
    none = F.create_map().cast("map<string,string>")
    if defaults and signs["globals"]:
        events = events.join(measured_broadcast(_defaults(pieces, depth)), F.col(_FILE) == F.col("__of"), "left")
    else:
        events = events.select("*", none.alias("case_defaults"), none.alias("event_defaults"))
    own = events.select("*", _attributes(F.col("e"), depth).alias("event"))
    rows = own.select("*", _first_of_each(F.col("case")).alias("case_map"), _first_of_each(F.col("event")).alias("event_map"))

    def of(kind: str, key: str) -> Column:
        return F.coalesce(F.col(f"{kind}_map")[key], F.col(f"{kind}_defaults")[key])

    own_order = ORDER_KEY in event_attributes
    order = of("event", ORDER_KEY).cast("long") if own_order else F.col("place").cast("long")
    case_tree = F.to_variant_object(F.struct(*[F.col(f"t.{tag}").alias(tag) for tag in ATTRIBUTE_TAGS + HOLDERS]))
    trees = [case_tree.alias("case_tree"), F.to_variant_object(F.col("e")).alias("event_tree")]
    return rows.select(
        of("case", CASE_KEY).alias(CASE),
        of("event", CASE_KEY).alias(ACTIVITY),
        F.to_timestamp(of("event", TIME_KEY)).alias(TS),
        order.alias(ORDER_KEY),
        *[of("case", k).cast(t).alias(k) for k, t in case_attributes.items()],
        *[of("event", k).cast(t).alias(k) for k, t in event_attributes.items() if k != ORDER_KEY],
        *[F.transform(_named(F.col("event"), k), lambda a: a["_value"]).alias(n) for n, k in (repeated or {}).items()],
        *[_at_path(F.col("event"), list(p), depth).cast(t).alias(n) for n, (p, t) in (nested or {}).items()],
        *(trees if tree else []),
    )


def _escaped(c: Column) -> Column:
    text = F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;"))
    pairs = (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;"))
    for raw, safe in pairs:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def _element(tag: str, key: str, value: Column) -> Column:
    """One attribute element; empty text when the value is null."""
    text = F.concat(F.lit(f'<{tag} key="{key}" value="'), _escaped(value), F.lit('"/>'))
    return F.coalesce(text, F.lit(""))


def write_xes(
    ordered: DataFrame, path: str, event_attributes: Sequence[str], case_attributes: Sequence[str] = ()
) -> None:
    """Write an ordered log as XES trace elements, at most EVENTS_PER_TRACE events in each.

    A longer case becomes several trace elements of the same name; the written order key keeps
    their order.
    """
    wall = F.date_format(F.col(TS).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    offset = F.when(is_zoneless(F.col(TS)), "Z").otherwise(F.date_format(F.col(TS).cast("timestamp"), "XXX"))
    stamp = F.concat(wall, offset)
    event = F.concat(
        F.lit("<event>"),
        _element("string", CASE_KEY, F.col(ACTIVITY)),
        _element("date", TIME_KEY, stamp),
        _element("int", ORDER_KEY, F.col(ORDER_KEY)),
        *[_element("string", a, F.col(a)) for a in event_attributes],
        F.lit("</event>"),
    )
    part = F.floor((F.col(POS) - 1) / EVENTS_PER_TRACE)
    traces = ordered.groupBy(CASE, part.alias("part")).agg(
        F.array_sort(F.collect_list(F.struct(POS, event.alias("xml")))).alias("events"),
        *[F.first(a, ignorenulls=True).alias(a) for a in case_attributes],
    )
    body = F.concat(
        F.lit("<trace>"),
        _element("string", CASE_KEY, F.col(CASE)),
        *[_element("string", a, F.col(a)) for a in case_attributes],
        F.array_join(F.transform("events", lambda e: e["xml"]), ""),
        F.lit("</trace>"),
    )
    traces.select(body.alias("value")).write.text(path)
