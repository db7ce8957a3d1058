"""Main text of web pages through wrappers inferred per host (union-free regular expressions).

A page is a stream of block tags and texts, with left-out end tags put in. Pages of a host are aligned
one after another to the host's wrapper: texts that differ become slots, elements that some pages lack
become optional, neighbours of one kind a repeated group, and kinds whose order differs a repeated
group of optional members. So an element is an ordered list of groups, a union-free expression.
Every task aligns its own pages, and partial wrappers of a host are aligned 64 at a time, so a host with a
third of all pages is split over all tasks. An element keeps at most MAX_KINDS kinds of children
(further ones are told apart by their tag alone), which bounds a wrapper.

Extraction goes by lists and by slots, not by the expression: navigation, headers, footers, asides, forms,
notices, adverts and comments go by element or by names of class, id and role, one instance at a time; a name counts only as
a whole, so "ad-box" is furniture and "ad-free" is not, and ids of headings do not count. What is left inside article or
main elements is content. For pages without such an element, slots that hold one short text
on all of several distinct pages go, and so do slots that are mostly links. An element is a holder if it has most of the
text of the distinct pages that have the element (the branch they take), and a page's content is the deepest
holder with most of the page's own text. The order and repetition of groups serve `expression` alone.

Nulls: a null page is empty and has the text ""; pages without a host form one group. Page ids are
passed on. Markup that never ends, stray end tags and unfinished pages are read as far as they go.
"""

from __future__ import annotations

import html as entities
import json
import re
from hashlib import blake2b

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.tables import measured_broadcast
from tracewell.llm.common import small_batches, staged, text_of

MAX_KINDS, MAX_DEPTH, FAN_IN = 64, 48, 64
CONST_CHARS = 120
MAIN_SHARE = 0.6  # of a page's text and of its branch's, for pages without article or main
LEAST_PAGES = 3  # distinct pages that show a text to be fixed or an element to be a holder

# fixed values: elements of HTML by their part in a page
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg object select canvas audio video".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd "
    "mfenced menclose mspace mpadded mphantom mstyle merror semantics annotation".split())
DROPPED = frozenset("head nav header footer aside form button menu dialog fieldset".split())
DROPPED_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts sponsor sponsored promo promotion banner sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer header comment comments disqus notice notices alert cookie cookies consent gdpr popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended widget toolbar pager pagination masthead "
    "contentinfo complementary search teaser teasers".split())
# words that say nothing beside those above; any other word beside them names a subject, as in social-history or ad-free
NEUTRAL = frozenset(
    "area articles bar block body bottom box button buttons btn card center col column container content count desktop feed fixed floating "
    "footer form global grid group header heading holder icon icons inner item items js layout left level link links list main message "
    "mobile module one outer page panel post posts primary right row secondary section site slot small space static sticky stories "
    "strip text thread title top two unit view wrap wrapper zone".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset(["article", "main"])
CLOSED_BY = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]{0,4096}"|'[^']{0,4096}'|[^>"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<""",
    re.S)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s"'>][^\s>]*))?""")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _is_furniture(name: str) -> bool:
    """Whether a class name or an id as a whole names page furniture: such words and neutral ones, nothing else."""
    words = [w for w in re.split(r"[^a-z]+", _CAMEL.sub("-", name).lower()) if w]
    return any(w in DROPPED_WORDS for w in words) and all(len(w) == 1 or w in DROPPED_WORDS or w in NEUTRAL for w in words)


def _label(tag: str, attrs: str) -> tuple[str, bool]:
    """What the element is called in wrappers, and whether it is page furniture.

    Furniture is marked with "!", so it is a kind of its own beside kept elements of the same tag and words. The id of
    a heading is made of its text and says nothing about its part in the page.
    """
    words, dropped = [], tag in DROPPED
    for name, value in _ATTR.findall(attrs) if attrs else ():
        name, value = name.lower(), value.strip("\"'")
        if name == "style":
            dropped |= bool(_HIDDEN.search(value))
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            dropped = True
        elif name in ("class", "id", "role"):
            words += [w for w in re.split(r"[^a-z]+", value.lower()) if w]
            dropped |= not (name == "id" and tag in HEADINGS) and any(map(_is_furniture, value.split()))
    return "!" * dropped + ".".join([tag, *sorted(set(words))[:4]]), dropped


def events(page: str):
    """("open", label, dropped), ("close",), ("text", string, in a link): balanced, without inline elements."""
    stack: list[str] = []
    standing: dict[str, int] = {}  # how many of each tag are on the stack
    at, link, size = 0, 0, len(page)

    def close_to(depth):
        while len(stack) > depth:
            standing[stack.pop()] -= 1
            yield ("close",)

    while at < size:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            piece = m[0]
            if piece[:2] not in ("<!", "<?"):
                yield ("text", piece, link > 0)
            continue
        if m[1] or m[4]:
            if tag == "a":
                link = max(0, link - 1)
            elif standing.get(tag):
                i = len(stack) - 1
                while stack[i] != tag:
                    i -= 1
                yield from close_to(i)
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}", re.I).search(page, at)
            after = page.find(">", end.start()) if end else -1
            at = after + 1 if after >= 0 else size
            yield ("text", " ", False)
            continue
        if tag in VOID:
            if tag == "br":
                yield ("text", " ", False)
            elif tag == "hr":
                yield from (("open", "hr", False), ("close",))
            continue
        if tag in INLINE:
            link += tag == "a"
            continue
        for i in range(len(stack) - 1, -1, -1):  # end tags that may be left out
            if stack[i] == "p" or stack[i] == tag and tag in CLOSED_BY:
                yield from close_to(i)
                break
            if stack[i] not in CLOSED_BY or stack[i] in CLOSED_BY.get(tag, ()):
                break
        stack.append(tag)
        standing[tag] = standing.get(tag, 0) + 1
        yield ("open", *_label(tag, m[3] or m[6] or ""))
    yield from close_to(0)


# ---- wrappers ----
# An element is {"n": instances, "rep": several in a row, "order": groups of labels, "kids": {label: element}};
# texts are the kid "#" with {"n", "rep", "const", "pages": LEAST_PAGES distinct pages at most}; the root has "bare": pages
# with text but without article and main; labels of dropped elements begin with "!".

def _element() -> dict:
    return {"n": 0, "rep": False, "order": [], "kids": {}}


def _ordered(order: list[list[str]], sequence: list[str]) -> list[list[str]]:
    """Groups of labels after a further sequence was seen: labels whose order differs share a group."""
    edges: dict[str, set[str]] = {}
    for group in order:
        for a, b in zip(group, group[1:] + group[:1]):
            edges.setdefault(a, set()).add(b)
    for left, right in zip(order, order[1:]):
        edges[left[0]].add(right[0])
    for a, b in zip(sequence, sequence[1:]):
        edges.setdefault(a, set()).add(b)
    labels = list(dict.fromkeys([x for g in order for x in g] + sequence))
    reach: dict[str, set[str]] = {}
    for a in labels:
        seen, todo = set(), [a]
        while todo:
            for b in edges.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach[a] = seen
    groups: list[list[str]] = []
    for a in labels:
        for g in groups:
            if a in reach[g[0]] and g[0] in reach[a]:
                g.append(a)
                break
        else:
            groups.append([a])
    # a group stands after all that reach it
    return sorted(groups, key=lambda g: (sum(g[0] in reach[a] for a in labels if a not in g), labels.index(g[0])))


def _kind(element: dict, label: str) -> str:
    if label in element["kids"] or len(element["kids"]) < MAX_KINDS:
        return label
    return label.split(".")[0]


def _add_slot(element: dict, text: str) -> dict:
    short = text if len(text) <= CONST_CHARS else None
    slot = element["kids"].setdefault("#", {"n": 0, "rep": False, "const": short, "pages": []})
    slot["n"] += 1
    if slot["const"] != short:
        slot["const"] = None
    return slot


def _some(pages: list[int], more: list[int]) -> list[int]:
    return sorted({*pages, *more})[:LEAST_PAGES]


def _digest(texts: list[str]) -> int:
    return int.from_bytes(blake2b("\0".join(texts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def align_page(wrapper: dict, page: str, seen: set) -> None:
    """Align a page to the wrapper. `seen` holds child sequences already aligned, by element."""
    stack = [(wrapper, [])]  # element and the labels of its children here
    below = 0  # open elements deeper than MAX_DEPTH: their texts are filed with the last element above
    dropped = 0  # open elements from a dropped one on
    has_main, texts, slots = False, [], {}
    wrapper["n"] += 1

    def finish():
        element, sequence = stack.pop()
        for label in {a for a, b in zip(sequence, sequence[1:]) if a == b}:
            element["kids"][label]["rep"] = True
        short = [x for i, x in enumerate(sequence) if i == 0 or sequence[i - 1] != x]
        key = (id(element), tuple(short))
        if key not in seen:
            seen.add(key)
            element["order"] = _ordered(element["order"], short)

    for event in events(page):
        if event[0] == "open":
            dropped += bool(dropped or event[2])
            has_main |= not dropped and _is_main(event[1])
        elif event[0] == "close":
            dropped -= bool(dropped)
        if event[0] != "text" and (below or event[0] == "open" and len(stack) > MAX_DEPTH):
            below += 1 if event[0] == "open" else -1
        elif event[0] == "open":
            element, sequence = stack[-1]
            label = _kind(element, event[1])
            kid = element["kids"].setdefault(label, _element())
            kid["n"] += 1
            sequence.append(label)
            stack.append((kid, []))
        elif event[0] == "close":
            finish()
        else:
            text = " ".join(event[1].split())
            if text:
                element, sequence = stack[-1]
                slot = _add_slot(element, text)
                slots[id(slot)] = slot
                if not dropped:
                    texts.append(text)
                if sequence[-1:] != ["#"]:
                    sequence.append("#")
    while stack:
        finish()
    page_is = [_digest(texts)]
    for slot in slots.values():
        slot["pages"] = _some(slot["pages"], page_is)
    wrapper["bare"] = wrapper.get("bare", 0) + (not has_main and bool(texts))


def align_wrappers(a: dict, b: dict) -> dict:
    """The wrapper of both wrappers' pages."""
    for label, kid in b["kids"].items():
        label = _kind(a, label)
        if label not in a["kids"]:
            a["kids"][label] = kid
        elif label == "#":
            own = a["kids"]["#"]
            own["const"] = own["const"] if own["const"] == kid["const"] else None
            own["n"] += kid["n"]
            own["pages"] = _some(own["pages"], kid["pages"])
        else:
            align_wrappers(a["kids"][label], kid)
    a["n"] += b["n"]
    a["rep"] |= b["rep"]
    if "bare" in b:
        a["bare"] = a.get("bare", 0) + b["bare"]
    sequence = [_kind(a, x) for g in b["order"] for x in g]
    order = _ordered(a["order"], sequence)
    for g in b["order"]:
        if len(g) > 1:
            order = _ordered(order, [_kind(a, x) for x in g + g[:1]])
    a["order"] = order
    return a


def expression(element: dict, label: str = "") -> str:
    """The wrapper as a union-free regular expression."""
    def unit(x, optional):
        kid = element["kids"][x]
        body = "#text" if x == "#" else expression(kid, x)
        if kid["rep"]:
            return f"({body})" + ("*" if optional else "+")
        return f"({body})?" if optional else body

    parts = []
    for group in element["order"]:
        if len(group) > 1:
            parts.append("(" + "".join(unit(x, True) for x in group) + ")+")
        else:
            parts.append(unit(group[0], group[0] != "#" and element["kids"][group[0]]["n"] < element["n"]))
    inner = "".join(parts)
    label = label.lstrip("!")
    return f"<{label}>{inner}</{label.split('.')[0]}>" if label else inner


def _is_main(label: str) -> bool:
    return label.split(".")[0] in MAIN or "main" in label.split(".")[1:]


def content_paths(wrapper: dict) -> dict[str, list[str]]:
    """For texts outside article and main: paths of the elements the wrapper tells apart, and paths of elements whose
    own text never changes."""
    known: list[str] = []
    fixed: list[str] = []

    def walk(element, path):
        for label, kid in element["kids"].items():
            if label == "#":
                if kid["const"] is not None and len(kid["pages"]) >= LEAST_PAGES:
                    fixed.append(path)
            elif label[0] != "!" and not _is_main(label):
                known.append(f"{path}/{label}")
                walk(kid, f"{path}/{label}")

    walk(wrapper, "")
    return {"known": sorted(known), "out": sorted(fixed)}


# ---- extraction ----

def _blocks(page: str, known: frozenset[str]) -> tuple[list[tuple], set[str], bool]:
    """Kept texts as (text, characters in links, inside main, path, paths from the root down), all paths of the page,
    and whether it has an article or main.

    An element goes by its own label if the wrapper has it there, else by its tag, as in alignment. One that the
    wrapper does not tell apart has no path (None) and belongs to the nearest one above.
    """
    blocks: list[tuple] = []
    opened: set[str] = {""}
    buffer: list[tuple[str, bool]] = []
    has_main = False
    # path, paths from the root down, depth, dropped, inside main
    stack: list[tuple[str | None, tuple[str, ...], int, bool, bool]] = [("", ("",), 0, False, False)]

    def flush():
        text = " ".join(entities.unescape("".join(x for x, _ in buffer)).split())
        path, down, _, drop, main = stack[-1]
        if text and not drop:
            blocks.append((text, sum(len(" ".join(x.split())) for x, link in buffer if link), main, path, down))
        buffer.clear()

    for event in events(page):
        if event[0] == "text":
            buffer.append(event[1:])
            continue
        flush()
        if event[0] == "close":
            stack.pop()
            continue
        path, down, depth, drop, main = stack[-1]
        drop |= event[2]
        main |= _is_main(event[1])
        if path is not None and not main and not drop:
            path = next((x for x in (f"{path}/{event[1]}", f"{path}/{event[1].split('.')[0]}") if x in known), None) if depth < MAX_DEPTH else None
            if path is not None:
                down = (*down, path)
                opened.add(path)
        stack.append((path, down, depth + 1, drop, main))
        has_main |= main and not drop
    flush()
    return blocks, opened, has_main


def _weights(plain: list[tuple]) -> dict[str, int]:
    """Characters outside links at and below each path."""
    weight = {"": 0}
    for text, links, _, _, down in plain:
        for p in down:
            weight[p] = weight.get(p, 0) + max(0, len(text) - links)
    return weight


def page_slots(page: str, known: frozenset[str], out: frozenset[str]) -> tuple[int, list[tuple[str, int, int, int]]] | None:
    """For a page with text but without article and main: a number that copies share, and for each of its paths the
    characters outside links at and below it, its own characters, and those of them in links."""
    blocks, opened, has_main = _blocks(page, known)
    if has_main or not blocks:
        return None
    plain = [b for b in blocks if b[3] not in out]
    weight = _weights(plain)
    own: dict[str, list[int]] = {}
    for text, links, _, path, _ in plain:
        if path is not None:
            mine = own.setdefault(path, [0, 0])
            mine[0] += len(text)
            mine[1] += links
    rows = [(p, weight.get(p, 0), *own.get(p, (0, 0))) for p in sorted(opened)]
    return _digest([x for b in blocks for x in (b[4][-1], b[0])] + [r[0] for r in rows]), rows


def extract(page: str, known: frozenset[str], out: frozenset[str] = frozenset(), holders: frozenset[str] = frozenset()) -> str:
    """Content blocks of the page, one on a line.

    Inside article and main every kept text is content, whatever the wrapper holds. For other pages it is what the
    deepest of the holders with most of the page's own text has in slots that are not `out`.
    """
    blocks, _, has_main = _blocks(page, known)
    if has_main:
        return "\n".join(b[0] for b in blocks if b[2])
    plain = [b for b in blocks if b[3] not in out]
    weight = _weights(plain)
    most = [p for p, w in weight.items() if p in holders and w >= MAIN_SHARE * weight[""] > 0]
    best = max(most, key=lambda p: (p.count("/"), p), default="")
    return "\n".join(b[0] for b in plain if best in b[4])


def with_host(pages: DataFrame, url: str) -> DataFrame:
    return pages.withColumn("__host", F.lower(F.regexp_extract(text_of(F.col(f"`{url}`")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)))


def host_wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, wrapper): one wrapper as JSON for every host."""
    small_batches(pages.sparkSession)

    def align(batches):
        own: dict[str, dict] = {}
        seen: set = set()
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                align_page(own.setdefault(host, _element()), page.as_py(), seen)
            if len(seen) > 100_000:
                seen.clear()
        part = TaskContext.get().partitionId()
        hosts = sorted(own)
        for at in range(0, len(hosts), 1000):
            some = hosts[at : at + 1000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.string()), pa.array([part] * len(some), pa.int32()), pa.array([json.dumps(own[h]) for h in some], pa.string())],
                names=["host", "part", "wrapper"])

    def merge(key, frame):
        merged = None
        for text in frame.sort_values("part")["wrapper"]:
            wrapper = json.loads(text)
            merged = wrapper if merged is None else align_wrappers(merged, wrapper)
        import pandas as pd

        return pd.DataFrame({"host": [key[0]], "part": pd.Series([key[1]], dtype="int32"), "wrapper": [json.dumps(merged)]})

    schema = "host string, part int, wrapper string"
    source = with_host(pages, url).select("__host", text_of(F.col(f"`{html}`")).alias("h"))
    wrappers = staged(source.mapInArrow(align, schema), "wrappers")
    most = wrappers.agg(F.max("part")).first()[0]
    while most:  # FAN_IN partial wrappers of a host at a time
        most //= FAN_IN
        nearer = wrappers.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
        wrappers = staged(nearer.groupBy("host", "part").applyInPandas(merge, schema), "wrappers")
    return wrappers.select("host", "wrapper")


def bare_slots(pages: DataFrame, paths: DataFrame, url: str, html: str) -> DataFrame:
    """(__host, links, holders) of hosts with pages without article and main: slots mostly of links, and holders."""
    def weigh(batches):
        known: dict[str, list[frozenset]] = {}
        for batch in batches:
            rows: list[tuple] = []
            for host, page, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                found = page_slots(page.as_py(), *_judged(known, wanted))
                if found:
                    rows.append((host, found[0], *(list(x) for x in zip(*found[1]))))
            longs = pa.list_(pa.int64())
            types = [pa.string(), pa.int64(), pa.list_(pa.string()), longs, longs, longs]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, types)], names=names)

    names = ["__host", "page", "path", "under", "chars", "links"]
    schema = "__host string, page bigint, path array<string>, under array<bigint>, chars array<bigint>, links array<bigint>"
    source = with_host(pages, url).select("__host", text_of(F.col(f"`{html}`")).alias("h")).join(paths, "__host").select("__host", "h", "paths")
    distinct = source.mapInArrow(weigh, schema).dropDuplicates(["__host", "page"])
    each = distinct.withColumn("total", F.element_at("under", 1)).select("__host", "total", F.explode(F.arrays_zip("path", "under", "chars", "links")).alias("s"))
    slots = staged(each.groupBy("__host", "s.path").agg(
        F.count("*").alias("n"), *[F.sum(c).alias(c.split(".")[-1]) for c in ("s.under", "total", "s.chars", "s.links")]), "bare-slots")
    whole = slots.where("path = ''").select("__host", F.least("n", F.lit(LEAST_PAGES)).alias("least"))
    # an element that holds most of the text and is no single paragraph
    holds = (F.col("n") >= F.col("least")) & (F.col("under") >= MAIN_SHARE * F.col("total")) & ~F.col("path").rlike(r"/(p|li|td|pre)(\.[^/]*)?$")
    return slots.join(whole, "__host").groupBy("__host").agg(
        F.sort_array(F.collect_list(F.when(F.col("links") * 2 > F.col("chars"), F.col("path")))).alias("links"),
        F.sort_array(F.collect_list(F.when(holds, F.col("path")))).alias("holders"))


def _judged(known: dict[str, list[frozenset]], wanted: str) -> list[frozenset]:
    if wanted not in known:
        if len(known) > 1000:
            known.clear()
        known[wanted] = [frozenset(x) for x in json.loads(wanted).values()]
    return known[wanted]


def main_text(pages: DataFrame, url: str = "url", html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The `keep` columns and the main text of every page."""
    def judge(batches):
        for batch in batches:
            wrappers = [json.loads(w.as_py()) for w in batch.column(1)]
            paths = [json.dumps(content_paths(w)) for w in wrappers]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(paths, pa.string()), pa.array([w["bare"] for w in wrappers], pa.int64())], names=["__host", "paths", "bare"])

    def extend(batches):
        for batch in batches:
            rows = []
            for paths, links, holders in zip(*[c.to_pylist() for c in batch.columns[1:]]):
                both = json.loads(paths)
                rows.append(json.dumps({"known": both["known"], "out": both["out"] + (links or []), "holders": holders or []}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.string())], names=["__host", "paths"])

    judged = staged(host_wrappers(pages, url, html).mapInArrow(judge, "__host string, paths string, bare bigint"), "content-paths")
    bare = judged.where("bare > 0").select("__host", "paths")
    paths = judged.select("__host", "paths")
    if not bare.isEmpty():
        slots = bare_slots(pages, measured_broadcast(bare, 2_000), url, html)
        paths = staged(paths.join(slots, "__host", "left").mapInArrow(extend, "__host string, paths string"), "judged-paths")
    paths = measured_broadcast(paths, 2_000)

    def run(batches):
        known: dict[str, list[frozenset]] = {}
        for batch in batches:
            out = []
            for page, wanted in zip(batch.column(len(keep)), batch.column(len(keep) + 1).to_pylist()):
                out.append(extract(page.as_py(), *_judged(known, wanted)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, pa.string())], names=[*keep, "__text"])

    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    rows = with_host(pages, url).select(*[F.col(f"`{c}`") for c in keep], text_of(F.col(f"`{html}`")).alias("__html"), "__host")
    joined = rows.join(paths, "__host").select(*[F.col(f"`{c}`") for c in keep], "__html", "paths")
    return joined.mapInArrow(run, f"{schema}, __text string")


def page_report(pages: DataFrame) -> DataFrame:
    return main_text(pages).select("page_id", "url", F.col("__text").alias("text"), F.length("__text").cast("long").alias("n_chars"))
