"""Personal data: expressions propose spans, checksums confirm them, nearby words adjust the score.

One pass without any shuffle; every expression is a JVM built-in. A null or empty text has no spans;
ids are only passed on, so null or repeated ids and repeated rows each keep their own result row.
Positions count code points. All expressions run in time linear in the text: character runs are
possessive and may not restart inside a run, and no pattern recurses over an unbounded group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import text_of

KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE_KINDS = KINDS[:4]

# Stand-ins (private use) for a dot between two label characters, and for one separator between two digits.
DOT, SEP, OTHER = "\ue000", "\ue001", "\ue002"
_LABEL = "A-Za-z0-9-"
_LOCAL = r"A-Za-z0-9._%+\-" + DOT
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++{DOT}[{_LABEL}{DOT}]++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": rf"[0-9][0-9{SEP}]++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_IP = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
# Belief in a span whose check passed; words around it add CONTEXT_BONUS, and spans below THRESHOLD are dropped.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.95, "ssn": 0.3}
CONTEXT = {
    "email": "mail|contact|kontakt|correo|courriel|write|schreib",
    "ip": r"\bip\b|server|host|address|adresse|direcci",
    "card": "card|visa|master|amex|credit|karte|carte|tarjeta|pay",
    "phone": r"phone|call|tel|fax|mobile|ruf|appel|llam",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social|security|insurance",
}
CONTEXT_BONUS, CONTEXT_CHARS, THRESHOLD = 0.3, 40, 0.5


def _luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    places = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int"))
    total = F.aggregate(
        F.transform(places, lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))),
        F.lit(0), lambda acc, d: acc + d)
    return total % 10 == 0


def _mod97(account: Column) -> Column:
    """Whether the account number, its first four characters moved to the end, leaves 1 modulo 97."""
    moved = F.concat(F.substring(account, 5, 40), F.substring(account, 1, 4))
    codes = F.transform(F.sequence(F.lit(1), F.length(moved)), lambda i: F.ascii(F.substring(moved, i, F.lit(1))))
    rest = F.aggregate(codes, F.lit(0), lambda acc, c: F.when(c >= 65, acc * 100 + c - 55).otherwise(acc * 10 + c - 48) % 97)
    return rest == 1


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(_IP)
    if kind == "card":
        digits = F.replace(hit, F.lit(SEP), F.lit(""))
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(hit, "[^0-9]", "")).between(10, 15)
    if kind == "iban":
        account = F.replace(hit, F.lit(" "), F.lit(""))
        return F.when(F.length(account).between(15, 34), _mod97(account)).otherwise(False)
    return F.lit(True)


def _proposed(hits: Column, gaps: Column) -> Column:
    """Matches with their starts: the gaps before and between them are what splitting leaves."""
    empty = F.expr("cast(array() as array<struct<start: int, hit: string>>)")
    first = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc, pair):
        start = acc["at"] + F.length(pair["gap"])
        found = F.struct(start.alias("start"), pair["hit"].alias("hit"))
        return F.struct((start + F.length(pair["hit"])).alias("at"), F.array_append(acc["out"], found).alias("out"))

    pairs = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
    return F.when(F.size(hits) > 0, F.aggregate(pairs, first, step, lambda acc: acc["out"])).otherwise(empty)


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """Adds `out`: array of (start, rank, kind, end, score) sorted by start and kind, end exclusive.

    Kinds are those of KINDS; `rank` is the kind's place there. Values that fail their check are
    dropped without a second try at a shorter match. Scores lie in 0 to 1.
    """
    plain, dotted, joined = "__pii_text", "__pii_dot", "__pii_num"
    source = {"email": dotted, "card": joined}
    kept = docs.columns
    t = F.col(plain)
    clean = F.replace(F.replace(t, F.lit(DOT), F.lit(OTHER)), F.lit(SEP), F.lit(OTHER))
    df = docs.withColumn(plain, text_of(F.col(f"`{text}`")))
    df = df.select("*", t.contains("@").alias("__at"), t.contains("+").alias("__plus"), t.rlike("[0-9]").alias("__digit"))
    df = df.select(
        "*",
        F.when(F.col("__at"), F.regexp_replace(clean, rf"(?<=[{_LABEL}])\.(?=[{_LABEL}])", DOT)).alias(dotted),
        F.when(F.col("__digit"), F.regexp_replace(clean, "(?<=[0-9])[ -](?=[0-9])", SEP)).alias(joined),
    )
    gate = {"email": "__at", "phone": "__plus"}
    no_hits = F.expr("cast(array() as array<string>)")

    def when_possible(kind, value):
        return F.when(F.col(gate.get(kind, "__digit")), value).otherwise(no_hits)

    df = df.select("*", *[
        when_possible(k, F.regexp_extract_all(F.col(source.get(k, plain)), F.lit(PATTERNS[k]), F.lit(0))).alias(f"__hits_{k}")
        for k in KINDS])
    df = df.select("*", *[
        F.when(F.size(f"__hits_{k}") > 0, F.split(F.col(source.get(k, plain)), PATTERNS[k], -1)).otherwise(no_hits).alias(f"__gaps_{k}")
        for k in KINDS])
    df = df.select("*", *[_proposed(F.col(f"__hits_{k}"), F.col(f"__gaps_{k}")).alias(f"__found_{k}") for k in KINDS])

    def scored(kind):
        def one(x):
            left = F.greatest(x["start"] - CONTEXT_CHARS, F.lit(0))
            end = x["start"] + F.length(x["hit"])
            around = F.concat(F.substring(t, left + 1, x["start"] - left), F.lit(" "), F.substring(t, end + 1, F.lit(CONTEXT_CHARS)))
            bonus = F.when(F.lower(around).rlike(CONTEXT[kind]), CONTEXT_BONUS).otherwise(0.0)
            return F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"),
                            end.alias("end"), F.least(F.lit(1.0), F.lit(SCORES[kind]) + bonus).alias("score"))

        good = F.filter(F.col(f"__found_{kind}"), lambda x: _valid(kind, x["hit"]))
        return F.filter(F.transform(good, one), lambda x: x["score"] >= THRESHOLD)

    spans = F.array_sort(F.concat(*[scored(k) for k in KINDS]))
    return df.select(*[F.col(f"`{c}`") for c in kept if c != out], spans.alias(out))


def span_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """One row per input row with counts of the base kinds, a digest of their spans, and all spans."""
    found = find_pii(docs.select("doc_id", "text"))
    spans = F.col("pii")

    def of(kind):
        return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    count = [of(k) for k in KINDS]
    base = F.filter(spans, lambda x: x["rank"] < len(BASE_KINDS))
    return found.select("doc_id", *count[:4], F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"),
                        span_text(spans).alias("spans"), *count[4:])
