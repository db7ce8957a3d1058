"""The driver's tables seen as event logs, scores and attributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.order import core_columns, order_events
from tracewell.operators.population import case_outcomes, eligibility, safe_prefix
from tracewell.sources.logs import normalize_log
from tracewell.spec import LogSpec, OutcomeSpec

# L1: sessions of a user as cases, thresholds on value as outcomes.
L1_K = 3
L1_OUTCOMES = OutcomeSpec({"purchase_hi": 1, "error_hi": 0})
L1_SPEC = LogSpec(
    case="case_no", activity="act", ts="ts", order_key="event_id",
    static_cols=("segment", "credit_limit"),
    event_cols=("event_type", "value", "resource", "k_bucket", "amount", "rating", "item_id",
                "accepted", "selected"),
)
L1_STATIC = ["segment", "credit_limit"]
L1_COUNT_MAPS = {"activity": "activity", "event_type": "event_type", "resource": "resource", "k_bucket": "k_bucket"}
L1_SPARSE = ["amount", "rating", "item_id", "accepted", "selected"]
L1_CREATE = "purchase"
L1_LINK = "view"
L1_STATES = {"click": "click", "view": "view", "signup": "signup"}

# L2: a customer's orders as a case.
L2_K = 5
L2_SPEC = LogSpec(
    case="o_custkey", activity="o_orderstatus", ts="o_orderdate", order_key="o_orderkey",
    static_cols=("c_mktsegment", "c_acctbal"), event_cols=("o_orderpriority", "o_totalprice"),
)
L2_STATIC = ["c_mktsegment", "c_acctbal"]
PRIORITY_GROUPS = {"1": "Urgent", "2": "High", "3": "Medium"}

WINDOWS = ["T1", "T2", "T3"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome log from `events`; attributes are null where their event type does not carry them."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    kind = F.col("event_type")

    def only(types: list[str], value: Column) -> Column:
        return F.when(kind.isin(types), value)

    day = F.datediff(F.col("ts"), F.lit("2024-01-01"))
    source = e.select(
        "event_id", "ts", "event_type", "value",
        (F.col("user_id") * 10 + F.least(F.lit(9), F.floor(day / 3))).alias("case_no"),
        F.when((kind == "purchase") & (F.col("value") >= 60), "purchase_hi")
        .when((kind == "error") & (F.col("value") >= 100), "error_hi")
        .otherwise(kind).alias("act"),
        F.concat(F.lit("S"), (F.col("user_id") % 4).cast("string")).alias("segment"),
        ((F.col("user_id") * 37 % 500) * 10).cast("double").alias("credit_limit"),
        F.concat(F.lit("R"), F.lpad((F.col("k") % 12).cast("string"), 2, "0")).alias("resource"),
        F.concat(F.lit("K"), F.floor(F.col("k") / 20).cast("string")).alias("k_bucket"),
        only(["purchase"], F.col("value")).alias("amount"),
        only(["click"], F.col("k").cast("double")).alias("rating"),
        only(["click", "view", "signup"], F.concat(F.lit("I"), (F.col("k") % 3).cast("string"))).alias("item_id"),
        only(["purchase"], F.when(F.col("k") % 2 == 0, "yes").otherwise("no")).alias("accepted"),
        only(["purchase"], F.when(F.col("k") % 3 == 0, "yes").otherwise("no")).alias("selected"),
    )
    return normalize_log(source, L1_SPEC)


def l1_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_events(l1(spark, sf_dir))


def flags(ordered: DataFrame) -> DataFrame:
    """Case labels with the eligibility flags."""
    return eligibility(case_outcomes(ordered, L1_OUTCOMES), L1_K)


def l1_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags(order_events(core_columns(l1(spark, sf_dir))))


def l1_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return safe_prefix(l1(spark, sf_dir), l1_cases(spark, sf_dir), L1_K)


def l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order log from `orders`, with customer attributes on every event."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    o = table(spark, sf_dir, "orders")
    return normalize_log(o.join(c, o.o_custkey == c.c_custkey), L2_SPEC)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1: scored binary labels with heavy ties at 1.0, grouped by source or language."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    y = table(spark, sf_dir, "labels").select("doc_id", "quality")
    score = F.least(F.col("n_chars"), F.lit(3000)) / F.lit(3000.0)
    return d.join(y, "doc_id").select(
        F.col("doc_id").alias("case_id"),
        F.col("quality").alias("y_true"),
        (score > 0.5).cast("int").alias("y_pred"),
        score.alias("y_prob"),
        "source",
        "lang",
    )


def attributions(spark: SparkSession, sf_dir: str, windows: DataFrame | None = None) -> DataFrame:
    """A1: one row per (case, feature) with its contribution, and the case's window where given.

    Windows join the cases before they are spread to features.
    """
    e = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "case_id")
    e = e.join(windows, "case_id") if windows is not None else e
    own = [c for c in ("window",) if windows is not None]
    return e.select("case_id", *own, F.posexplode("embedding").alias("i", "x")).select(
        "case_id", *own,
        F.concat(F.lit("f"), F.lpad(F.col("i").cast("string"), 2, "0")).alias("feature"),
        F.col("x").cast("double").alias("shap_value"),
    )
