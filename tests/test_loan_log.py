"""A hand-written loan log from an XES document to case features, with the preset's names."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tracewell import presets as L
from tracewell.operators import availability as A
from tracewell.operators import encode as N
from tracewell.operators import features as X
from tracewell.operators import population as P
from tracewell.operators.attribution import feature_groups
from tracewell.operators.order import order_events
from tracewell.sources.logs import normalize_log, with_source_names
from tracewell.sources.xes import read_xes, write_xes

OFFER = '<float key="OfferedAmount" value="{a}"/><string key="Accepted" value="true"/><string key="Selected" value="false"/>'


def event(i, activity, extra=""):
    return (
        f'<event><string key="concept:name" value="{activity}"/><date key="time:timestamp" '
        f'value="2016-01-0{i // 20 + 1}T09:{i % 20:02d}:00.000+00:00"/><string key="EventID" value="E{i}"/>'
        f'<string key="org:resource" value="User_{i % 2}"/><string key="Action" value="Created"/>'
        f'<string key="EventOrigin" value="Application"/><string key="lifecycle:transition" value="complete"/>{extra}</event>'
    )


def trace(name, start, goal, n, outcome):
    acts = ["A_Create Application", "O_Create Offer", "O_Created"] + ["W_Handle leads"] * (n - 3) + [outcome]
    body = "".join(
        event(start + i, a, OFFER.format(a=100 + i) if a == "O_Create Offer" else
              f'<string key="OfferID" value="O{start}"/>' if a == "O_Created" else "")
        for i, a in enumerate(acts)
    )
    return (f'<trace><string key="concept:name" value="{name}"/><string key="LoanGoal" value="{goal}"/>'
            f'<string key="ApplicationType" value="New credit"/><float key="RequestedAmount" value="0"/>{body}</trace>')


@pytest.fixture(scope="module")
def log(spark):
    folder = tempfile.mkdtemp(prefix="tracewell-xes-")
    doc = ('<?xml version="1.0" encoding="UTF-8"?>\n<log xes.version="1.0">' + trace("App_1", 0, "Car &amp; boat", 12, "A_Pending")
           + "\n" + trace("App_2", 20, "Other, see explanation", 10, "A_Denied") + trace("App_3", 40, "Car", 5, "A_Cancelled") + "</log>")
    with open(os.path.join(folder, "log.xes"), "w") as f:
        f.write(doc)
    case = {"LoanGoal": "string", "ApplicationType": "string", "RequestedAmount": "double"}
    sparse = {c: "string" for c in L.OFFER_ATTRIBUTES} | {"OfferedAmount": "double"}
    raw = read_xes(spark, folder, case, {"EventID": "string", **{c: "string" for c in L.EVENT_ATTRIBUTES}, **sparse})
    named = raw.withColumnsRenamed({"case_id": "case:concept:name", "activity": "concept:name", "ts": "time:timestamp",
                                    **{c: f"case:{c}" for c in case}})
    return normalize_log(named, L.LOAN_LOG, strict=True).cache()


def test_ingest(log):
    assert log.count() == 13 + 11 + 6
    first = log.orderBy("ts").first()
    assert first.activity == "A_Create Application" and first["case:LoanGoal"] == "Car & boat"
    assert first.ts == dt.datetime(2016, 1, 1, 9, 0) and first["case:RequestedAmount"] == 0.0 and first.OfferID is None


def test_features_and_dictionary(spark, log):
    flags = P.eligibility(P.case_outcomes(order_events(log), L.LOAN_OUTCOMES, strict=True), L.LOAN_K)
    assert {r.case_id for r in flags.filter("eligible").collect()} == {"App_1", "App_2"}
    feats = X.case_features(P.safe_prefix(log, flags, L.LOAN_K, carry=("target",)), L.LOAN_FEATURES)
    assert set(L.LOAN_ENCODING.maps) == {"activity_counts", "action_counts", "event_origin_counts", "resource_counts",
                                         "lifecycle_transition_counts"} <= set(feats.columns)
    dic = N.vocabulary_fit(feats, L.LOAN_ENCODING)
    rows = [r.feature_name for r in dic.orderBy("feature_index").collect()]
    assert rows[:7] == ["requested_amount", "n_unique_activities", "n_unique_resources", "prefix_duration_seconds",
                        "mean_event_gap_seconds", "loan_goal_Car & boat", "loan_goal_Other, see explanation"]
    assert rows[7:10] == ["application_type_New credit", "action::Created", "activity::A_Create Application"]
    groups = feature_groups(dic, L.FEATURE_GROUPS, L.FEATURE_PREFIXES, strict=True)
    assert groups.filter("group = 'LoanGoal'").count() == 2


def test_availability_matrix_and_policy(spark, log):
    ordered = order_events(log)
    flags = P.eligibility(P.case_outcomes(ordered, L.LOAN_OUTCOMES), L.LOAN_K)
    elog, prefix = A.eligible_log(ordered, flags), P.safe_prefix(log, flags, L.LOAN_K)
    case = A.case_attr_availability(elog, list(L.CASE_ATTRIBUTES), L.LOAN_K)
    assert {r.zero_at_event_1 for r in case.filter("feature = 'case:RequestedAmount'").collect()} == {2}
    events = with_source_names(A.event_completeness(prefix, ["activity", "ts", *L.EVENT_ATTRIBUTES]), L.LOAN_LOG)
    ids = with_source_names(A.identifier_audit(prefix, ["EventID", "case_id"]), L.LOAN_LOG)
    sparse = A.sparse_availability(elog, list(L.OFFER_ATTRIBUTES), L.LOAN_K)
    matrix = A.availability_matrix({
        "case-level": case.select("feature", "available_by_k", "availability_percentage"),
        "event-process": events.select("feature", "cases_with_value", "case_coverage_percentage"),
        "offer-sparse": sparse.select("feature", "available_by_k", "available_by_k_pct"),
        "identifier": ids.select("feature", "cases_with_value", "case_coverage_percentage"),
    }, A.decision_table(spark, L.loan_decisions()), strict=True)
    counts = {r.availability_decision: r.features for r in A.decision_counts(matrix).collect()}
    assert counts == {"Available": 11, "Conditionally Available": 7, "Leakage Risk": 1}
    policy = {r.handling: r.n for r in A.feature_policy(matrix, L.HANDLING_POLICY, strict=True).groupBy("handling").agg(F.count("*").alias("n")).collect()}
    assert policy == {"raw_static": 3, "count_map": 5, "timing": 1, "identifier_only": 2, "conditional_omitted": 7,
                      "leakage_risk_omitted": 1}


def test_offer_links(log):
    ordered = order_events(log)
    linked = A.link_next_event(ordered, L.OFFER_CREATE, L.OFFER_CREATED, "OfferID", ["Selected"])
    assert sorted(r.linked_item for r in linked.collect()) == ["O0", "O20", "O40"]
    states = A.lifecycle_first_state(ordered, "OfferID", L.OFFER_STATES)
    assert states.count() == 0  # no later state occurs
    later = A.later_state(linked, states, "OfferID", list(L.OFFER_STATES.values()))
    assert later.filter("later_O_Sent").count() == 0 and later.count() == 3


def test_long_case_is_written_in_parts(spark, log, monkeypatch):
    import tracewell.sources.xes as xes
    from tracewell.session import scratch_path

    monkeypatch.setattr(xes, "EVENTS_PER_TRACE", 5)
    path = scratch_path(spark, "xes")
    write_xes(order_events(log), path, ["EventID"], [])
    back = read_xes(spark, path, {}, {"EventID": "string", "order_key": "int"})
    assert back.count() == log.count()
    assert back.select("case_id", "activity", "ts", "EventID").exceptAll(log.select("case_id", "activity", "ts", "EventID")).count() == 0
