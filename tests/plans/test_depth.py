"""Walks beyond the fixture's own depth, timers, guards and orders."""

import datetime
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.operators import analytics, commands
from tidemill.plans import graph
from tidemill.sources import sinks
from tidemill.sources.fixtures import NOW_US, Fixtures
from tidemill.streaming import due_stream, ledger_stream


def chain(spark, n, back=None):
    """Fixture tables of one chain of n calls; ``back`` adds a call from the last to that one."""
    fx = Fixtures(spark, "none")
    flow = "workflow_id long, script_name string, state int, lease_owner long, lease_expires_us long, next_attempt_us long, parent_id long"
    fx.__dict__["workflow"] = spark.createDataFrame([(i, "s", 1, None, None, NOW_US + 1, i - 1 if i else None) for i in range(n)], flow)
    calls = [(i, 1, i + 1, 1) for i in range(n - 1)] + ([(n - 1, 1, back, 1)] if back is not None else [])
    fx.__dict__["call"] = spark.createDataFrame(calls, "workflow_id long, operation_seq int, child_id long, child_status int")
    carrier = "workflow_id long, operation_seq int, seq int, operation_name string, status int, reversal_state int, reconcile_attempts int, reconcile_first_us long, redispatch_count int, redispatch_first_us long"
    fx.__dict__["operation"] = fx.__dict__["checkpoint"] = spark.createDataFrame([], carrier)
    fx.__dict__["event"] = spark.createDataFrame([(0, 5, 1, "k")], "workflow_id long, event_us long, event_id long, kind string")
    return fx


def test_waits_are_followed_to_their_end(spark):
    got = {r.workflow_id: r for r in analytics.verdicts(chain(spark, 24)).collect()}
    assert got[0].path == list(range(24)) and got[0].end_verdict == "scheduled_retry" and got[23].verdict == "scheduled_retry"
    got = {r.workflow_id: r for r in analytics.verdicts(chain(spark, 5, back=0)).collect()}
    assert got[0].path == [0, 1, 2, 3, 4] and got[3].path == [3, 4, 0, 1, 2] and got[3].end_verdict == "waiting_on_child"


def test_ancestors_go_up_to_the_root(spark):
    rows = commands.ancestors(chain(spark, 20).workflow.select("workflow_id", "parent_id")).collect()
    assert sorted((r.at, r.hops) for r in rows if r.workflow_id == 19) == [(i, 19 - i) for i in range(20)] and len(rows) == 20 * 21 // 2


def test_documents_have_bounds_and_stubs(spark):
    one = analytics.inspect(chain(spark, 4), 2).collect()
    assert len(one) == 1 and one[0].document.count('"workflow_id":') == 3 and '"children":[{"child_workflow_id":3,"truncated":true}]' in one[0].document
    assert '"events":[{"at":5,"kind":"k"}]' in one[0].document
    two = analytics.inspect(chain(spark, 3, back=0), 9).collect()[0].document
    assert two.count('"workflow_id":') == 3 and '{"child_workflow_id":0,"cycle_detected":true}' in two


def test_closure_is_not_bounded(spark):
    rng = random.Random(3)
    edges = [(p, i, i + 1) for p in (1, 2) for i in range(1, 70)] + [(2, 70, 35), (3, 1, 2), (3, 2, 4), (3, 1, 4), (3, 4, 9)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "plan long, source long, target long")
    assert [r.plan for r in graph.cyclic(df).collect()] == [2]
    far = {(r.plan, r.node): (r.longest, r.shortest) for r in graph.from_entry(df).collect()}
    assert far[1, 70] == (69, 69) and far[3, 9] == (3, 2) and not any(p == 2 for p, _ in far)


def counted(monkeypatch, module):
    """Rows of the tables that a module writes from now on."""
    rows, write = [], module.written
    monkeypatch.setattr(module, "written", lambda df, name: rows.append(df.count()) or write(df, name))
    return rows


def test_walks_of_plans_write_no_paths(spark, monkeypatch):
    edges = spark.createDataFrame([(p, i, i + 1) for p in range(3) for i in range(1, 70)], "plan long, source long, target long")
    rows = counted(monkeypatch, graph)
    assert graph.cyclic(edges).count() == 0 and graph.from_entry(edges).count() == 3 * 70
    assert sum(rows) <= 3 * 69


def test_large_plans_are_walked_by_joins_to_the_same_end(spark):
    rng = random.Random(11)
    edges = [(p, *(rng.sample(range(1, 9), 2) if p % 2 else sorted(rng.sample(range(1, 9), 2)))) for p in range(12) for _ in range(2 + p)] + [(20, 1, 1), (21, 5, 6)]
    df = spark.createDataFrame(edges, "plan long, source long, target long")
    for build in (graph.cyclic, graph.from_entry, graph.from_first):
        whole = sorted(map(tuple, build(df).collect()))
        assert whole and sorted(map(tuple, build(df, 6).collect())) == whole == sorted(map(tuple, build(df, 0).collect())), build
    ends = {p: {1} for p, s, _ in edges if s == 1}
    for _ in edges:
        for p, s, t in edges:
            if s in ends.get(p, ()):
                ends[p].add(t)
    assert {r.plan: r.n for r in graph.from_first(df).collect()} == {p: len(found) for p, found in ends.items()}


def test_edges_of_one_file_are_dealt_to_several_tasks(spark, tmp_path):
    spark.range(0, 4000).selectExpr("id AS c_custkey").coalesce(1).write.parquet(f"file://{tmp_path}/customer.parquet")
    chain = graph.plans(Fixtures(spark, f"file://{tmp_path}")).where("target = source + 1").withColumn("task", F.spark_partition_id())
    rows = [r["count"] for r in chain.groupBy("task").count().collect()]
    assert len(rows) > 1 and max(rows) < 0.6 * sum(rows)


def test_more_customers_are_dealt_to_more_tasks(spark, tmp_path):
    spark.range(0, 200_000).selectExpr("id AS c_custkey").write.parquet(f"file://{tmp_path}/customer.parquet")
    first = graph.plans(Fixtures(spark, f"file://{tmp_path}")).where("source = 1 AND target = 2").withColumn("task", F.spark_partition_id())
    rows = [r["count"] for r in first.groupBy("task").count().collect()]
    assert sum(rows) == 200_000 and max(rows) < 1.3 * graph.DEALT


def test_nodes_are_not_broadcast(spark):
    plan = graph.graph_dangling(Fixtures(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.fixture
def merged(spark):
    """No broadcasts and no adaptive steps, as tables of any size are joined."""
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    held = {name: spark.conf.get(name) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    yield spark
    for name, value in held.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize("name", ["child_settle", "child_reopen"])
def test_commands_without_a_child_do_not_meet_in_one_task(merged, name):
    df = commands.context(Fixtures(merged, "/root/testdata/sf0.001"), commands.NEEDS[name])
    rows = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert max(rows) < 0.5 * sum(rows)


def test_commands_are_dealt_by_workflow_alone(merged):
    for name in ("call_submit_guard", "child_settle", "op_request"):
        plan = commands.context(Fixtures(merged, "/root/testdata/sf0.001"), commands.NEEDS[name])._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(workflow_id" in plan and not re.search(r"hashpartitioning\(\w+#\d+L?, (seq|_at)#", plan), name


def test_operations_are_dealt_once(merged):
    """One scan numbers them for a command's place and the one before, and nothing deals them again after that."""
    for name in ("call_submit_guard", "op_request"):
        plan = commands.context(Fixtures(merged, "/root/testdata/sf0.001"), commands.NEEDS[name])._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Window [row_number()") == 1 == sum("FileScan" in line and "l_linenumber" in line for line in plan.splitlines()), name
        assert plan.count("Exchange hashpartitioning(_of#") == ("call" in commands.NEEDS[name]), name


def test_places_beyond_gaps_and_ends_find_what_is_before(spark):
    held = {1: [1, 2, 4], 2: [3]}
    ops = spark.createDataFrame([(w, s, w * 100 + s, s % 2) for w, seqs in held.items() for s in seqs], "workflow_id long, seq int, o_id long, o_status int")
    asked = spark.createDataFrame([(w, s) for w in (1, 2, 3) for s in range(7)], "workflow_id long, seq int")
    rows = commands._at_or_after(asked, ops).collect()
    want = {(w, s): (w * 100 + s if s in held.get(w, ()) else None, (s - 1) % 2 if s - 1 in held.get(w, ()) else None) for w in (1, 2, 3) for s in range(7)}
    assert len(rows) == len(want) and {(r.workflow_id, r.seq): (r.o_id, r.before_status) for r in rows} == want


def test_documents_derive_calls_once(spark, monkeypatch):
    plans, write = {}, analytics.written
    monkeypatch.setattr(analytics, "written", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and write(df, name))
    analytics.inspect(Fixtures(spark, "/root/testdata/sf0.001"), 1)
    assert plans["documents"].count("lineitem.parquet") == 2


def test_clock_guard(spark):
    analytics.assert_utc(spark)
    held = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone, sound in (("Etc/UTC", True), ("UTC", True), ("America/New_York", False), ("+02:00", False)):
            spark.conf.set("spark.sql.session.timeZone", zone)
            if sound:
                analytics.assert_utc(spark)
            else:
                with pytest.raises(ValueError):
                    analytics.assert_utc(spark)
    finally:
        spark.conf.set("spark.sql.session.timeZone", held)


def test_created_rows_are_those_that_are_told(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5, c) for c in "cab"] + [(2, 1, "z"), (3, 1, "y")], "id long, at long, name string").repartition(3)
    held = spark.createDataFrame([(3, 0, "old")], rows.schema)
    told = sinks.create(rows, held, "id", "at", str(tmp_path / "log"))
    created = {(r.id, r.name) for r in told.collect() if r.outcome == "created"}
    assert created == {(1, "a"), (2, "z")} == {(r.id, r.name) for r in spark.read.parquet(str(tmp_path / "log")).collect()}


def streamed(spark, tmp_path, name, schema, files, build):
    """The rows of a stream over files that come one after the other."""
    folder = tmp_path / name
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{folder}/{i:03d}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}/*")
    query = build(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-at")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_workflows_come_out_when_they_are_due(spark, tmp_path):
    at = lambda s: datetime.datetime(2020, 1, 1) + datetime.timedelta(seconds=s)
    us = lambda s: int(pd.Timestamp(at(s)).value // 1000)
    files = [
        [(1, at(0), us(10)), (2, at(0), us(100)), (3, at(0), us(10)), (4, at(1), us(20)), (4, at(0), us(500))],
        [(3, at(2), None), (2, at(3), us(30))],
        [(9, at(60), us(900))],
        [(9, at(61), us(900))],
        [(9, at(62), us(900))],
    ]
    rows = streamed(spark, tmp_path, "due", due_stream.UPDATE, files, due_stream.due)
    assert sorted((r.workflow_id, r.due_us) for r in rows) == [(1, us(10)), (2, us(30)), (4, us(20))]


def test_events_of_several_arrow_batches_are_put_in_order(spark, tmp_path):
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        events = [(1, 1, 10, 1, 5)] + [(1, i, 11, 1, 5) for i in range(2, 60)]
        random.Random(2).shuffle(events)
        rows = streamed(spark, tmp_path, "ordered", ledger_stream.EVENT, [events], ledger_stream.fold)
        assert len(rows) == 59 and all(r.accepted for r in rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
