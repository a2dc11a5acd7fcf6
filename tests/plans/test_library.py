import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions import values
from tidemill.operators import analytics, commands
from tidemill.plans import dataflow
from tidemill.sources.config import read_config
from tidemill.sources.csv_fixtures import read_seed
from tidemill.sources.fixtures import NOW_US, Fixtures
from tidemill.streaming import ledger_stream


def test_canonical_text_keeps_numbers_and_orders_keys():
    assert values.canonical(values.load(' {"b": [1, 1.0, 1e3], "a": {"é": null, "z": true}} ')) == '{"a":{"z":true,"é":null},"b":[1,1.0,1e3]}'
    for bad in ('{"a":1,"a":2}', '{"x":{"a":1,"a":1}}', "[NaN]", "{", "Infinity"):
        with pytest.raises(ValueError):
            values.load(bad)


def test_type_codes_and_exact_validation():
    t = {"n": "int", "f": ("optional", "float"), "tags": [("optional", "string")]}
    assert values.type_code(t) == "O{1:fo(f);1:ni;4:tagsa(o(s));}"
    ok = lambda text: values.check(values.load(text), t)
    assert ok('{"n":1,"tags":[null,"x"]}') is None and ok('{"n":1,"f":1.5,"tags":[]}') is None
    assert ok('{"n":1.0,"tags":[]}') == "value.n: not int" and ok('{"n":1,"f":1,"tags":[]}') == "value.f: not float"
    assert ok('{"n":9223372036854775808,"tags":[]}') == "value.n: not int" and ok('{"n":1,"f":1e400,"tags":[]}') == "value.f: not float"
    assert ok('{"n":1,"tags":[1]}') == "value.tags[0]: not string" and ok('{"n":1}') == "value.tags: missing" and ok('{"n":1,"tags":[],"q":1}') == "value.q: not declared"
    assert values.to_spark({"a": "int", "b": ("optional", "string")}) == T.StructType([T.StructField("a", T.LongType(), False), T.StructField("b", T.StringType(), True)])


def interpret(graph, at, args, results, local):
    """The graph's meaning for one instance, in plain Python."""
    value = lambda e: e[1] if e[0] == "const" else args[e[1][0]] if e[0] == "arg" else results.get(e[1]) if e[0] == "result" else local[e[1]]
    came = None
    while True:
        node = graph[at]
        kind = node["kind"]
        if kind == "op":
            if results.get(at) is None:
                v = value(node["input"])
                return ("need_operation", at, str(v)) if v is not None else ("fault", at, None)
            came, at = at, node["next"]
        elif kind == "let":
            local = local | {node["name"]: value(node["value"])}
            if local[node["name"]] is None:
                return ("fault", at, None)
            came, at = at, node["next"]
        elif kind == "if":
            on = value(node["on"])
            if on is None:
                return ("fault", at, None)
            came, at = at, node["then"] if on else node["else"]
        elif kind == "case":
            on = value(node["on"])
            if on is None:
                return ("fault", at, None)
            came, at = at, dict(node["arms"]).get(on, node["default"])
        elif kind == "merge":
            local = local | {node["name"]: value(node["from"][came])}
            came, at = at, node["next"]
        elif kind == "return":
            v = value(node["value"])
            return ("completed", at, None if v is None else str(v))
        else:
            v = value(node["reason"])
            return ("fail", at, v if v and len(v.encode()) <= dataflow.REASON_BYTES else "invalid_fail_reason")


def test_compiled_graph_equals_an_interpreter(spark):
    rng = random.Random(5)
    pick = lambda *xs: rng.choice(xs)
    rows = [(i, pick("1-URGENT", "2-HIGH", "x", None), pick(True, False, None), pick("no", "é" * 95, "é" * 96, "", None), pick(None, 7), pick(None, 8), pick(None, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "key long, priority string, rich boolean, reason string, r1 long, r2 long, r6 long")
    scope = dataflow.Scope({c: F.col(c) for c in ("priority", "key", "rich", "reason")}, {"n1": F.col("r1"), "n2": F.col("r2"), "n6": F.col("r6")})
    settled = {f"n{k}": F.col(f"r{k}").isNotNull() for k in (1, 2, 6)}
    for r in df.select("*", dataflow.compile_graph(dataflow.CHECKOUT, "n0", scope, settled).alias("o")).collect():
        expected = interpret(dataflow.CHECKOUT, "n0", {"priority": r.priority, "key": r.key, "rich": r.rich, "reason": r.reason}, {"n1": r.r1, "n2": r.r2, "n6": r.r6}, {})
        assert tuple(r.o) == expected


def test_verdict_precedence(spark, monkeypatch):
    """A row per verdict: each condition that comes first hides those that come later."""
    later, before = NOW_US + 1, NOW_US - 1
    # id, state, owner, expires, next attempt
    flows = [(1, 4, 9, later, later), (2, 3, 9, later, later), (3, 1, 9, later, later), (4, 1, 9, NOW_US, later), (5, 2, None, None, later), (6, 1, None, None, later), (7, 1, None, None, later), (8, 1, None, None, before), (40, 1, None, None, later)]
    fx = Fixtures(spark, "none")
    fx.__dict__["workflow"] = spark.createDataFrame([(i, "s", s, o, e, n) for i, s, o, e, n in flows], "workflow_id long, script_name string, state int, lease_owner long, lease_expires_us long, next_attempt_us long")
    carrier = "workflow_id long, operation_seq int, seq int, status int, reversal_state int, reconcile_attempts int, reconcile_first_us long, redispatch_count int, redispatch_first_us long"
    carriers = [(i, 1, 1, 2, 1, 1, None, 1, None) for i in (1, 2, 3, 4, 5)] + [(6, 1, 1, 2, 1, 1, 5, 0, None)]
    fx.__dict__["operation"] = spark.createDataFrame(carriers, carrier)
    fx.__dict__["checkpoint"] = spark.createDataFrame([], carrier)
    fx.__dict__["call"] = spark.createDataFrame([(4, 2, 40), (4, 1, 1), (3, 1, 40)], "workflow_id long, operation_seq int, child_id long")
    got = {r.workflow_id: (r.verdict, r.path, r.end_verdict) for r in analytics.verdicts(fx).collect()}
    assert [got[i][0] for i in range(1, 9)] == ["terminal", "blocked_resolution", "running_under_lease", "waiting_on_child", "redispatch_pending", "reconcile_pending", "scheduled_retry", "claimable_now"]
    assert got[4][1:] == ([4, 40], "scheduled_retry")


def test_every_procedure_reaches_its_outcomes(spark):
    """The fixture reaches most outcomes of every procedure, so that the oracle comparison means something."""
    fx = Fixtures(spark, "/root/testdata/sf0.01")
    for name in ("op_settle", "begin_reversal", "reverse_settle", "heartbeat", "claim_by_id"):
        rules, otherwise = commands.RULES[name]
        seen = {r.outcome for r in commands.decide(commands.context(fx, commands.NEEDS[name]), name).select("outcome").distinct().collect()}
        assert len(seen) >= 0.6 * len({o for _, o in rules} | {otherwise}), (name, seen)


def test_search_needs_its_bounds(spark):
    with pytest.raises(ValueError):
        analytics.search(Fixtures(spark, "none"), "x", None, 1)


def test_csv_seed(spark, tmp_path):
    (tmp_path / "seed.csv").write_text('# a comment\nid,name,doc\n00ff,"x","{""a"":1}"\n0100,\\N,\\N\n')
    schema = T.StructType([T.StructField("id", T.BinaryType()), T.StructField("name", T.StringType()), T.StructField("doc", T.StringType())])
    rows = read_seed(spark, str(tmp_path / "seed.csv"), schema).orderBy("id").collect()
    assert [(bytes(r.id), r.name, r.doc) for r in rows] == [(b"\x00\xff", "x", '{"a":1}'), (b"\x01\x00", None, None)]


def test_config(spark):
    text = '{"deployment":{"participants":{"stock":{}},"operations":{"reserve":{"participant":"stock","compensation":"release"},"release":{"participant":"stock"}}},"scripts":[{"name":"a","version":"1.0.0"}]}'
    config = read_config(spark, text)
    assert {tuple(r) for r in config.operations.collect()} == {("reserve", "stock", "release"), ("release", "stock", None)}
    for bad in (text.replace("1.0.0", "1.0"), text.replace('"participant":"stock"}', '"participant":"none"}'), text.replace('"release"}', '"gone"}')):
        with pytest.raises(ValueError):
            read_config(spark, bad)


def test_stream_folds_like_the_batch(spark, tmp_path):
    fx = Fixtures(spark, "/root/testdata/sf0.001")
    events = fx.ledger_history.select("item_key", "event_us", "event_type", "status", F.when(F.col("event_type") == 10, F.col("lease_token")).otherwise(F.lit(-7)).cast("long").alias("lease_token"), "seq")
    # every later event comes from whoever claimed last
    from pyspark.sql import Window

    holder = F.last(F.when(F.col("event_type") == 10, F.col("lease_token")), ignorenulls=True).over(Window.partitionBy("item_key").orderBy("seq"))
    events = events.withColumn("lease_token", holder).drop("seq")
    late = events.limit(5).select("item_key", F.lit(0).cast("long").alias("event_us"), F.lit(10).alias("event_type"), F.lit(1).alias("status"), F.lit(1).cast("long").alias("lease_token"))
    folder = str(tmp_path / "events")
    events.coalesce(1).write.parquet(folder)

    def run():
        stream = ledger_stream.fold(spark.readStream.schema(ledger_stream.EVENT).parquet(folder))
        writer = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True)
        writer.start().awaitTermination()

    run()
    late.coalesce(1).write.mode("append").parquet(folder)
    run()  # goes on from the checkpoint
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.where("accepted").count() == events.count()
    assert {r.reason for r in out.where("NOT accepted").collect()} <= {"event_time_skew", "terminal"} and out.where("NOT accepted").count() == 5
    final = out.where("accepted").groupBy("item_key").agg(F.max_by(F.struct("event_us", "status", "n_events"), "event_us").alias("s")).select("item_key", "s.*")
    batch = fx.ledger_history.groupBy("item_key").agg(F.max("event_us").alias("event_us"), F.max_by("status", "seq").alias("status"), F.count(F.lit(1)).alias("n_events"))
    assert sorted(map(tuple, final.collect())) == sorted(map(tuple, batch.collect()))


def test_sinks(spark, tmp_path):
    from tidemill.sources import sinks

    log = str(tmp_path / "log")
    held = spark.createDataFrame([(1, 0)], "k long, at long")
    sinks.append(held, log)
    offered = spark.createDataFrame([(1, 5), (2, 6), (2, 5), (3, 1)], "k long, at long")
    told = {(r.k, r.at): r.outcome for r in sinks.create(offered, held, "k", "at", log).collect()}
    assert told == {(1, 5): "exists", (2, 5): "created", (2, 6): "exists", (3, 1): "created"}
    assert {tuple(r) for r in spark.read.parquet(log).collect()} == {(1, 0), (2, 5), (3, 1)}
    for _ in range(2):  # the second run finds nothing new
        sinks.stream(spark.readStream.schema("k long, at long").parquet(log), str(tmp_path / "copy"), str(tmp_path / "at")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "copy")).count() == 3
