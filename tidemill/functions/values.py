"""The value model: strict JSON, canonical text, identities, guards, and the participants' small functions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.plans.catalog import query
from tidemill.sources.fixtures import Fixtures


def strict_object(text: Column) -> Column:
    """Whether a text is a JSON object without a repeated key at any depth."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))


_PROBES = "(SELECT event_id, CASE CAST(event_id % 6 AS INT) WHEN 0 THEN props WHEN 1 THEN '[' || props || ']' WHEN 2 THEN substr(props, 1, 4) WHEN 3 THEN '\"text\"' WHEN 4 THEN NULL ELSE 'null' END AS doc FROM {events})"


@query("json_guard", f"SELECT event_id, doc IS NOT NULL AND coalesce(json_valid(doc), false) AND coalesce(CASE WHEN json_valid(doc) THEN json_type(doc) END = 'OBJECT', false) AS sound FROM {_PROBES}")
def json_guard(fx: Fixtures) -> DataFrame:
    """Which documents are JSON objects: arrays, scalars, broken and null ones are not."""
    k = F.col("event_id") % 6
    doc = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("["), F.col("props"), F.lit("]"))).when(k == 2, F.substring("props", 1, 4)).when(k == 3, '"text"').when(k == 4, F.lit(None).cast("string")).otherwise("null")
    return fx.events.select("event_id", strict_object(doc).alias("sound"))


@query("strict_json", "SELECT event_id, event_id % 3 = 0 AS sound FROM {events}")
def strict_json(fx: Fixtures) -> DataFrame:
    """Repeated keys, at any depth, make a document unsound."""
    k = F.col("event_id") % 3
    doc = F.when(k == 0, F.col("props")).when(k == 1, F.lit('{"a":1,"a":2}')).otherwise(F.lit('{"a":{"b":1,"b":2}}'))
    return fx.events.select("event_id", strict_object(doc).alias("sound"))


@query("json_path", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.absent') AS absent FROM {events}")
def json_path(fx: Fixtures) -> DataFrame:
    return fx.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.absent").alias("absent"))


@query("json_doc", "SELECT workflow_id, '{{\"id\":' || workflow_id || ',\"state\":' || state || CASE WHEN terminal_reason IS NULL THEN '' ELSE ',\"reason\":\"' || terminal_reason || '\"' END || '}}' AS doc FROM {workflow}")
def json_doc(fx: Fixtures) -> DataFrame:
    """Documents that leave out what does not apply."""
    return fx.workflow.select("workflow_id", F.to_json(F.struct(F.col("workflow_id").alias("id"), "state", F.col("terminal_reason").alias("reason"))).alias("doc"))


@query("hex_roundtrip", "SELECT workflow_id, lower(lpad(hex(workflow_id), 32, '0')) AS id_hex, CAST(16 AS INT) AS n_bytes FROM {workflow}")
def hex_roundtrip(fx: Fixtures) -> DataFrame:
    """Sixteen-byte ids and their rendering."""
    raw = F.unhex(F.lpad(F.hex("workflow_id"), 32, "0"))
    return fx.workflow.select("workflow_id", F.lower(F.hex(raw)).alias("id_hex"), F.octet_length(raw).alias("n_bytes"))


def uuid3(text: Column) -> Column:
    """MD5 of a text with the version and variant bits of a name-based UUID, as hex; there is no namespace."""
    h = F.md5(text)
    variant = F.element_at(F.split(F.lit("8,9,a,b"), ","), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1)
    return F.concat(F.substring(h, 1, 12), F.lit("3"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15))


def _uuid3_sql(text: str) -> str:
    return f"substr(md5({text}), 1, 12) || '3' || substr(md5({text}), 14, 3) || ['8', '9', 'a', 'b'][CAST('0x' || substr(md5({text}), 17, 1) AS INT) % 4 + 1] || substr(md5({text}), 18, 15)"


@query("uuid3", f"SELECT workflow_id, {_uuid3_sql('script_name')} AS id FROM {{workflow}}")
def uuid3_of_scripts(fx: Fixtures) -> DataFrame:
    return fx.workflow.select("workflow_id", uuid3(F.col("script_name")).alias("id"))


def joined(*parts: Column) -> Column:
    """Parts with their byte lengths in front, so that no two lists of parts read the same."""
    return F.concat(*[x for p in parts for x in (F.octet_length(p).cast("string"), F.lit(":"), p, F.lit(";"))])


#: Fixed tags that keep the spaces of identities apart.
OPERATION_TAG, CALL_TAG, REVERSE_TAG, INVOCATION_TAG = "mf-op;", "mf-call;", "reverse:1", "inv:1"

_OP_TEXT = "'mf-op;' || strlen(CAST(workflow_id AS VARCHAR)) || ':' || workflow_id || ';' || strlen(operation_name) || ':' || operation_name || ';' || strlen(CAST(operation_seq AS VARCHAR)) || ':' || operation_seq || ';'"


@query("op_identity", f"SELECT operation_id, {_uuid3_sql(_OP_TEXT)} AS identity FROM {{operation}}")
def op_identity(fx: Fixtures) -> DataFrame:
    """Deterministic operation ids, so that a repeated request is the same request."""
    text = F.concat(F.lit(OPERATION_TAG), joined(F.col("workflow_id").cast("string"), F.col("operation_name"), F.col("operation_seq").cast("string")))
    return fx.operation.select("operation_id", uuid3(text).alias("identity"))


_KEYED = "strlen(CAST({0} AS VARCHAR)) || ':' || {0} || ';'"
_NODE_SQL = "'mf-call;' || " + " || ".join(_KEYED.format(x) for x in ("c.workflow_id", "p.content_hash", "c.operation_seq"))
_BACK_SQL = " || ".join(_KEYED.format(x) for x in ("workflow_id", "1", "seq"))


@query("call_identity", f"SELECT c.child_id, {_uuid3_sql(_NODE_SQL)} AS identity FROM {{call}} c JOIN {{plan}} p ON p.workflow_id = c.workflow_id")
def call_identity(fx: Fixtures) -> DataFrame:
    """A called workflow's id, from its caller, the caller's plan and the place of the call; it is the caller's operation id too."""
    rows = fx.call.select("workflow_id", "operation_seq", "child_id").join(fx.plan.select("workflow_id", "content_hash"), "workflow_id")
    text = F.concat(F.lit(CALL_TAG), joined(F.col("workflow_id").cast("string"), F.col("content_hash"), F.col("operation_seq").cast("string")))
    return rows.select("child_id", uuid3(text).alias("identity"))


@query("reverse_identity", f"SELECT workflow_id, seq, {_uuid3_sql(_BACK_SQL + " || 'reverse:1'")} AS reverse_identity, {_uuid3_sql(_BACK_SQL + " || 'inv:1'")} AS identity FROM {{checkpoint}}")
def reverse_identity(fx: Fixtures) -> DataFrame:
    """Ids by position, of a compensation and of the operation that it undoes; a script's revision is 1."""
    place = joined(F.col("workflow_id").cast("string"), F.lit("1"), F.col("seq").cast("string"))
    return fx.checkpoint.select("workflow_id", "seq", uuid3(F.concat(place, F.lit(REVERSE_TAG))).alias("reverse_identity"), uuid3(F.concat(place, F.lit(INVOCATION_TAG))).alias("identity"))


@query("ts_render", "SELECT workflow_id, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS iso, strftime(created_at + INTERVAL 5 SECOND, '%Y-%m-%d %H:%M:%S.%f') AS later FROM {workflow}")
def ts_render(fx: Fixtures) -> DataFrame:
    return fx.workflow.select("workflow_id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("iso"), F.date_format(F.col("created_at") + F.expr("INTERVAL 5 SECONDS"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("later"))


@query("name_predicates", "SELECT workflow_id, regexp_matches(v, '^(0|[1-9][0-9]*)[.](0|[1-9][0-9]*)[.](0|[1-9][0-9]*)$') AS semver, regexp_matches(h, '^[0-9a-f]{{32}}$') AS id32 FROM (SELECT workflow_id, CASE WHEN workflow_id % 3 = 0 THEN '1.0' ELSE plan_version END AS v, CASE WHEN workflow_id % 5 = 0 THEN upper(content_hash) ELSE content_hash END AS h FROM {plan})")
def name_predicates(fx: Fixtures) -> DataFrame:
    v = F.when(F.col("workflow_id") % 3 == 0, F.lit("1.0")).otherwise(F.col("plan_version"))
    h = F.when(F.col("workflow_id") % 5 == 0, F.upper("content_hash")).otherwise(F.col("content_hash"))
    return fx.plan.select("workflow_id", v.rlike(r"^(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)$").alias("semver"), h.rlike("^[0-9a-f]{32}$").alias("id32"))


@query("null_safe", "SELECT workflow_id, terminal_reason IS NOT DISTINCT FROM CASE WHEN workflow_id % 2 = 0 THEN 'declined' END AS same FROM {workflow}")
def null_safe(fx: Fixtures) -> DataFrame:
    return fx.workflow.select("workflow_id", F.col("terminal_reason").eqNullSafe(F.when(F.col("workflow_id") % 2 == 0, "declined")).alias("same"))


def _quote(text: str) -> str:
    return json.dumps(text, ensure_ascii=False)


class _Number(str):
    """A number as it was written: 1, 1.0 and 1e3 differ."""


def _pairs(pairs: list[tuple[str, object]]) -> dict:
    own = dict(pairs)
    if len(own) < len(pairs):
        raise ValueError("repeated key")
    return own


def load(text: str):
    """Strict JSON: no repeated keys, no NaN or Infinity; numbers keep their spelling."""

    def no(name: str):
        raise ValueError(f"{name} is not JSON")

    return json.loads(text, object_pairs_hook=_pairs, parse_int=_Number, parse_float=_Number, parse_constant=no)


def canonical(value) -> str:
    """Compact text with keys in the order of their UTF-8 bytes."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{_quote(k)}:{canonical(value[k])}" for k in sorted(value, key=str.encode)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, _Number):
        return str(value)
    return _quote(value) if isinstance(value, str) else {None: "null", True: "true", False: "false"}[value]


@F.pandas_udf(T.StringType())
def canonical_text(docs: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Canonical text of JSON documents; null where a document is not strict JSON."""

    def one(doc):
        try:
            return None if doc is None else canonical(load(doc))
        except ValueError:
            return None

    for batch in docs:
        yield batch.map(one)


@query("canonical_json", "SELECT event_id, '{{\"a\":[1,1.0,1e3],\"b\":' || replace(props, ' ', '') || ',\"é\":null}}' AS canonical FROM {events}")
def canonical_json(fx: Fixtures) -> DataFrame:
    """Key order and blanks go, the spelling of numbers stays."""
    doc = F.concat(F.lit(' { "é" : null, "b" : '), F.col("props"), F.lit(', "a" : [ 1, 1.0, 1e3 ] } '))
    return fx.events.select("event_id", canonical_text(doc).alias("canonical"))


_PLAIN = "replace(props, ' ', '')"


@query("input_hash", f"SELECT event_id, {_uuid3_sql(_PLAIN)} AS input_hash FROM {{events}}")
def input_hash(fx: Fixtures) -> DataFrame:
    """Identity of an input: of its canonical text, so that key order and blanks do not matter."""
    return fx.events.select("event_id", uuid3(canonical_text(F.concat(F.lit("  "), F.col("props")))).alias("input_hash"))


# Value types: declared types, their codes, and exact validation of raw JSON.


def type_code(t) -> str:
    """Canonical code of a declared type: a word, [T], {name: T} with sorted names, or ("optional", T)."""
    if isinstance(t, str):
        return {"null": "n", "bool": "b", "int": "i", "float": "f", "string": "s"}[t]
    if isinstance(t, list):
        return f"a({type_code(t[0])})"
    if isinstance(t, tuple):
        return f"o({type_code(t[1])})"
    return "O{" + "".join(f"{len(k.encode())}:{k}{type_code(t[k])};" for k in sorted(t, key=str.encode)) + "}"


def check(value, t, at: str = "value") -> str | None:
    """What is wrong with a value of ``load``, with its path; null if nothing is."""
    if isinstance(t, tuple):
        return None if value is None else check(value, t[1], at)
    if isinstance(t, list):
        if not isinstance(value, list):
            return f"{at}: not an array"
        return next((e for i, v in enumerate(value) if (e := check(v, t[0], f"{at}[{i}]"))), None)
    if isinstance(t, dict):
        if not isinstance(value, dict):
            return f"{at}: not an object"
        extra = sorted(set(value) - set(t), key=str.encode)
        if extra:
            return f"{at}.{extra[0]}: not declared"
        for k in sorted(t, key=str.encode):
            if k not in value:
                if not isinstance(t[k], tuple):
                    return f"{at}.{k}: missing"
            elif e := check(value[k], t[k], f"{at}.{k}"):
                return e
        return None
    number = isinstance(value, _Number)
    sound = {
        "null": value is None,
        "bool": isinstance(value, bool),
        "string": isinstance(value, str) and not number,
        "int": number and not set(value) & set(".eE") and -(2**63) <= int(value) < 2**63,
        "float": number and bool(set(value) & set(".eE")) and abs(float(value)) != float("inf"),
    }[t]
    return None if sound else f"{at}: not {t}"


def to_spark(t) -> T.DataType:
    """The Spark type of a declared type."""
    if isinstance(t, str):
        return {"null": T.NullType(), "bool": T.BooleanType(), "int": T.LongType(), "float": T.DoubleType(), "string": T.StringType()}[t]
    if isinstance(t, list):
        return T.ArrayType(to_spark(t[0]), isinstance(t[0], tuple))
    if isinstance(t, tuple):
        return to_spark(t[1])
    return T.StructType([T.StructField(k, to_spark(t[k]), isinstance(t[k], tuple)) for k in sorted(t, key=str.encode)])


def validated(doc: Column, t) -> Column:
    """The error of each raw document against a declared type, or null."""

    @F.pandas_udf(T.StringType())
    def errors(docs: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text):
            try:
                return "value: missing" if text is None else check(load(text), t)
            except ValueError:
                return "value: not JSON"

        for batch in docs:
            yield batch.map(one).astype(object)

    return errors(doc)


@query("validate_values", "SELECT event_id, CASE CAST(event_id % 5 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 'value.k: not int' WHEN 2 THEN 'value.x: not declared' WHEN 3 THEN 'value.k: missing' ELSE 'value.tags[1]: not string' END AS error FROM {events}")
def validate_values(fx: Fixtures) -> DataFrame:
    """Exact validation by the literals' own shape: 1.0 is no int, and an undeclared field is an error."""
    k = F.col("event_id") % 5
    doc = F.when(k == 0, F.lit('{"k":7}')).when(k == 1, F.lit('{"k":1.0}')).when(k == 2, F.lit('{"k":1,"x":2}')).when(k == 3, F.lit('{"tags":null}')).otherwise(F.lit('{"k":1,"tags":["a",2]}'))
    return fx.events.select("event_id", validated(doc, {"k": "int", "tags": ("optional", ["string"])}).alias("error"))


# The participants' functions.


@query("op_echo", "SELECT workflow_id, count(*) AS n, sum(part_id) AS total FROM {operation} GROUP BY workflow_id")
def op_sum(fx: Fixtures) -> DataFrame:
    """Sum of an array of integers, from zero."""
    items = fx.operation.groupBy("workflow_id").agg(F.collect_list("part_id").alias("values"))
    return items.select("workflow_id", F.size("values").cast("long").alias("n"), F.aggregate("values", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("op_join", "SELECT w.workflow_id, coalesce(string_agg(o.operation_name, '+' ORDER BY o.operation_seq), '') AS joined FROM {workflow} w LEFT JOIN {operation} o ON o.workflow_id = w.workflow_id GROUP BY w.workflow_id")
def op_join(fx: Fixtures) -> DataFrame:
    """Texts joined by a separator; nothing joined is the empty text."""
    items = fx.operation.groupBy("workflow_id").agg(F.array_sort(F.collect_list(F.struct("operation_seq", "operation_name"))).alias("parts"))
    rows = fx.workflow.select("workflow_id").join(items, "workflow_id", "left")
    return rows.select("workflow_id", F.coalesce(F.array_join(F.transform("parts", lambda x: x["operation_name"]), "+"), F.lit("")).alias("joined"))


@query("op_prefix_id", "SELECT operation_id, CASE part_id % 3 WHEN 0 THEN 'res-' WHEN 1 THEN 'pay-' ELSE 'shp-' END || workflow_id || '-' || operation_seq AS ref FROM {operation}")
def op_prefix_id(fx: Fixtures) -> DataFrame:
    prefix = F.element_at(F.array(F.lit("res-"), F.lit("pay-"), F.lit("shp-")), (F.col("part_id") % 3 + 1).cast("int"))
    return fx.operation.select("operation_id", F.concat(prefix, F.col("workflow_id").cast("string"), F.lit("-"), F.col("operation_seq").cast("string")).alias("ref"))


# participants' operations, the input field that their result's id is made of, its name, and its prefix.
REFERENCES = {
    "authorize": ("order_id", "auth_id", "auth"),
    "void_authorization": ("order_id", "void_id", "void"),
    "capture": ("auth_id", "capture_id", "cap"),
    "refund_capture": ("auth_id", "refund_id", "rfnd"),
    "refund": ("capture_id", "refund_id", "rfnd"),
    "record_ledger": ("reference", "ledger_entry_id", "led"),
    "notify_customer": ("customer_id", "notification_id", "ntf"),
    "reserve_inventory": ("order_id", "reservation_id", "rsv"),
    "release_inventory": ("order_id", "released_reservation_id", "rel"),
    "commit_shipment": ("reservation_id", "shipment_id", "shp"),
    "adjust_balance": ("account_id", "adjustment_id", "adj"),
    "reverse_adjustment": ("account_id", "rollback_id", "rbk"),
    "post_journal": ("adjustment_id", "journal_id", "jnl"),
    "book_shipment": ("order_id", "shipment_id", "bkg"),
    "cancel_shipment": ("order_id", "cancellation_id", "cxl"),
    "charge_payment": ("order_id", "payment_id", "pay"),
}


def effective_input(body: Column) -> Column:
    """A request's own input: what the envelope of a compensation wraps, or the body itself."""
    return F.coalesce(F.get_json_object(body, "$.forward.input"), body)


def participant_result(operation: Column, body: Column) -> Column:
    """What a participant answers to a request (JSON texts): its result, or null if the input lacks what it needs.

    Operations are looked up in a registry: reference ids from REFERENCES, and the
    functions that echo a reservation or a decision, forward and back.
    """
    registry = {name: (source, result, f"{prefix}-") for name, (source, result, prefix) in REFERENCES.items()}
    registry |= {"reserve": ("reservation", "reserved", ""), "confirm": ("reserved", "confirmed", ""), "unconfirm": ("reserved", "unconfirmed", ""), "undo_decide": ("ref", "undone_ref", "")}
    of = lambda i: F.element_at(F.create_map(*[F.lit(x) for name, row in registry.items() for x in (name, row[i])]), operation)
    own = F.from_json(effective_input(body), "map<string,string>")
    value = F.element_at(own, of(0))
    simple = F.when(value.isNotNull(), F.to_json(F.create_map(of(1), F.concat(of(2), value))))
    released = F.when(own["reservation"].isNotNull(), F.to_json(F.struct(F.lit(1).alias("compensated"), own["reservation"].alias("reservation"))))
    status = F.when(own["decision"].isin("declined", "overlong"), own["decision"]).otherwise("approved")
    long = F.when(own["decision"] == "overlong", F.repeat(F.lit("z"), 200))
    decided = F.when(own["ref"].isNotNull() & own["decision"].isNotNull(), F.to_json(F.struct(status.alias("status"), own["ref"].alias("ref"), long.alias("long_reason"))))
    return F.when(operation == "release", released).when(operation == "decide", decided).otherwise(simple)


_NAMES = [*REFERENCES, "reserve", "release", "confirm", "unconfirm", "decide", "undo_decide"]
_ASKED_SQL = f"""asked AS (SELECT operation_id, part_id, {_NAMES!r}[CAST(part_id % {len(_NAMES)} AS INT) + 1] AS name, CASE WHEN part_id % 29 = 0 THEN NULL ELSE CAST(part_id AS VARCHAR) END AS v FROM {{operation}})"""
_ANSWERS_SQL = """CASE WHEN v IS NULL THEN NULL
  WHEN name = 'reserve' THEN '{{"reserved":"' || v || '"}}' WHEN name = 'release' THEN '{{"compensated":1,"reservation":"' || v || '"}}'
  WHEN name = 'confirm' THEN '{{"confirmed":"' || v || '"}}' WHEN name = 'unconfirm' THEN '{{"unconfirmed":"' || v || '"}}' WHEN name = 'undo_decide' THEN '{{"undone_ref":"' || v || '"}}'
  WHEN name = 'decide' THEN CASE part_id % 3 WHEN 0 THEN '{{"status":"declined","ref":"' || v || '"}}' WHEN 1 THEN '{{"status":"overlong","ref":"' || v || '","long_reason":"' || repeat('z', 200) || '"}}' ELSE '{{"status":"approved","ref":"' || v || '"}}' END
  WHEN name = 'authorize' THEN '{{"auth_id":"auth-' || v || '"}}' WHEN name = 'void_authorization' THEN '{{"void_id":"void-' || v || '"}}' WHEN name = 'capture' THEN '{{"capture_id":"cap-' || v || '"}}'
  WHEN name = 'refund_capture' OR name = 'refund' THEN '{{"refund_id":"rfnd-' || v || '"}}' WHEN name = 'record_ledger' THEN '{{"ledger_entry_id":"led-' || v || '"}}' WHEN name = 'notify_customer' THEN '{{"notification_id":"ntf-' || v || '"}}'
  WHEN name = 'reserve_inventory' THEN '{{"reservation_id":"rsv-' || v || '"}}' WHEN name = 'release_inventory' THEN '{{"released_reservation_id":"rel-' || v || '"}}' WHEN name = 'commit_shipment' THEN '{{"shipment_id":"shp-' || v || '"}}'
  WHEN name = 'adjust_balance' THEN '{{"adjustment_id":"adj-' || v || '"}}' WHEN name = 'reverse_adjustment' THEN '{{"rollback_id":"rbk-' || v || '"}}' WHEN name = 'post_journal' THEN '{{"journal_id":"jnl-' || v || '"}}'
  WHEN name = 'book_shipment' THEN '{{"shipment_id":"bkg-' || v || '"}}' WHEN name = 'cancel_shipment' THEN '{{"cancellation_id":"cxl-' || v || '"}}' WHEN name = 'charge_payment' THEN '{{"payment_id":"pay-' || v || '"}}' END"""


@query("participant_results", f"WITH {_ASKED_SQL} SELECT operation_id, name, {_ANSWERS_SQL} AS result FROM asked")
def participant_results(fx: Fixtures) -> DataFrame:
    """Each operation asked of a participant, by its forward body or, for every other one, wrapped as compensations are."""
    names = F.array(*[F.lit(n) for n in _NAMES])
    value = F.when(F.col("part_id") % 29 != 0, F.col("part_id").cast("string"))
    sources = sorted({source for source, _, _ in REFERENCES.values()} | {"reservation", "reserved", "ref"})
    decision = F.element_at(F.array(F.lit("declined"), F.lit("overlong"), F.lit("yes")), (F.col("part_id") % 3 + 1).cast("int"))
    own = F.struct(*[value.alias(s) for s in sources], decision.alias("decision"))
    body = F.when(F.col("part_id") % 2 == 0, F.to_json(F.struct(F.struct(own.alias("input")).alias("forward")))).otherwise(F.to_json(own))
    name = F.element_at(names, (F.col("part_id") % len(_NAMES) + 1).cast("int"))
    return fx.operation.select("operation_id", name.alias("name"), participant_result(name, body).alias("result"))


@query("op_decide", "SELECT operation_id, CASE WHEN part_id % 7 = 0 THEN 'declined' ELSE 'approved' END AS decision, part_id % 7 = 0 AS final FROM {operation}")
def op_decide(fx: Fixtures) -> DataFrame:
    no = F.col("part_id") % 7 == 0
    return fx.operation.select("operation_id", F.when(no, "declined").otherwise("approved").alias("decision"), no.alias("final"))


@query("op_reshape", "SELECT operation_id, 'r' || part_id AS reservation, operation_name AS sku, status = 2 AS confirmed FROM {operation}")
def op_reshape(fx: Fixtures) -> DataFrame:
    """A reservation built, confirmed and taken apart again."""
    held = F.struct(F.concat(F.lit("r"), F.col("part_id").cast("string")).alias("reservation"), F.struct(F.col("operation_name").alias("sku")).alias("of"), (F.col("status") == 2).alias("confirmed"))
    return fx.operation.select("operation_id", held.alias("h")).select("operation_id", "h.reservation", "h.of.sku", "h.confirmed")


@query("envelope", "SELECT operation_id, '{{\"forward\":{{\"input\":\"' || operation_name || '\"' || CASE WHEN result IS NULL THEN '' ELSE ',\"result\":' || result END || '}}}}' AS doc, operation_name AS input FROM {operation}")
def envelope(fx: Fixtures) -> DataFrame:
    """What a compensation gets: the forward input and result, wrapped, and unwrapped again."""
    doc = F.to_json(F.struct(F.struct(F.col("operation_name").alias("input"), "result").alias("forward")))
    return fx.operation.select("operation_id", doc.alias("doc"), F.get_json_object(doc, "$.forward.input").alias("input"))
