"""Secret scan with multipart credential linking, in DataFrame functions only.

Base rules find strong spans by themselves.  Weak candidates (short access
identifiers, short secrets, endpoints) mean little alone; they are reported only
when complementary parts lie within a scope of characters around them.  The parts
are intervals on their document; an interval join on scope-wide bins tells which
kinds of part each candidate has near.  A part is in all bins from its start to its
end.  Bins are aggregated to their least start and greatest end first, so candidates meet one row per bin and kind of part,
not one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import written

#: Fixed patterns and least lengths of the base kinds, in their order.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_MIN = 12
ACCESS = r"AKIA[A-Z0-9]+"
ACCESS_MIN = 18
HEX = r"[0-9a-f]+"
HEX_MIN = 16

#: Weak candidates: named identifiers, and endpoints with a scheme.
IDENTITY = r"""(?i)(?:access_?key_?id|client_?id|user_?name)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=@-]+)"""
ENDPOINT = r"""(?:https?|s3|ftp|postgres|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D"'<>]+"""
WEAK_SECRET_MIN = 6
WEAK_ACCESS_MIN = 8

KINDS = ("assign", "access", "hex", "weak_secret", "weak_access", "identity", "endpoint")
ROLE = {"assign": "secret", "hex": "secret", "weak_secret": "secret", "access": "identity", "weak_access": "identity", "identity": "identity", "endpoint": "endpoint"}

#: Characters between parts that belong together, from the end of one to the start of the next.
SCOPE = 200

_SPAN = "struct<start: bigint, rank: int, end: bigint, kind: string>"
_NONE = f"CAST(array() AS array<{_SPAN}>)"


#: Matches that are summed up in one step; a step copies its matches once for each of them.
STEP = 64


def _found(text: str, pattern: str, group: int) -> Column:
    """array<(start, end, n)> of a pattern's leftmost matches: offsets in code points, and the group's length.

    The text between matches and the matches themselves alternate, so lengths add
    up to offsets.  Appending to an array copies it, so matches are summed up in
    steps of STEP, and the steps' results are appended to one another.
    """
    p = F.lit(pattern)
    lengths = lambda c: F.transform(c, lambda x: F.length(x).cast("long"))
    whole = lengths(F.regexp_extract_all(F.col(text), p, F.lit(0)))
    parts = F.arrays_zip(lengths(F.split(F.col(text), pattern, -1)).alias("gap"), whole.alias("whole"), lengths(F.regexp_extract_all(F.col(text), p, F.lit(group))).alias("n") if group else whole.alias("n"))
    span = "array<struct<start: bigint, end: bigint, n: bigint>>"
    none = F.expr(f"CAST(array() AS {span})")

    def one(acc: Column, x: Column) -> Column:
        start = acc["pos"] + x["gap"]
        end = start + x["whole"]
        return F.struct(end.alias("pos"), F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"), x["n"].alias("n"))).alias("out"))

    def step(acc: Column, xs: Column) -> Column:
        done = F.aggregate(xs, F.struct(acc["pos"].alias("pos"), none.alias("out")), one)
        return F.struct(done["pos"].alias("pos"), F.array_append(acc["out"], done["out"]).alias("out"))

    matches = F.filter(parts, lambda x: x["whole"].isNotNull())  # the text after the last match has none
    # In a lambda's body an expression is computed for each element, so the matches are bound to a variable first.
    chunked = lambda ms: F.transform(F.sequence(F.lit(0), F.floor((F.size(ms) - 1) / STEP).cast("int")), lambda i: F.slice(ms, i * STEP + 1, STEP))
    steps = F.transform(F.array(matches), chunked)[0]
    zero = F.struct(F.lit(0).cast("long").alias("pos"), F.expr(f"CAST(array() AS array<{span}>)").alias("out"))
    return F.flatten(F.aggregate(steps, zero, step)["out"])


def _spans(text: str, pattern: str, group: int, kinds: list[tuple[str, int, int]]) -> Column:
    """array<span>; a match gets the first of kinds (name, least, most length of its group) that fits, or goes."""
    found = _found(text, pattern, group)

    def named(x: Column) -> Column:
        fits = [F.when((x["n"] >= least) & (x["n"] <= most), F.lit(kind)) for kind, least, most in kinds]
        return F.coalesce(*fits)

    rank = F.create_map(*[F.lit(v) for i, k in enumerate(KINDS) for v in (k, i)])
    spans = F.filter(F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.element_at(rank, named(x)).alias("rank"), x["end"].alias("end"), named(x).alias("kind"))), lambda s: s["kind"].isNotNull())
    return F.when(F.col(text).rlike(pattern), spans).otherwise(F.expr(_NONE))


_MOST = 2**31 - 1


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, base and weak arrays of spans for every row of documents."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    # Runs of hex digits are maximal, so asking for 16 digits in the pattern finds the same spans and skips short runs.
    return rows.select(
        "doc_id",
        "text_hash",
        _spans("text", ASSIGN, 2, [("assign", ASSIGN_MIN, _MOST), ("weak_secret", WEAK_SECRET_MIN, ASSIGN_MIN - 1)]).alias("assigned"),
        _spans("text", ACCESS, 0, [("access", ACCESS_MIN, _MOST), ("weak_access", WEAK_ACCESS_MIN, ACCESS_MIN - 1)]).alias("accessed"),
        _spans("text", f"[0-9a-f]{{{HEX_MIN},}}", 0, [("hex", HEX_MIN, _MOST)]).alias("hexed"),
        _spans("text", IDENTITY, 1, [("identity", 1, _MOST)]).alias("identified"),
        _spans("text", ENDPOINT, 0, [("endpoint", 1, _MOST)]).alias("located"),
    ).select("doc_id", "text_hash", F.concat("assigned", "accessed", "hexed", "identified", "located").alias("parts"))


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, text_hash, spans: the weak candidates that have their complements within scope.

    A weak secret needs an identity or an endpoint, a weak identity needs a secret,
    an endpoint needs both a secret and an identity.
    """
    role = F.create_map(*[F.lit(v) for pair in ROLE.items() for v in pair])
    parts = found.where("size(parts) > 0").select("doc_id", "text_hash", F.explode("parts").alias("s")).distinct()
    parts = parts.select("doc_id", "text_hash", "s", F.element_at(role, F.col("s.kind")).alias("role"))
    at = lambda x: F.floor(x / scope)
    binned = parts.withColumn("bin", F.explode(F.sequence(at(F.col("s.start")), at(F.col("s.end")))))
    bins = binned.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("bin").alias("_bin"), F.col("role").alias("_role")).agg(F.min("s.start").alias("least"), F.max("s.end").alias("most"))
    weak = parts.where(F.col("s.rank") >= 3).withColumn("near", F.explode(F.sequence(at(F.col("s.start")) - 1, at(F.col("s.end")) + 1)))
    same = weak.doc_id.eqNullSafe(bins._id) & (weak.text_hash == bins._hash) & (weak.near == bins._bin) & (weak.role != bins._role)
    met = weak.join(bins, same).where((F.col("most") >= F.col("s.start") - scope) & (F.col("least") <= F.col("s.end") + scope))
    has = {r: F.max(F.col("_role") == r) for r in ("secret", "identity", "endpoint")}
    met = met.groupBy("doc_id", "text_hash", "s", "role").agg(*[c.alias(f"has_{r}") for r, c in has.items()])
    fits = met.where("(role = 'secret' AND (has_identity OR has_endpoint)) OR (role = 'identity' AND has_secret) OR (role = 'endpoint' AND has_secret AND has_identity)")
    return fits.groupBy("doc_id", "text_hash").agg(F.collect_list("s").alias("spans"))


def _text(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, base and all (arrays of spans) for every row of documents.

    Null texts are empty and have no spans; an empty table gives an empty result.
    Whole texts are scanned, in time that grows with their length and matches.
    Columns other than doc_id and text are not read.  Repeated rows stay, each with
    its spans; parts of different rows never link, whether they share an id or not
    (unless they share the text too, and then they agree).
    """
    found = written(scanned(docs), "secret-parts")
    more = linked(found, scope)
    more = more.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("spans").alias("_spans"))
    rows = found.join(more, found.doc_id.eqNullSafe(more._id) & (found.text_hash == more._hash), "left")
    base = F.filter("parts", lambda s: s["rank"] < 3)
    return rows.select("doc_id", base.alias("base"), F.concat(base, F.coalesce(F.col("_spans"), F.expr(_NONE))).alias("all"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: counts, digest and spans of the secrets of every document."""
    rows = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(_text(F.col("base")), 256).alias("base_sha256"), _text(F.col("all")).alias("spans"))


def _found_sql(pattern: str, group: int, kinds: list[tuple[str, int, int]]) -> str:
    """Spans of one pattern: matches and the gaps before them alternate, so running sums of lengths are offsets."""
    p = pattern.replace("'", "''")
    named = "CASE " + " ".join(f"WHEN n BETWEEN {least} AND {most} THEN '{kind}'" for kind, least, most in kinds) + " END"
    return f"""SELECT rid, stop - whole AS start, stop AS "end", {named} AS kind FROM (
    SELECT rid, whole, n, CAST(sum(gap + whole) OVER (PARTITION BY rid ORDER BY i) AS BIGINT) AS stop FROM (
      SELECT rid, i, length(gaps[i]) AS gap, length(wholes[i]) AS whole, length(vals[i]) AS n FROM (
        SELECT rid, gaps, wholes, vals, unnest(range(1, len(wholes) + 1)) AS i FROM (
          SELECT rid, regexp_split_to_array(text, '{p}') AS gaps, regexp_extract_all(text, '{p}') AS wholes, regexp_extract_all(text, '{p}', {group}) AS vals FROM docs WHERE regexp_matches(text, '{p}'))))) WHERE {named} IS NOT NULL"""


_RANKS = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS)) + " END"
_ROLES = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{r}'" for k, r in ROLE.items()) + " END"
_LISTED = """string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, rank, "end")"""

ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents), found AS (
  {_found_sql(ASSIGN, 2, [("assign", ASSIGN_MIN, _MOST), ("weak_secret", WEAK_SECRET_MIN, ASSIGN_MIN - 1)])}
  UNION ALL {_found_sql(ACCESS, 0, [("access", ACCESS_MIN, _MOST), ("weak_access", WEAK_ACCESS_MIN, ACCESS_MIN - 1)])}
  UNION ALL {_found_sql(HEX, 0, [("hex", HEX_MIN, _MOST)])}
  UNION ALL {_found_sql(IDENTITY, 1, [("identity", 1, _MOST)])}
  UNION ALL {_found_sql(ENDPOINT, 0, [("endpoint", 1, _MOST)])}
), parts AS (SELECT *, {_RANKS} AS rank, {_ROLES} AS role FROM found), told AS (
  SELECT *, EXISTS (SELECT 1 FROM parts o WHERE o.rid = p.rid AND o.role = 'secret' AND o.start <= p."end" + {SCOPE} AND o."end" >= p.start - {SCOPE}) AS has_secret,
    EXISTS (SELECT 1 FROM parts o WHERE o.rid = p.rid AND o.role = 'identity' AND o.start <= p."end" + {SCOPE} AND o."end" >= p.start - {SCOPE}) AS has_identity,
    EXISTS (SELECT 1 FROM parts o WHERE o.rid = p.rid AND o.role = 'endpoint' AND o.start <= p."end" + {SCOPE} AND o."end" >= p.start - {SCOPE}) AS has_endpoint FROM parts p
), kept AS (
  SELECT * FROM told WHERE rank < 3 OR role = 'secret' AND (has_identity OR has_endpoint) OR role = 'identity' AND has_secret OR role = 'endpoint' AND has_secret AND has_identity
), listed AS (
  SELECT rid, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
    {_LISTED} FILTER (WHERE rank < 3) AS base, {_LISTED} AS spans FROM kept GROUP BY rid
)
SELECT d.doc_id, coalesce(l.n_assign, 0) AS n_assign, coalesce(l.n_access, 0) AS n_access, coalesce(l.n_hex, 0) AS n_hex, sha256(coalesce(l.base, '')) AS base_sha256, coalesce(l.spans, '') AS spans
FROM docs d LEFT JOIN listed l ON l.rid = d.rid
"""
