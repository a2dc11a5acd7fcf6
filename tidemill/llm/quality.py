"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps the measurements and
a bit per failed rule; policies are masks over those bits, so a new policy version,
or what a policy would keep without one of its rules, never reads a text again.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import with_row, written

#: Fixed values of the contract: characters that count as symbols.
SYMBOLS = "#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower")

#: Rules in bit order: name and the condition, over the measures, under which a document fails.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 15 * n_words"),
    ("shouting", "n_upper > n_lower and n_upper >= 20"),
    ("repeated_lines", "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines"),
    ("word_length", "word_chars > 20 * n_words or word_chars < 2 * n_words"),
    ("no_words", "n_words = 0"),
    ("long_repeats", "n_words >= 50 and 100 * n_repeat_words > 50 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]

#: Policies by version; a document is kept if it fails none of a policy's rules.
#: "corpus" lets short texts pass that have no other fault; few words repeat windows easily, so repeats count from 50 on.
POLICIES = {
    "base": BASE,
    "v1": BASE | BIT["symbols"] | BIT["shouting"],
    "v2": BASE | BIT["symbols"] | BIT["shouting"] | BIT["repeated_lines"] | BIT["word_length"],
    "corpus": BIT["symbols"] | BIT["shouting"] | BIT["repeated_lines"] | BIT["word_length"] | BIT["no_words"] | BIT["long_repeats"],
}
CURRENT = "v2"

_BLANKS = " \t\n\v\f\r"
_UPPER, _LOWER = re.compile("[A-ZÀ-ÖØ-Þ]"), re.compile("[a-zß-öø-ÿ]")


def measure(text: str | None) -> tuple[int, ...]:
    """The measures of one text, in the order of MEASURES; null has no words."""
    text = text or ""
    words = text.encode("utf-8").split()  # splits at \x20 and \x09-\x0D, no others
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(windows) < len(words) - 2:
        end = 0  # words before this position are counted
        for i, window in enumerate(zip(words, words[1:], words[2:])):
            if windows[window] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    lines, seen, dup = 0, set(), 0
    for line in text.split("\n"):
        if line.strip(_BLANKS):
            lines += 1
            dup += line in seen
            seen.add(line)
    chars = len(text) - sum(text.count(c) for c in _BLANKS)
    return (len(words), chars, sum(text.count(c) for c in SYMBOLS), dup, repeated, lines, len(_UPPER.findall(text)), len(_LOWER.findall(text)))


@F.pandas_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
def _measured(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        yield pd.DataFrame([measure(t) for t in batch], columns=list(MEASURES))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measures and fail_bits of every row of documents.

    Null and empty texts have no words and fail ``few_words``.  Repeated rows keep
    one entry each; an empty table gives an empty ledger.
    """
    rows = docs.select("doc_id", _measured("text").alias("m")).select("doc_id", "m.*")
    return rows.withColumn("fail_bits", fail_bits())


def fail_bits() -> Column:
    """Bit i is set if rule i fails."""
    bits = F.lit(0).cast("long")
    for i, (_, fails) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return bits


def passes(mask: int, bits: str = "fail_bits") -> Column:
    """Whether a document fails no rule of the mask."""
    return F.col(bits).bitwiseAND(F.lit(mask)) == 0


def ablation(entries: DataFrame, policies: dict[str, int] | None = None) -> DataFrame:
    """(policy, without_rule, kept, failed_any, failed_all): what each policy keeps as it is and without each of its rules.

    Documents are counted per bit pattern first; there are 2 ** rules patterns at
    most, and everything else runs on those.
    """
    patterns = entries.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    masks = []
    for version, mask in (policies or POLICIES).items():
        masks.append((version, None, mask))
        masks += [(version, name, mask & ~BIT[name]) for name, _ in RULES if mask & BIT[name]]
    listed = F.array(*[F.struct(F.lit(v).alias("policy"), F.lit(w).cast("string").alias("without_rule"), F.lit(m).cast("long").alias("mask")) for v, w, m in masks])
    paired = patterns.select("fail_bits", "n", F.inline(listed))
    failed = F.col("fail_bits").bitwiseAND(F.col("mask"))
    return paired.groupBy("policy", "without_rule").agg(
        F.coalesce(F.sum(F.when(failed == 0, F.col("n"))), F.lit(0)).alias("kept"),
        F.expr("bit_or(fail_bits & mask)").alias("failed_any"),
        F.expr("bit_and(fail_bits & mask)").alias("failed_all"),
    )


def keep(docs: DataFrame, policy: str = "corpus") -> DataFrame:
    """The documents that a policy keeps, with all their columns as they are.

    Null and wordless texts go.  Whole texts are measured, one at a time; rows that
    repeat share their fate; an empty table gives an empty result.
    """
    rows = with_row(docs, "text").select("_row", _measured("text").alias("m")).select("_row", "m.*")
    return rows.withColumn("fail_bits", fail_bits()).where(passes(POLICIES[policy])).select("_row.*")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents, as a table that policies and ablations read."""
    return written(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), "quality-ledger")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: measures, base verdict and current policy's verdict of every document."""
    failed = ~passes(BASE)
    return entries(spark, sf_dir).select("doc_id", *MEASURES[:5], failed.alias("base_failed"), (passes(POLICIES[CURRENT]) & ~failed).alias("kept"), "fail_bits")


def ablation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: what every policy keeps of all documents, as it is and without each of its rules."""
    return ablation(entries(spark, sf_dir))


_JUDGED_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT rid, i, words[i] || chr(1) || words[i + 1] || chr(1) || words[i + 2] AS w FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM docs WHERE len(words) >= 3)
), repeated AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n FROM windows) x, range(0, 3) r(k) WHERE x.n > 1 GROUP BY rid
), measured AS (
  SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
    len(regexp_extract_all(text, '[A-ZÀ-ÖØ-Þ]')) AS n_upper, len(regexp_extract_all(text, '[a-zß-öø-ÿ]')) AS n_lower
  FROM docs d LEFT JOIN repeated r ON r.rid = d.rid
), counted AS (
  SELECT *, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines FROM measured
), judged AS (
  SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * n_symbols > 15 * n_words THEN 4 ELSE 0 END) + (CASE WHEN n_upper > n_lower AND n_upper >= 20 THEN 8 ELSE 0 END)
    + (CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 16 ELSE 0 END)
    + (CASE WHEN word_chars > 20 * n_words OR word_chars < 2 * n_words THEN 32 ELSE 0 END)
    + (CASE WHEN n_words = 0 THEN 64 ELSE 0 END) + (CASE WHEN n_words >= 50 AND 100 * n_repeat_words > 50 * n_words THEN 128 ELSE 0 END) AS BIGINT) AS fail_bits FROM counted
)
"""

ORACLE_SQL = f"""{_JUDGED_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM judged
"""

ABLATION_SQL = f"""{_JUDGED_SQL}, policies(policy, without_rule, mask) AS (VALUES
  ('base', NULL, 3), ('base', 'few_words', 2), ('base', 'repeated_windows', 1),
  ('v1', NULL, 15), ('v1', 'few_words', 14), ('v1', 'repeated_windows', 13), ('v1', 'symbols', 11), ('v1', 'shouting', 7),
  ('v2', NULL, 63), ('v2', 'few_words', 62), ('v2', 'repeated_windows', 61), ('v2', 'symbols', 59), ('v2', 'shouting', 55), ('v2', 'repeated_lines', 47), ('v2', 'word_length', 31),
  ('corpus', NULL, 252), ('corpus', 'symbols', 248), ('corpus', 'shouting', 244), ('corpus', 'repeated_lines', 236), ('corpus', 'word_length', 220), ('corpus', 'no_words', 188), ('corpus', 'long_repeats', 124)
)
SELECT policy, without_rule, CAST(count(*) FILTER (WHERE fail_bits & mask = 0) AS BIGINT) AS kept,
  CAST(bit_or(fail_bits & mask) AS BIGINT) AS failed_any, CAST(bit_and(fail_bits & mask) AS BIGINT) AS failed_all
FROM judged, policies GROUP BY policy, without_rule
"""
