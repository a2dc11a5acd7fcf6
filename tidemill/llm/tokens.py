"""Token counts of whole texts, with overlap resynchronisation for huge ones.

Short texts are encoded as they are.  A huge one is encoded in overlapping chunks,
with offsets; two neighbours are spliced where both have a boundary between
pre-tokens, well inside the overlap.  Such a boundary is stable: a byte-pair model
merges only within a pre-token; where a pre-token ends depends on what comes before
it since the last boundary and on a few characters that follow; and both chunks see
these.  So everything before the boundary is as in the first chunk, everything
after as in the second.  If an overlap has no common boundary (a text without
blanks, say), it is widened until there is one or the text ends.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = 1 << 14
OVERLAP = 1 << 10
LIMIT = 512
#: Characters of text that are encoded in one call.
CALL = 1 << 18
#: Characters at an overlap's ends where no splice is made, besides the longest added token.
GUARD = 32

_held: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a .json (tokenizers) or .model (sentencepiece) file, held per process."""
    if path not in _held:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            own.no_truncation()
            own.no_padding()
        else:
            import sentencepiece

            own = sentencepiece.SentencePieceProcessor(model_file=path)
        _held[path] = own
    return _held[path]


def _boundaries(enc) -> dict[int, int]:
    """Start of every pre-token -> number of tokens before it."""
    found, last = {}, object()
    for i, (word, (start, _)) in enumerate(zip(enc.word_ids, enc.offsets)):
        if word != last or word is None:
            found.setdefault(start, i)
        last = word
    return found


def count_long(text: str, own, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text, by spliced chunks."""
    guard = GUARD + max((len(t.content) for t in own.get_added_tokens_decoder().values()), default=0)
    encode = lambda a, b: own.encode(text[a:b], add_special_tokens=False)
    total, at, end = 0, 0, min(chunk, len(text))
    enc = encode(at, end)
    skipped = 0  # tokens of the current chunk that the ones before have counted
    while end < len(text):
        wide = max(overlap, 2 * guard + 1)
        own_starts = _boundaries(enc)
        while True:
            start = max(at, end - wide)
            nxt_end = min(len(text), start + wide + chunk)
            nxt = encode(start, nxt_end)
            nxt_starts = _boundaries(nxt)
            common = [p for p in own_starts if start + guard <= p + at <= end - guard and p + at - start in nxt_starts and own_starts[p] >= skipped]
            if common:
                p = common[len(common) // 2]
                total += own_starts[p] - skipped
                skipped = nxt_starts[p + at - start]
                at, end, enc = start, nxt_end, nxt
                break
            if start == at or wide >= len(text):  # no boundary in the whole chunk: it is taken anew, twice as long
                end = min(len(text), at + 2 * (end - at))
                enc = encode(at, end)
                own_starts = _boundaries(enc)
                if end == len(text):
                    break
                wide = overlap
                continue
            wide *= 2
    return total + len(enc.ids) - skipped


def count(texts: list[str], path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Tokens of each text, as the library for the file gives them, without added special tokens."""
    own = tokenizer(path)
    if not path.endswith(".json"):
        return [len(own.encode(t, num_threads=1)) for t in texts]
    out, held, chars = [0] * len(texts), [], 0
    for i, t in enumerate([*texts, None]):
        if held and (t is None or chars + len(t) > CALL):
            for j, enc in zip(held, own.encode_batch_fast([texts[j] for j in held], add_special_tokens=False)):
                out[j] = len(enc.ids)
            held, chars = [], 0
        if t is None:
            break
        if len(t) > chunk:
            out[i] = count_long(t, own, chunk, overlap)
        elif t:
            held.append(i)
            chars += len(t)
    return out


def n_tokens(text: Column, path: str) -> Column:
    """Number of tokens of a text column; null counts as empty."""

    @F.pandas_udf(T.LongType())
    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(count(batch.tolist(), path), dtype="int64")

    return counted(F.coalesce(text, F.lit("")))


def counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of documents.

    Null texts are empty and have no tokens.  Whole texts are counted; those above
    CHUNK characters chunk by chunk, so that the library never holds the tokens of
    more than a few chunks.  Repeated rows stay; an empty table gives an empty
    result.  Columns other than doc_id and text are not read.
    """
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), n_tokens(F.col("text"), path).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: token counts of every document with the 50k byte-level vocabulary."""
    import public_tokenizers

    return counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
