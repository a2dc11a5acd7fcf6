"""WARC archives with a two-level capture index.

Pages are written as WARC records, one gzip member each, into archive files in a
shared folder.  Every record's capture line (reversed-host URL key, page, file,
offset, length) is sorted by key and packed into compressed blocks; a sparse
directory keeps the first key, the place and the size of each block.  A lookup
finds its blocks by binary search in the directory, reads their byte ranges, and
then the records' own ranges.

Tasks write files under names of their own and report the places of what they
wrote.  Only reported places are ever read, so an attempt that was lost or repeated
leaves at most a file that nothing points to.
"""

from __future__ import annotations

import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import columns_of, maybe_broadcast, scratch, written

#: Payloads of fewer bytes are never stored as revisits.
REVISIT_BYTES = 100
#: Bytes after which a task goes on to another archive file.
FILE_BYTES = 1 << 30
#: Archive bytes that a task reads back; small archives are dealt to the cores in parts of READ_LEAST or more.
READ_BYTES, READ_LEAST = 64 << 20, 1 << 20
#: Capture lines in a block of the index, at least.
BLOCK_LINES = 2000
#: Blocks that a directory may have; blocks grow beyond BLOCK_LINES to stay within.
MAX_BLOCKS = 200_000
LEVEL = 4
DATE = "2020-01-01T00:00:00Z"

CAPTURE = "key string, page_id long, file string, offset long, length long"
DIRECTORY = "first_key string, last_key string, file string, offset long, length long, lines long"
RECORD = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


#: Fixed names that pyarrow has for Hadoop's schemes of the same store.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss"}


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder as Spark itself would resolve it: a path without a scheme belongs to the default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _open(uri: str):
    """(file system, path) of a qualified URI, by pyarrow; a path without a scheme is refused, as tasks can't tell where it is."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        raise ValueError(f"not a qualified URI: {uri}")
    return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{rest if scheme != 'file' else '//' + '/' + rest.lstrip('/')}")


def _escaped(text: Column) -> Column:
    """Characters outside printable ASCII as %XX of their UTF-8 bytes; all others stay."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\x21-\x7E]+|(?s:.)"), F.lit(0))
    one = lambda x: F.when(x.rlike(r"^[\x21-\x7E]"), x).otherwise(F.regexp_replace(F.hex(F.encode(x, "UTF-8")), "(..)", "%$1"))
    return F.when(text.rlike(r"[^\x21-\x7E]"), F.array_join(F.transform(pieces, one), "")).otherwise(text)


def url_key(url: Column) -> Column:
    """Reversed-host key: com,example,www)/path?query; lower-case host, no scheme; null gives the empty key.

    Keys are printable ASCII: all other characters of host and tail are percent-encoded.
    """
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[^:/?#]*://", "")
    host = _escaped(F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)))
    tail = _escaped(F.substring_index(F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)$", 1), "#", 1))
    return F.when(url.isNull(), "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), tail))


def decided(pages: DataFrame) -> DataFrame:
    """page_id, url, key, payload, payload_bytes, payload_digest, refers_to of every row of pages.

    ``refers_to`` is the smallest page_id with the same payload of REVISIT_BYTES or
    more, for all rows of a repeated payload but one: of the rows with that page_id
    a single one is the response.  Revisits have no payload here.  Payloads of
    rows without any page_id are all responses, as nothing could refer to them.
    """
    rows = pages.select("page_id", "url", url_key(F.col("url")).alias("key"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload"))
    large = rows.where(F.col("payload_bytes") >= REVISIT_BYTES)
    # Per digest the least page_id and how many rows have it: the count is kept as a pair's second part, so one pass does.
    ids = large.groupBy("payload_digest", "page_id").agg(F.count(F.lit(1)).alias("n"))
    firsts = ids.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.min_by("n", "page_id").alias("heads"), F.sum("n").alias("n"))
    firsts = written(firsts.where("n > 1 AND first IS NOT NULL").drop("n"), "warc-firsts")
    joined = rows.join(maybe_broadcast(firsts, firsts.count()), "payload_digest", "left")
    columns = ["page_id", "url", "key", "payload", "payload_bytes", "payload_digest", "refers_to"]
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first")), F.col("first")).alias("refers_to")
    several = F.coalesce((F.col("heads") > 1) & (F.col("page_id") == F.col("first")), F.lit(False))
    sole = joined.where(~several).withColumn("refers_to", refers).withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload"))).select(columns)
    if firsts.where("heads > 1").isEmpty():
        return sole
    # Rows that repeat a smallest page_id: numbered once and written, so that the number of a row is the same in every task.
    again = written(joined.where(several).withColumn("payload", F.lit(None).cast("binary")).withColumn("at", F.monotonically_increasing_id()), "warc-heads")
    one = again.groupBy("payload_digest").agg(F.min("at").alias("one"))
    again = again.join(maybe_broadcast(one, firsts.count()), "payload_digest").withColumn("refers_to", F.when(F.col("at") > F.col("one"), F.col("first")))
    bodies = joined.where(several).groupBy("payload_digest").agg(F.min("payload").alias("body"))
    heads = again.where("refers_to IS NULL").join(bodies, "payload_digest").withColumn("payload", F.col("body"))
    return sole.unionByName(heads.select(columns)).unionByName(again.where("refers_to IS NOT NULL").select(columns))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE, length: int | None = None) -> bytes:
    """One WARC record; a revisit has the HTTP head of the response, with the payload's length, and no payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if length is None else length}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "about:blank")
    own = "none" if page_id is None else str(page_id)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{own}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[int | None, str, int | None, int, str, bytes]:
    """What RECORD names, from one record's bytes."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(line for line in http.decode().split("\r\n") if line.lower().startswith("content-length:")).split(":")[1])
    number = lambda name: None if (v := fields.get(name, "<urn:page:none>")[len("<urn:page:") : -1]) == "none" else int(v)
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response":
        if len(payload) != length or sha256(payload).hexdigest() != digest:
            raise ValueError(f"damaged record of page {number('WARC-Record-ID')}")
    return number("WARC-Record-ID"), kind, number("WARC-Refers-To"), length, digest, payload


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _digits(name: str) -> Column:
    """An id as text: pandas would make floats of a column of numbers with nulls, and round large ids."""
    return F.col(name).cast("long").cast("string").alias(name)


def _whole(x: str | None) -> int | None:
    return None if x is None else int(x)


def _captures(rows: list[tuple]) -> pd.DataFrame:
    """CAPTURE rows; page ids may be null and are never floats."""
    names = ["key", "page_id", "file", "offset", "length"]
    kind = {"page_id": "Int64", "offset": "int64", "length": "int64"}
    return pd.DataFrame({n: pd.array([r[i] for r in rows], dtype="Int64") if n == "page_id" else pd.Series([r[i] for r in rows], dtype=kind.get(n, "object")) for i, n in enumerate(names)})


def write_archive(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the records of all pages to archive files in ``folder``; their captures, as a table there."""
    folder = qualified(pages.sparkSession, folder)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        out = name = None
        at = 0
        for batch in batches:
            captures = []
            for key, page_id, url, payload, n, digest, refers in zip(*[batch[c] for c in ("key", "page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to")]):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                own = _whole(page_id)
                member = _gzip(record(own, url, bytes(payload or b""), digest, _whole(refers), length=int(n)))
                out.write(member)
                captures.append((key, own, name, at, len(member)))
                at += len(member)
            yield _captures(captures)
        if out is not None:
            out.close()

    captures = decided(pages).select("key", _digits("page_id"), "url", "payload", "payload_bytes", "payload_digest", _digits("refers_to")).mapInPandas(write, CAPTURE)
    captures.write.parquet(f"{folder}/captures")
    return pages.sparkSession.read.schema(CAPTURE).parquet(f"{folder}/captures")


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Packs the captures, sorted by key, into compressed blocks in ``folder``; the block directory, as a table there."""
    spark = captures.sparkSession
    folder = qualified(spark, folder)
    n = captures.count()
    lines = max(block_lines, -(-n // MAX_BLOCKS))
    parts = max(1, min(n // lines, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _open(folder)
        out, name, at, held = None, "", 0, []
        rows = []

        def put() -> None:
            nonlocal out, name, at, held
            if out is None:
                name = f"{uuid.uuid4().hex}.cdx.gz"
                out = store.open_output_stream(f"{base}/{name}", compression=None)
            member = _gzip("".join(line for _, line in held).encode())
            out.write(member)
            rows.append((held[0][0], held[-1][0], name, at, len(member), len(held)))
            at, held = at + len(member), []

        for batch in batches:
            for key, page_id, file, offset, length in zip(batch["key"], batch["page_id"], batch["file"], batch["offset"], batch["length"]):
                held.append((key, json.dumps([key, page_id, file, int(offset), int(length)]) + "\n"))  # ASCII, so one line whatever the key
                if len(held) >= lines:
                    put()
        if held:
            put()
        if out is not None:
            out.close()
        yield pd.DataFrame(rows, columns=["first_key", "last_key", "file", "offset", "length", "lines"])

    by_key = captures.repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id")
    by_key.select("key", _digits("page_id"), "file", "offset", "length").mapInPandas(pack, DIRECTORY).write.parquet(f"{folder}/directory")
    return spark.read.schema(DIRECTORY).parquet(f"{folder}/directory")


def lookup(keys: DataFrame, folder: str) -> DataFrame:
    """The captures (CAPTURE) of every distinct key in ``keys``.

    The directory has MAX_BLOCKS rows at most, so each task may hold it.  Keys find
    the blocks they may be in by binary search; a key with very many captures spans
    blocks, and each block is read by one task, for all keys that need it.
    """
    spark = keys.sparkSession
    folder = qualified(spark, folder)
    blocks = [tuple(r) for r in spark.read.schema(DIRECTORY).parquet(f"{folder}/directory").orderBy("first_key", "last_key", "file", "offset").collect()]  # within MAX_BLOCKS
    table = spark.sparkContext.broadcast((sorted(b[0] for b in blocks), sorted(b[1] for b in blocks), [b[2:5] for b in blocks]))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, last, _ = table.value
        for batch in batches:
            own, at = [], []
            for key in batch["key"]:
                for i in range(bisect_left(last, key), bisect_right(first, key)):
                    own.append(key)
                    at.append(i)
            yield pd.DataFrame({"key": pd.Series(own, dtype="object"), "block": pd.Series(at, dtype="int64")})

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _open(folder)
        now, lines = None, {}
        for batch in batches:
            found = []
            for key, i in zip(batch["key"], batch["block"]):
                if i != now:
                    file, offset, length = table.value[2][i]
                    with store.open_input_file(f"{base}/{file}") as f:
                        raw = f.read_at(length, offset)
                    now, lines = i, {}
                    for line in zlib.decompress(raw, 31).decode().split("\n")[:-1]:
                        capture = json.loads(line)
                        lines.setdefault(capture[0], []).append(capture)
                for own, page_id, file, offset, length in lines.get(key, ()):
                    found.append((own, _whole(page_id), file, offset, length))
            yield _captures(found)

    at = keys.select("key").distinct().mapInPandas(search, "key string, block long")
    return at.repartition(_tasks(spark, sum(b[4] for b in blocks)), "block").sortWithinPartitions("block", "key").mapInPandas(fetch, CAPTURE)


def _tasks(spark: SparkSession, size: int) -> int:
    """Tasks to read ``size`` bytes of compressed members with; adaptive execution would go by the sizes of the lines that name them."""
    return max(1, -(-size // READ_BYTES), min(spark.sparkContext.defaultParallelism, -(-size // READ_LEAST)))


def read_records(captures: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """RECORD rows for captures, by range reads in the order of files and offsets.

    A record that does not agree with its own length or digest fails the job.
    Without ``payloads`` the payload column is null, though payloads are read and
    verified all the same.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _open(folder)
        now, f = None, None
        for batch in batches:
            rows = []
            for name, offset, length in zip(batch["file"], batch["offset"], batch["length"]):
                if name != now:
                    if f is not None:
                        f.close()
                    now, f = name, store.open_input_file(f"{base}/{name}")
                row = parse(zlib.decompress(f.read_at(length, offset), 31))
                rows.append(row if payloads else (*row[:5], None))
            names = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
            yield pd.DataFrame({n: pd.array([r[i] for r in rows], dtype="Int64") if n in ("page_id", "refers_to") else pd.Series([r[i] for r in rows], dtype="int64" if n == "payload_bytes" else "object") for i, n in enumerate(names)})
        if f is not None:
            f.close()

    # Stretches of a file go to one task each, so that large archives are read by many, and each in order.
    captures, spark = written(captures, "warc-captures"), captures.sparkSession
    folder = qualified(spark, folder)
    tasks = _tasks(spark, captures.agg(F.sum("length")).first()[0] or 0)
    dealt = captures.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInPandas(read, RECORD)


def archive(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages to archive files with their index in ``folder``; the block directory.

    Null pages have empty payloads; an empty table gives an empty archive.  Every
    row has its record, repeated rows too: one row with the smallest page_id of its
    payload is the response, all others of REVISIT_BYTES or more revisit it.  Rows
    without page_id come after all others.
    """
    pages = columns_of(pages, ["page_id", "url", "html"])
    return write_index(write_archive(pages, folder), folder)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: every page's record, as looked up by its URL and read back from the archive."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = scratch(spark, "warc")
    indexed = archive(pages, folder).agg(F.sum("lines")).first()[0] or 0
    captures = written(lookup(pages.select(url_key(F.col("url")).alias("key")), folder), "warc-found")
    found = captures.count()
    if found != indexed:
        raise ValueError(f"{indexed} records were written, but {found} are found by their URLs")
    return read_records(captures, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH rows AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), digests AS (
  SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM rows
), firsts AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first,
    row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS place FROM digests
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND place > 1 THEN first END AS refers_to
FROM firsts
"""
