"""CSV seed files: # comments, a header, \\N for null, binaries in hex, doubled quotes inside JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_seed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A seed file with the given columns; binary columns are written in hex."""
    plain = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.BinaryType) else f.dataType, True) for f in schema])
    rows = spark.read.csv(path, schema=plain, header=True, comment="#", nullValue="\\N", quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return rows.select(*[F.unhex(f.name).alias(f.name) if isinstance(f.dataType, T.BinaryType) else F.col(f.name) for f in schema])
