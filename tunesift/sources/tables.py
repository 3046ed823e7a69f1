"""Readers for the given parquet tables and the catalogue formats (A1, A2)."""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# declared catalogue schema (no inference on a 100 TB read)
CATALOG_SCHEMA = T.StructType([
    T.StructField("track_id", T.StringType()),
    T.StructField("track_name", T.StringType()),
    T.StructField("artist_name", T.StringType()),
    T.StructField("album_name", T.StringType()),
    T.StructField("release_date", T.StringType()),
    T.StructField("popularity", T.StringType()),
    T.StructField("duration_ms", T.StringType()),
    T.StructField("explicit", T.StringType()),
    T.StructField("artist_genres", T.StringType()),
    T.StructField("release_year", T.StringType()),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


#: Quoted fields may hold commas, line breaks and doubled quotes.
CSV_OPTIONS = {"header": True, "inferSchema": False, "quote": '"', "escape": '"',
               "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": ""}


def read_catalog(spark: SparkSession, path: str, fmt: str = "csv",
                 schema: T.StructType | None = None) -> DataFrame:
    """A1: load a catalogue, columns matched by name and cast to the declared
    schema, absent columns added as nulls.

    CSV files may differ in columns and their order: the first line of every
    file is read, and each distinct header gets one read of its files (no type
    inference pass).  Whitespace, line breaks and doubled
    quotes inside quoted values are kept."""
    schema = schema or CATALOG_SCHEMA
    if fmt == "parquet":
        return _declared(spark.read.parquet(path), schema)
    out = None
    for header, files in csv_headers(spark, path):
        part = _declared(spark.read.options(**CSV_OPTIONS).option("multiLine", True).csv(files), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


#: Files whose first lines are read at a time.
HEADER_READERS = 32


def csv_headers(spark: SparkSession, path: str) -> list[tuple[str, list[str]]]:
    """(first line, files that start with it).

    The file list reaches the driver (no content is read for it), which reads
    one line of each file through Hadoop's file system and codecs, ``HEADER_READERS``
    files at a time."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def first_line(path: str):
        file = jvm.org.apache.hadoop.fs.Path(path)
        raw = file.getFileSystem(conf).open(file)
        codec = codecs.getCodec(file)
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(raw) if codec else raw, "UTF-8"))
        try:
            return reader.readLine()
        finally:
            reader.close()

    paths = [row["path"] for row in spark.read.format("binaryFile").load(path).select("path").orderBy("path").collect()]
    by: dict[str, list[str]] = {}
    with ThreadPoolExecutor(HEADER_READERS) as pool:
        for file, header in zip(paths, pool.map(first_line, paths)):
            if header is not None:  # an empty file has no rows
                by.setdefault(header, []).append(file)
    return sorted(by.items())


def _declared(df: DataFrame, schema: T.StructType) -> DataFrame:
    cols = set(df.columns)
    return df.select([(F.col(f"`{f.name}`").cast(f.dataType) if f.name in cols else F.lit(None).cast(f.dataType)).alias(f.name)
                      for f in schema.fields])


def read_seed_list(spark: SparkSession, path_glob: str, strip_notes: bool = True) -> DataFrame:
    """A2: text files, one entity per line -> (file, pos, ref).

    Lines are trimmed, blank lines dropped; a trailing ' # note' is removed
    (Q19).  ``(file, pos)`` orders entries by file and then by position in the
    file (``monotonically_increasing_id`` grows with the split offset), so
    'first occurrence' is defined without a global window or a collect.
    """
    ref = F.regexp_replace(F.col("value"), r"^\s+|\s+$", "")
    if strip_notes:
        ref = F.regexp_replace(F.regexp_replace(ref, r"\s+#.*$", ""), r"^\s+|\s+$", "")
    return (spark.read.text(path_glob)
            .select(F.input_file_name().alias("file"),
                    F.monotonically_increasing_id().alias("pos"),
                    ref.alias("ref"))
            .filter(F.col("ref") != ""))
