"""CSV, JSON and Parquet readers and writers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepspark.functions.columns import col
from prepspark.sources import quoted

CORRUPT = "_corrupt_record"
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"


def infer_csv_schema(spark: SparkSession, path: str, share: float = 1.0, encoding: str = "UTF-8") -> T.StructType:
    """Column types from the whole file, or from a share of its rows where one is asked for."""
    return spark.read.csv(path, header=True, inferSchema=True, samplingRatio=share, encoding=encoding, multiLine=True, escape='"').schema


def scan_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None, encoding: str | None = "UTF-8", null_value: str = "",
    keep_corrupt: bool = False, multi_line: bool = True, parts: bool | None = None,
) -> DataFrame:
    """Header CSV. With a schema the file is read once; without one the types are inferred first.

    A row that does not fit the schema ends the read, unless ``keep_corrupt`` asks for its text in
    ``_corrupt_record`` (null in good rows). Line breaks inside quotes belong to the cell. Files larger than a split are read in
    parts by ``quoted.scan_quoted``, which needs quotes that balance; smaller ones by one task each. ``parts`` forces either way,
    the rows are the same. A caller who knows that no cell holds a line break may set ``multi_line=False``. In parts, ``encoding=None``
    finds the encoding of each file.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if schema is not None and keep_corrupt:
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    ascii_bytes = encoding is None or not encoding.upper().replace("-", "").startswith(("UTF16", "UTF32"))
    if ascii_bytes and _in_parts(spark, path, parts, multi_line):
        options = {"nullValue": null_value, "escape": '"', "multiLine": "true", "timestampNTZFormat": TIMESTAMP_FORMAT}
        options |= {"columnNameOfCorruptRecord": CORRUPT, "mode": "PERMISSIVE"} if keep_corrupt or schema is None else {"mode": "FAILFAST"}
        return quoted.scan_quoted(spark, path, schema, options, encoding)
    if encoding is None:
        raise ValueError("without parts a read needs an encoding")
    reader = spark.read.options(
        header=True, encoding=encoding, nullValue=null_value, multiLine=multi_line, escape='"', timestampNTZFormat=TIMESTAMP_FORMAT,
    )
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    if keep_corrupt:
        return reader.option("columnNameOfCorruptRecord", CORRUPT).option("mode", "PERMISSIVE").schema(schema).csv(path)
    # only parsed cells are checked, so all of them are parsed
    return reader.option("mode", "FAILFAST").option("enforceSchema", True).schema(schema).csv(path)


def _in_parts(spark: SparkSession, path: str | list[str], parts: bool | None = None, multi_line: bool = True) -> bool:
    return multi_line and bool(parts or (parts is None and _beyond_split(spark, path)))


def _beyond_split(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether some file is larger than a split; reads file sizes only."""
    largest = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0
    bound = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return largest > bound


def file_encodings(spark: SparkSession, path: str) -> DataFrame:
    """(file, encoding) of every file: UTF-8 unless some line of it is not valid UTF-8; then ISO-8859-1."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.is_valid_utf8("value").alias("ok"))
    return lines.groupBy("file").agg(F.when(F.bool_and("ok"), "UTF-8").otherwise("ISO-8859-1").alias("encoding"))


def scan_csv_encoding(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """As ``scan_csv``, each file in the encoding found from its own bytes; the files of either encoding are read together.

    With a schema, files that are read in parts are all read by one scan; its count of quotes tells the encodings too. Else paths are
    listed on the driver, as Spark's own file listing does.
    """
    if schema is not None and _in_parts(spark, path, options.get("parts"), options.get("multi_line", True)):
        return scan_csv(spark, path, schema, None, **{**options, "parts": True})
    files: dict[str, list[str]] = {}
    for r in file_encodings(spark, path).toLocalIterator():
        files.setdefault(r["encoding"], []).append(r["file"])
    if not files:
        return scan_csv(spark, path, schema, **options)
    parts = [scan_csv(spark, paths, schema, encoding, **options) for encoding, paths in sorted(files.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sink_stage(df: DataFrame, root: str, stage: str, fmt: str = "parquet", mode: str = "overwrite", encoding: str = "UTF-8") -> str:
    """Write a stage's table below ``root`` and return its path."""
    path = f"{root.rstrip('/')}/{stage}"
    writer = df.write.mode(mode)
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt == "csv":
        writer.options(header=True, escape='"', encoding=encoding, timestampNTZFormat=TIMESTAMP_FORMAT).csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        raise ValueError(f"unknown format '{fmt}'")
    return path


def sink_report(report: DataFrame, path: str, mode: str = "overwrite", array: bool = False) -> str:
    """A tidy report as JSON lines, or, with ``array``, every file as one JSON array with a record per line."""
    if not array:
        report.write.mode(mode).json(path)
        return path

    def bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({"value": ["[" if held is None else f"  {held},"]})
                held = text
        if held is not None:
            yield pa.RecordBatch.from_pydict({"value": [f"  {held}", "]"]})

    report.select(F.to_json(F.struct(*[col(c) for c in report.columns])).alias("value")).mapInArrow(bracketed, "value string").write.mode(mode).text(path)
    return path


def newest_path(spark: SparkSession, pattern: str) -> str | None:
    """Newest file matching the glob; files of one folder written together count as that folder.

    Lists files through the reader's metadata only, no content is read.
    """
    listed = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")
    folder = F.regexp_replace("path", r"/part-[^/]*$", "")
    newest = listed.groupBy(folder.alias("p")).agg(F.max("modificationTime").alias("t")).orderBy(F.desc("t"), F.desc("p")).limit(1).collect()
    return newest[0]["p"] if newest else None


def scan_run_results(spark: SparkSession, pattern: str, schema: T.StructType | str) -> DataFrame:
    """Records of the newest result set that carry no ``error``.

    A file holds one record per line, or one JSON array of records, laid out in any way; the files of a set may be of
    either kind. What is not JSON, or does not fit the schema, ends the read.
    """
    path = newest_path(spark, pattern)
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if path is None:
        raise FileNotFoundError(pattern)
    if "error" not in schema.names:
        schema = T.StructType([*schema.fields, T.StructField("error", T.StringType())])
    found = [_json(spark, files, schema, arrays) for arrays, files in json_layouts(spark, path).items()]
    out = found[0] if found else spark.createDataFrame([], schema)
    for more in found[1:]:
        out = out.unionByName(more)
    return out.where(col("error").isNull()).drop("error")


def json_layouts(spark: SparkSession, path: str) -> dict[bool, list[str]]:
    """Files by whether their first character that is not blank opens an array; files without content are left out."""
    text = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"),
        F.ltrim("value").alias("value")).where("value <> ''")
    first = text.groupBy("file").agg(F.min_by(F.substring("value", 1, 1), F.struct("block", "row")).alias("c"))
    out: dict[bool, list[str]] = {}
    for r in first.toLocalIterator():
        out.setdefault(r["c"] == "[", []).append(r["file"])
    return out


def _json(spark: SparkSession, paths: list[str], schema: T.StructType, arrays: bool) -> DataFrame:
    return spark.read.schema(schema).options(multiLine=arrays, mode="FAILFAST").json(paths)
