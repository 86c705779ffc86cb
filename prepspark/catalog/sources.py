"""Round trips through the readers and writers."""

from __future__ import annotations

from pyspark.sql import functions as F

from prepspark.catalog.base import load, query, round_doubles
from prepspark.catalog.runs import _RUNS, _SCORES, run_events, run_table
from prepspark.operators import profile, runs
from prepspark.session import scratch_path
from prepspark.sources import files


@query("scan_csv", "SELECT * FROM orders")
def scan_csv(spark, d):
    o = load(spark, d, "orders")
    path = files.sink_stage(o, scratch_path(spark, "csv"), "orders", "csv")
    return files.scan_csv(spark, path, o.schema)


@query("scan_csv_inferred", "SELECT s_suppkey::INTEGER AS s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def scan_csv_inferred(spark, d):
    path = files.sink_stage(load(spark, d, "supplier"), scratch_path(spark, "csv"), "supplier", "csv")
    return files.scan_csv(spark, path)


@query("scan_csv_documents", "SELECT doc_id, text FROM documents")
def scan_csv_documents(spark, d):
    """Texts with line breaks, quotes and commas come back as they were."""
    docs = load(spark, d, "documents").select("doc_id", "text")
    return files.scan_csv(spark, files.sink_stage(docs, scratch_path(spark, "csv"), "docs", "csv"), docs.schema)


@query("scan_csv_parts", "SELECT doc_id, text, source FROM documents")
def scan_csv_parts(spark, d):
    """The same, every file read by byte ranges that start and end anywhere, inside quotes too."""
    docs = load(spark, d, "documents").select("doc_id", "text", "source")
    return files.scan_csv(spark, files.sink_stage(docs, scratch_path(spark, "csv"), "docs", "csv"), docs.schema, parts=True)


@query("scan_csv_parts_inferred", "SELECT s_suppkey::INTEGER AS s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def scan_csv_parts_inferred(spark, d):
    path = files.sink_stage(load(spark, d, "supplier"), scratch_path(spark, "csv"), "supplier", "csv")
    return files.scan_csv(spark, path, parts=True)


@query("scan_csv_corrupt", "SELECT count(*)::BIGINT AS n_rows, count(*) FILTER (o_orderkey % 9 = 0)::BIGINT AS bad, count(*) FILTER (o_orderkey % 9 <> 0)::BIGINT AS keys FROM orders")
def scan_csv_corrupt(spark, d):
    """Cells that are no numbers are counted, not lost."""
    o = load(spark, d, "orders")
    raw = o.select(F.when(F.col("o_orderkey") % 9 == 0, "oops").otherwise(F.col("o_orderkey").cast("string")).alias("o_orderkey"), "o_orderstatus")
    path = files.sink_stage(raw, scratch_path(spark, "csv"), "orders", "csv")
    got = files.scan_csv(spark, path, "o_orderkey bigint, o_orderstatus string", keep_corrupt=True).cache()
    return got.agg(F.count("*").alias("n_rows"), F.count(files.CORRUPT).alias("bad"), F.count("o_orderkey").alias("keys"))


@query("scan_csv_encoding", "SELECT doc_id, text, 'ISO-8859-1' AS stored FROM documents UNION ALL SELECT doc_id, text, 'UTF-8' FROM documents")
def scan_csv_encoding(spark, d):
    """The same texts stored in either encoding, side by side in one folder, read back alike."""
    docs, root = load(spark, d, "documents").select("doc_id", "text"), scratch_path(spark, "csv")
    for encoding in ("ISO-8859-1", "UTF-8"):
        files.sink_stage(docs.withColumn("stored", F.lit(encoding)), root, "docs", "csv", "append", encoding)
    return files.scan_csv_encoding(spark, f"{root}/docs", "doc_id bigint, text string, stored string")


@query("sink_stage", "SELECT 'parquet' AS stored, * FROM customer UNION ALL SELECT 'csv', * FROM customer")
def sink_stage(spark, d):
    c, root = load(spark, d, "customer"), scratch_path(spark, "stages")
    a = spark.read.parquet(files.sink_stage(c, root, "cleaned"))
    b = files.scan_csv(spark, files.sink_stage(c, root, "cleaned_csv", "csv"), c.schema)
    return a.withColumn("stored", F.lit("parquet")).unionByName(b.withColumn("stored", F.lit("csv")))


@query("scan_run_results", f"WITH {_SCORES}{_RUNS} SELECT run_id, seconds, ptma FROM r JOIN s USING (run_id) WHERE cof < 1.5")
def scan_run_results(spark, d):
    """Two result sets; only the newer one counts, without its failed records."""
    e = load(spark, d, "events")
    scored = run_table(e).join(runs.run_autonomy(run_events(e)).select("run_id", "ptma", "cof"), "run_id")
    records = scored.select("run_id", "seconds", "ptma", F.when(F.col("cof") >= 1.5, "too many corrections").alias("error"))
    root = scratch_path(spark, "results")
    files.sink_report(records.withColumn("ptma", F.lit(-1.0)), f"{root}/results_1")
    files.sink_report(records, f"{root}/results_2")
    return files.scan_run_results(spark, f"{root}/results_*", "run_id bigint, seconds double, ptma double")


@query("scan_run_results_array", f"WITH {_SCORES}{_RUNS} SELECT run_id, seconds, ptma FROM r JOIN s USING (run_id) WHERE cof < 1.5")
def scan_run_results_array(spark, d):
    """The same with a newer set whose files are JSON arrays."""
    e = load(spark, d, "events")
    scored = run_table(e).join(runs.run_autonomy(run_events(e)).select("run_id", "ptma", "cof"), "run_id")
    records = scored.select("run_id", "seconds", "ptma", F.when(F.col("cof") >= 1.5, "too many corrections").alias("error"))
    root = scratch_path(spark, "results")
    files.sink_report(records.withColumn("ptma", F.lit(-1.0)), f"{root}/results_1")
    files.sink_report(records, f"{root}/results_2", array=True)
    return files.scan_run_results(spark, f"{root}/results_*", "run_id bigint, seconds double, ptma double")


@query("sink_report", """SELECT 'o_orderkey' AS "column", 0::BIGINT AS missing, 0.0::DOUBLE AS missing_pct UNION ALL SELECT 'o_custkey', count(*) - count(o_custkey), 0.0 FROM orders
UNION ALL SELECT 'o_orderstatus', 0, 0.0 UNION ALL SELECT 'o_totalprice', 0, 0.0 UNION ALL SELECT 'o_orderdate', 0, 0.0 UNION ALL SELECT 'o_orderpriority', 0, 0.0""")
def sink_report(spark, d):
    report = profile.profile_missing(load(spark, d, "orders"))
    path = files.sink_report(report, scratch_path(spark, "report"))
    return round_doubles(spark.read.schema(report.schema).json(path))
