"""Registration, table loading and SQL fragments shared by the catalogue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prepspark.functions.columns import spread  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where one exists, the SQL that gives the same rows."""
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def rnd(name: str, digits: int = 6) -> Column:
    """Rounded column under its own name; -0.0 becomes 0.0."""
    return (F.round(F.col("`" + name + "`").cast("double"), digits) + F.lit(0.0)).alias(name)


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[rnd(c, digits) if t in ("double", "float") else F.col("`" + c + "`") for c, t in df.dtypes])


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


def tables_union(build: Callable[[str], DataFrame], tables: list[str]) -> DataFrame:
    out = None
    for t in tables:
        one = build(t).withColumn("table", F.lit(t))
        out = one if out is None else out.unionByName(one)
    return out


NUM4 = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ITEM_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]

# Column kinds of the tables used for role rules, in schema order.
SCHEMAS: dict[str, list[tuple[str, str]]] = {
    "orders": [
        ("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "string"), ("o_totalprice", "numeric"),
        ("o_orderdate", "datetime"), ("o_orderpriority", "string"),
    ],
    "lineitem": [
        ("l_orderkey", "numeric"), ("l_partkey", "numeric"), ("l_suppkey", "numeric"), ("l_linenumber", "numeric"),
        ("l_quantity", "numeric"), ("l_extendedprice", "numeric"), ("l_discount", "numeric"), ("l_tax", "numeric"),
        ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "datetime"),
    ],
    "events": [
        ("event_id", "numeric"), ("ts", "datetime"), ("user_id", "numeric"), ("event_type", "string"), ("value", "numeric"),
        ("props", "string"),
    ],
    "documents": [
        ("doc_id", "numeric"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "numeric"),
    ],
    "conversations": [("conv_id", "numeric"), ("turn", "numeric"), ("role", "string"), ("text", "string")],
    "labels": [("doc_id", "numeric"), ("quality", "numeric"), ("toxic", "numeric")],
}


def profile_sql(table: str) -> str:
    """One row per column: position, name, kind, rows, missing cells, distinct values, mean text length."""
    return union_all([
        f"SELECT {i} AS ord, '{c}' AS name, '{k}' AS kind, count(*) AS n, count(*) - count({c}) AS missing, "
        f"count(DISTINCT {c}) AS nd, {'avg(length(' + c + '))' if k == 'string' else 'NULL::DOUBLE'} AS len FROM {table}"
        for i, (c, k) in enumerate(SCHEMAS[table])
    ])


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with missing cells: one seventh of two columns, most of a third."""
    n = F.col("l_linenumber")
    return load(spark, sf_dir, "lineitem").select(
        *ITEM_KEYS, F.when(n != 3, F.col("l_quantity")).alias("l_quantity"), "l_extendedprice", "l_discount",
        F.when(n <= 3, F.col("l_tax")).alias("l_tax"), F.when(n != 5, F.col("l_returnflag")).alias("l_returnflag"), "l_linestatus",
    )


GAPS = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CASE WHEN l_linenumber <> 3 THEN l_quantity END AS l_quantity, l_extendedprice, l_discount,
  CASE WHEN l_linenumber <= 3 THEN l_tax END AS l_tax,
  CASE WHEN l_linenumber <> 5 THEN l_returnflag END AS l_returnflag, l_linestatus FROM lineitem"""
GAP_COLUMNS = [*ITEM_KEYS, *NUM4, "l_returnflag", "l_linestatus"]


def doubled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with every tenth row twice."""
    o = load(spark, sf_dir, "orders")
    return o.unionByName(o.where(F.col("o_orderkey") % 10 == 0))


DOUBLED = "SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 10 = 0"
