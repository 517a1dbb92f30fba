"""The order tables seen as declaration records, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from declarium.functions.text import code_label, region_label
from declarium.schema import Columns

COLUMNS = Columns(
    id="id",
    entity="entity",
    date="recorded_at",
    geo="geo",
    group="grp",
    category="category",
    type_code="type_code",
    type_label="type_label",
    area="area",
)
STATUS_LABELS = {"F": "Filled", "O": "Open"}


# Declared, so that no job reads file footers just to find the columns.
SCHEMAS = {
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
    "c_mktsegment STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "region": "r_regionkey INT, r_name STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
    "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
    "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
    "value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def with_places(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with their customer, nation and region.

    No join hints: each lookup table is joined as it is, so its file size tells whether it
    is small enough to broadcast. Where customers are not, the shuffle join splits a
    customer that holds a large share of the orders.
    """
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    return (
        orders.join(customer, F.expr("o_custkey = c_custkey"))
        .join(nation, F.expr("c_nationkey = n_nationkey"))
        .join(region, F.expr("n_regionkey = r_regionkey"))
    )


def records(spark: SparkSession, folder: str, places: bool = True) -> DataFrame:
    """One record per order; without places only what the orders themselves hold."""
    source = with_places(spark, folder) if places else table(spark, folder, "orders")
    wanted = {
        "id": F.col("o_orderkey"),
        "entity": F.col("o_custkey"),
        "recorded_at": F.col("o_orderdate"),
        "category": F.col("o_orderpriority"),
        "type_code": F.col("o_orderstatus"),
        "type_label": code_label(F.col("o_orderstatus"), STATUS_LABELS),
    }
    if places:
        number = F.col("r_regionkey") + 1
        wanted |= {
            "geo": F.col("n_name"),
            "grp": region_label(number),
            "region_number": number,
            "area": F.col("c_mktsegment"),
        }
    return source.select(*[expression.alias(name) for name, expression in wanted.items()])


# A raw text file as it arrives: blanks, mixed case, missing-value spellings, unreadable
# numbers and dates. The same SQL expressions run on both engines.
DAY = "substring(CAST(o_orderdate AS STRING), 1, 10)"
RAW = {
    "id": "CAST(o_orderkey AS STRING)",
    "disasterNumber": "CAST(o_custkey AS STRING) || '.0'",
    "state": "'  ' || lower(n_name)",
    "declarationType": "CASE o_orderstatus WHEN 'F' THEN ' dr ' WHEN 'O' THEN 'em' ELSE 'zz' END",
    "declarationDate": "CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 'bad' "
    f"WHEN o_orderpriority = '1-URGENT' THEN {DAY} ELSE {DAY} || 'T00:00:00.000Z' END",
    "incidentType": "CASE c_mktsegment WHEN 'FURNITURE' THEN ' nan ' "
    "ELSE lower(o_orderpriority) || '/' || lower(c_mktsegment) END",
    "declarationTitle": "CASE o_orderpriority WHEN '2-HIGH' THEN 'None' ELSE c_name || ' ' END",
    "designatedArea": "lower(c_mktsegment) || ' (parish)'",
    "region": "CASE r_regionkey WHEN 0 THEN 'x' WHEN 1 THEN '1.0' WHEN 2 THEN '2.5' "
    "ELSE CAST(r_regionkey AS STRING) END",
    "designatedIncidentTypes": "CASE o_orderstatus WHEN 'P' THEN '<NA>' "
    "ELSE o_orderstatus || ',W' END",
    "lastRefresh": f"{DAY} || ' 12:30:00'",
}


def raw_records(spark: SparkSession, folder: str) -> DataFrame:
    return with_places(spark, folder).selectExpr(*[f"{e} AS {name}" for name, e in RAW.items()])


# The raw file with the dirt of real ones: missing, repeated and equal ids, blank places. Of some
# rows a copy comes again as it is, of others one with a later refresh or another title.
NUMBER = "CAST(id AS BIGINT)"
DIRT = {
    "id": f"CASE WHEN {NUMBER} % 11 = 0 THEN NULL ELSE id END",
    "state": f"CASE WHEN {NUMBER} % 13 = 0 THEN '   ' ELSE state END",
    "incidentType": f"CASE WHEN {NUMBER} % 17 = 0 THEN '' ELSE incidentType END",
}
CHANGED = DIRT | {
    "lastRefresh": f"CASE WHEN {NUMBER} % 2 = 0 THEN replace(lastRefresh, '12:30', '18:45') "
    "ELSE lastRefresh END",
    "declarationTitle": f"CASE WHEN {NUMBER} % 3 = 0 THEN 'other title' ELSE declarationTitle END",
}
COPIES = [(DIRT, "TRUE"), (DIRT, f"{NUMBER} % 5 = 0"), (CHANGED, f"{NUMBER} % 7 = 0")]


def dirty_records(spark: SparkSession, folder: str) -> DataFrame:
    raw = raw_records(spark, folder)
    parts = [
        raw.where(kept).selectExpr(*[f"{changed.get(c, c)} AS {c}" for c in raw.columns])
        for changed, kept in COPIES
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Titles with line breaks, quotes and commas, as a file may hold them within quotes.
BROKEN_TITLE = (
    "CASE o_orderstatus WHEN 'F' THEN 'first ' || chr(10) || 'second, \"' || c_name || '\"' "
    "WHEN 'O' THEN 'plain' ELSE chr(10) || c_mktsegment || chr(10) || chr(10) || 'end' END"
)
