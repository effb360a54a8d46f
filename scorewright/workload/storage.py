"""Sources and sinks."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from scorewright.session import materialise, new_path
from scorewright.sources import files, snapshots, tables
from scorewright.workload.frames import table

ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
_ORDER_DDL = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"


def _orders(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(*ORDER_COLUMNS)


def scan_csv(spark, sf_dir):
    """Orders written as CSV with missing-value tokens, and read back by schema."""
    path = new_path(spark, "csv")
    price = F.when(F.col("o_orderpriority") == "5-LOW", "N/A").otherwise(F.col("o_totalprice").cast("string"))
    _orders(spark, sf_dir).withColumn("o_totalprice", price).write.option("header", True).csv(path)
    return files.scan_csv(spark, path, _ORDER_DDL)


def scan_csv_inferred(spark, sf_dir):
    """The same without a schema."""
    path = new_path(spark, "csv")
    _orders(spark, sf_dir).write.option("header", True).csv(path)
    rows = files.scan_csv(spark, path)
    return rows.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "o_orderstatus", "o_totalprice")


def preview(spark, sf_dir):
    return files.preview(_orders(spark, sf_dir), 10, ["o_orderkey"])


def scan_table(spark, sf_dir):
    return tables.scan_table(spark, f"{sf_dir}/orders.parquet", ["o_orderkey", "o_custkey", "o_totalprice"])


def replace_table(spark, sf_dir):
    """Write the open orders, replace them by all, read back."""
    path = new_path(spark, "flat")
    orders = _orders(spark, sf_dir)
    tables.replace_table(orders.where("o_orderstatus = 'O'"), path)
    return tables.replace_table(orders, path)


def refresh_table(spark, sf_dir):
    """Rebuild a per-customer result table from each status in turn, then from all orders."""
    path = new_path(spark, "result")
    orders = _orders(spark, sf_dir)

    def result(rows: DataFrame) -> DataFrame:
        return rows.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))

    for status in ("F", "O", "P"):
        tables.refresh_table(result(orders.where(F.col("o_orderstatus") == status)), path)
    return tables.refresh_table(result(orders), path)


def _upsert_batch(orders: DataFrame) -> DataFrame:
    """Two conflicting changes per pending order, and a new key for each."""
    pending = orders.where("o_orderstatus = 'P'")
    first = pending.withColumns({"o_orderstatus": F.lit("X"), "seq": F.lit(1)})
    second = pending.withColumns({"o_orderstatus": F.lit("Y"), "o_totalprice": F.col("o_totalprice") + 1, "seq": F.lit(2)})
    added = pending.withColumns({"o_orderkey": -F.col("o_orderkey") - 1, "seq": F.lit(1)})
    return first.unionByName(second).unionByName(added)


def upsert_latest(spark, sf_dir):
    orders = _orders(spark, sf_dir)
    return tables.upsert_latest(orders, _upsert_batch(orders), ["o_orderkey"], ["seq"])


def upsert_table(spark, sf_dir):
    """Upsert into a stored table, kept as a new one."""
    old, out = new_path(spark, "old"), new_path(spark, "new")
    orders = _orders(spark, sf_dir)
    tables.replace_table(orders, old)
    return tables.upsert_table(spark, old, _upsert_batch(orders), ["o_orderkey"], ["seq"], out)


def upsert_bucketed(spark, sf_dir):
    """The same batch into a table bucketed by key."""
    path, orders = new_path(spark, "bucketed"), _orders(spark, sf_dir)
    snapshots.replace_snapshot(orders, path, ["o_orderkey"], 16)
    return snapshots.upsert_snapshot(spark, path, _upsert_batch(orders), ["o_orderkey"], ["seq"])


def upsert_two_loads(spark, sf_dir):
    """Two loads accumulate: finished and open orders, then open (changed) and pending ones."""
    path, orders = new_path(spark, "loads"), _orders(spark, sf_dir).withColumn("seq", F.lit(1))
    second = orders.where("o_orderstatus <> 'F'").withColumn(
        "o_totalprice", F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    snapshots.upsert_snapshot(spark, path, orders.where("o_orderstatus <> 'P'"), ["o_orderkey"], ["seq"], buckets=16)
    return snapshots.upsert_snapshot(spark, path, second, ["o_orderkey"], ["seq"]).drop("seq")


def scan_csv_tokens(spark, sf_dir):
    """Orders written as CSV with missing-value tokens in number columns, read without a schema."""
    path = new_path(spark, "csv")
    token = lambda c: F.when(F.col("o_orderpriority") == "5-LOW", "N/A").otherwise(F.col(c).cast("string"))
    _orders(spark, sf_dir).withColumns({c: token(c) for c in ("o_custkey", "o_totalprice")}).write.option("header", True).csv(path)
    return files.scan_csv(spark, path).withColumn("o_orderkey", F.col("o_orderkey").cast("bigint"))


def apply_status_updates(spark, sf_dir):
    """Orders as actions; pending ones are resolved, then half of them reopened or given a bad status."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.lit("PENDING").alias("status"), "o_orderstatus", "o_orderpriority"
    )
    actions = orders.select("id", "status")
    chosen = orders.where("o_orderstatus = 'P'")
    updates = (
        chosen.select("id", F.lit("RESOLVED").alias("status"), F.lit(1).alias("seq"))
        .unionByName(chosen.where("o_orderpriority = '1-URGENT'").select("id", F.lit("PENDING").alias("status"), F.lit(2).alias("seq")))
        .unionByName(chosen.where("o_orderpriority = '5-LOW'").select("id", F.lit("LOST").alias("status"), F.lit(3).alias("seq")))
    )
    return tables.apply_status_updates(actions, updates)


def load_counts(spark, sf_dir):
    source = {name: table(spark, sf_dir, name) for name in ("customer", "orders", "lineitem")}
    return tables.load_counts(source, new_path(spark, "load"))[1]


# --- workbooks, made from the customers by Spark tasks ---------------------------

_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="xml" ContentType="application/xml"/></Types>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
    'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>'
    '<sheet name="Customers" sheetId="1" r:id="rId1"/><sheet name="Settings" sheetId="2" r:id="rId2"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="worksheets/sheet2.xml"/>'
    "</Relationships>",
}


def _sheet_xml(header: list[str], rows) -> str:
    def cell(value) -> str:
        if value is None:
            return "<c/>"
        if isinstance(value, str):
            return f'<c t="inlineStr"><is><t>{escape(value)}</t></is></c>'
        return f"<c><v>{value!r}</v></c>"

    lines = ["<row>" + "".join(map(cell, row)) + "</row>" for row in [header, *rows]]
    return (
        '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
        + "".join(lines) + "</sheetData></worksheet>"
    )


def pack_workbooks(df: DataFrame) -> DataFrame:
    """(path, content) of small workbooks with sheets "Customers" and "Settings".

    One per nation and block of 500 customer numbers, so no group grows with the data.
    """
    columns = df.columns

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf[columns].astype(object).to_numpy().tolist()
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
            for name, text in _PARTS.items():
                book.writestr(name, text)
            book.writestr("xl/worksheets/sheet1.xml", _sheet_xml(columns, rows))
            book.writestr("xl/worksheets/sheet2.xml", _sheet_xml(["Setting", "Value"], [["nation", str(key[0])]]))
        return pd.DataFrame({"path": [f"nation-{key[0]}-{key[1]}.xlsx"], "content": [out.getvalue()]})

    block = F.floor(F.col("c_custkey") / 500)
    return df.withColumn("_block", block).groupBy("c_nationkey", "_block").applyInPandas(
        pack, "path string, content binary"
    )


def ingest_workbooks(spark, sf_dir):
    books = materialise(pack_workbooks(table(spark, sf_dir, "customer")), "workbooks")
    rows = files.read_workbooks(
        books, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
        sheet="Customers",
    )
    return rows.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "sheet")


def list_sheets(spark, sf_dir):
    sheets = files.read_sheet_names(pack_workbooks(table(spark, sf_dir, "customer")))
    return sheets.groupBy("position", "sheet").agg(F.count(F.lit(1)).alias("workbooks"))


QUERIES = {
    "scan_csv": scan_csv,
    "scan_csv_inferred": scan_csv_inferred,
    "preview": preview,
    "ingest_workbooks": ingest_workbooks,
    "list_sheets": list_sheets,
    "scan_table": scan_table,
    "replace_table": replace_table,
    "refresh_table": refresh_table,
    "upsert_latest": upsert_latest,
    "upsert_table": upsert_table,
    "upsert_bucketed": upsert_bucketed,
    "upsert_two_loads": upsert_two_loads,
    "scan_csv_tokens": scan_csv_tokens,
    "apply_status_updates": apply_status_updates,
    "load_counts": load_counts,
}

_UPSERTED = """
    select o_orderkey, o_custkey, case when o_orderstatus = 'P' then 'Y' else o_orderstatus end as o_orderstatus,
           case when o_orderstatus = 'P' then o_totalprice + 1 else o_totalprice end as o_totalprice, o_orderpriority
    from orders
    union all
    select -o_orderkey - 1, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders where o_orderstatus = 'P'
"""
_COLUMNS = ", ".join(ORDER_COLUMNS)
ORACLES = {
    "scan_csv": "select o_orderkey, o_custkey, o_orderstatus, "
    "case when o_orderpriority = '5-LOW' then null else o_totalprice end as o_totalprice, o_orderpriority from orders",
    "scan_csv_inferred": "select o_orderkey, o_orderstatus, o_totalprice from orders",
    "preview": f"select {_COLUMNS} from orders order by o_orderkey limit 10",
    "ingest_workbooks": "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, 'Customers' as sheet from customer",
    "list_sheets": "with b as (select distinct c_nationkey, c_custkey // 500 as block from customer) "
    "select cast(0 as int) as position, 'Customers' as sheet, count(*) as workbooks from b "
    "union all select cast(1 as int), 'Settings', count(*) from b",
    "scan_table": "select o_orderkey, o_custkey, o_totalprice from orders",
    "replace_table": f"select {_COLUMNS} from orders",
    "refresh_table": "select o_custkey, count(*) as orders from orders group by o_custkey",
    "upsert_latest": _UPSERTED,
    "upsert_table": _UPSERTED,
    "upsert_bucketed": _UPSERTED,
    "upsert_two_loads": "select o_orderkey, o_custkey, o_orderstatus, case when o_orderstatus = 'O' then o_totalprice + 1 else o_totalprice end "
    "as o_totalprice, o_orderpriority from orders",
    "scan_csv_tokens": "select o_orderkey, case when o_orderpriority <> '5-LOW' then o_custkey end as o_custkey, o_orderstatus, "
    "case when o_orderpriority <> '5-LOW' then o_totalprice end as o_totalprice, o_orderpriority from orders",
    "apply_status_updates": "select o_orderkey as id, case when o_orderstatus = 'P' and o_orderpriority <> '1-URGENT' "
    "then 'RESOLVED' else 'PENDING' end as status from orders",
    "load_counts": "select 'customer' as table_name, count(*) as rows_loaded from customer "
    "union all select 'orders', count(*) from orders union all select 'lineitem', count(*) from lineitem",
}
