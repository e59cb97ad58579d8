"""Ad-hoc SQL: statements are classified, only reading ones run, and parameters are bound by name."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Query texts with named parameters, over the views that callers register.
TEMPLATES = {
    "large_documents": "SELECT entry_id, length(content) AS chars FROM entries WHERE length(content) > :least ORDER BY chars DESC, entry_id",
    "recent_cards": "SELECT number, project_id FROM cards WHERE `column` = :column ORDER BY created DESC, number",
    "failed_jobs": "SELECT job_id, count(*) AS errors FROM job_events WHERE state = :state GROUP BY job_id",
    "domain_stats": "SELECT domain, count(*) AS pages, sum(length(html)) AS chars FROM pages_by_domain GROUP BY domain",
    "storage_analysis": "SELECT domain, count(*) AS pages, sum(length(html)) AS chars, round(avg(length(html)), 6) AS mean FROM pages_by_domain GROUP BY domain",
}
_LEADING = re.compile(r"^(?:\s|--[^\n]*(?:\n|$)|/\*.*?\*/)*", re.S)


def statement_kind(text: str) -> str:
    """select, insert, update, delete, create, drop, alter or other, by the first word; WITH counts as select."""
    rest = _LEADING.sub("", text, count=1)
    word = re.match(r"[A-Za-z]*", rest).group().lower()
    if word in ("select", "with"):
        return "select"
    return word if word in ("insert", "update", "delete", "create", "drop", "alter") else "other"


def is_identifier(name: str) -> bool:
    return name.isidentifier()


def run_safely(spark: SparkSession, text: str, parameters: dict[str, Any] | None = None, limit: int | None = 1000, offset: int = 0) -> DataFrame:
    """Run a reading statement with named parameters; rows are cut by the DataFrame, whatever the text says."""
    if statement_kind(text) != "select":
        raise PermissionError(f"only SELECT and WITH statements may run, not {statement_kind(text)}")
    rows = spark.sql(text, args=parameters or {})
    rows = rows.offset(offset) if offset else rows
    return rows if limit is None else rows.limit(limit)


def browse(spark: SparkSession, name: str, limit: int = 100, offset: int = 0, order_by: str | None = None, descending: bool = False) -> DataFrame:
    """Rows of a table or view, in the order of one column; names must be plain identifiers."""
    if not all(is_identifier(x) for x in (name, *([order_by] if order_by else []))):
        raise ValueError("not an identifier")
    rows = spark.table(name)
    if order_by:
        rows = rows.orderBy(rows[order_by].desc() if descending else rows[order_by].asc())
    return rows.offset(max(0, offset)).limit(min(max(0, limit), 1000))


def describe(spark: SparkSession, name: str) -> list[tuple[str, str, bool]]:
    """Columns of a table or view: name, type, whether it may be null."""
    if not is_identifier(name):
        raise ValueError("not an identifier")
    return [(f.name, f.dataType.simpleString(), f.nullable) for f in spark.table(name).schema]


def table_report(tables: dict[str, DataFrame]) -> DataFrame:
    """A row for each table: name, columns, rows."""
    out = None
    for name, df in sorted(tables.items()):
        part = df.agg(F.lit(name).alias("table"), F.lit(len(df.columns)).alias("columns"), F.count("*").alias("rows"))
        out = part if out is None else out.unionByName(part)
    return out


def schema_report(tables: dict[str, DataFrame]) -> DataFrame:
    """A row for each column: table, position, column, type, and the rows of its table, counted once a table."""
    out = None
    for name, df in sorted(tables.items()):
        kind = lambda t: t.simpleString().removesuffix("_ntz")
        columns = F.array(*(F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.lit(kind(f.dataType)).alias("type")) for i, f in enumerate(df.schema, 1)))
        part = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), F.inline(columns), "rows")
        out = part if out is None else out.unionByName(part)
    return out


def folder_tables(spark: SparkSession, folder: str) -> list[str]:
    """Names of the Parquet tables in a folder of any file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(n[:-8] for n in (s.getPath().getName() for s in found) if n.endswith(".parquet"))
