"""Order-dependent steps of one page at a time.

The rows of a page are gathered in one array (a page has tens of blocks) and a kernel over whole
Arrow batches of pages answers with places in it, which are then exploded natively. That avoids a
Python call and a data frame for every page.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

PLACE = ArrayType(StructType([StructField("at", IntegerType()), StructField("value", IntegerType())]))
_PLACE = pa.list_(pa.struct([("at", pa.int32()), ("value", pa.int32())]))


def by_page(rows: DataFrame, page: str, sort: list[str], kernel: Callable[..., list[tuple[int, int]]], fields: dict[str, Column], name: str | None) -> DataFrame:
    """rows that the kernel returns for each page as (place, value), with the value as column `name` where one is given.

    fields: what the kernel gets of each row, as lists, in the order of `sort`.
    """

    @F.arrow_udf(PLACE)
    def places(pages: pa.Array) -> pa.Array:
        out = []
        for page_rows in pages.to_pylist():
            out.append([{"at": a, "value": v} for a, v in kernel(*([r[f] for r in page_rows] for f in names))])
        return pa.array(out, _PLACE)

    names = list(fields)
    row = F.struct(*(F.col(c) for c in sort), F.struct(*rows.columns).alias("_row"), F.struct(*(fields[n].alias(n) for n in names)).alias("_fields"))
    pages = rows.groupBy(page).agg(F.array_sort(F.collect_list(row), lambda a, b: _compare(a, b, sort)).alias("_rows"))
    found = pages.withColumn("_places", places(F.transform("_rows", lambda r: r["_fields"])))
    picked = F.transform("_places", lambda p: F.struct(F.get("_rows", p["at"])["_row"].alias("row"), p["value"].alias("value")))
    out = found.select(page, picked.alias("_picked")).select(page, F.explode("_picked").alias("_p"))  # the page stays the grouping column, so later steps need no exchange
    extra = [F.col("_p.value").alias(name)] if name else []
    return out.select(*(F.col(page) if c == page else F.col(f"_p.row.{c}").alias(c) for c in rows.columns if c != name), *extra)


def _compare(a: Column, b: Column, keys: list[str]) -> Column:
    out = F.lit(0)
    for k in reversed(keys):
        out = F.when(a[k] < b[k], -1).when(a[k] > b[k], 1).otherwise(out)
    return out


def boxes(column: Column) -> Column:
    return F.array(column.x0, column.y0, column.x1, column.y1)
