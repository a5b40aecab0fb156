"""Lists as a client shows them: sorting by one column, texts that ask for confirmation, packets of strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: So many names stand in a question; the others are counted.
NAMED = 10


def toggled(current: tuple[str, bool] | None, column: str) -> tuple[str, bool]:
    """The sorting (column, rising) after a click on a column: rising, or the other way if it was sorted by that one."""
    return (column, not current[1]) if current and current[0] == column else (column, True)


def sorted_view(rows: DataFrame, sorting: tuple[str, bool]) -> DataFrame:
    """All rows sorted by one column, ranges of it in parallel."""
    column, rising = sorting
    return rows.orderBy(F.col(column).asc() if rising else F.col(column).desc())


def confirmation(items: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """(keys, text): names of the first NAMED items a key, one a line, and how many others there are.

    Counts are sums of parts; of a key's items no more than NAMED a task are shuffled.
    """
    sizes = items.groupBy(*keys).agg(F.count("*").alias("size"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    first = items.select(*keys, order, name).withColumn("place", rank).filter(F.col("place") <= NAMED)
    named = first.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.col(name).alias("name")))), lambda e: e["name"]), "\r\n").alias("names"))
    others = F.when(F.col("size") > NAMED, F.format_string("\r\n\r\n他%d個", F.col("size") - NAMED)).otherwise("")
    return named.join(sizes, keys).select(*keys, F.concat("names", others).alias("text"))


def packet_sizes(parts: DataFrame, keys: list[str], part: Column) -> DataFrame:
    """(keys, plain, chunked): bytes of a key's parts one after another, and with a length of four bytes before each."""
    size = F.coalesce(F.sum(F.octet_length(part)), F.lit(0))
    return parts.groupBy(*keys).agg(size.alias("plain"), (size + 4 * F.count("*")).alias("chunked"))
