"""Report sinks: one JSON document per row plus a markdown table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def markdown_lines(df: DataFrame) -> DataFrame:
    """Rows as markdown table lines (without header), one ``value`` column."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("—")) for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def markdown_header(df: DataFrame) -> str:
    return f"| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}"


def write_report(df: DataFrame, path: str) -> None:
    """Write ``<path>/json`` and ``<path>/markdown`` (header in its own first file)."""
    spark = df.sparkSession
    df.write.mode("overwrite").json(f"{path}/json")
    markdown_lines(df).write.mode("overwrite").text(f"{path}/markdown/body")
    spark.createDataFrame([(markdown_header(df),)], "value string").coalesce(1).write.mode("overwrite").text(
        f"{path}/markdown/header"
    )
