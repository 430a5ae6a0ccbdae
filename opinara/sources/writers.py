"""Writers: tables, checkpoint appends, run metadata."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "errorifexists"
) -> None:
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def append_results(df: DataFrame, path: str, batch: int, column: str = "batch") -> None:
    """Put one batch of result rows into a checkpoint table, as the partition ``column`` = ``batch``.

    A batch owns its partition and replaces it whole: a batch that is run again leaves one copy of its rows, also
    when it now has none, and other batches stay as they are.
    """
    if column in df.columns:
        raise ValueError(f"the rows have a column {column} already")
    df.write.mode("overwrite").parquet(f"{path}/{column}={int(batch)}")


def run_metadata(sections: Mapping[str, DataFrame], settings: Mapping[str, object] | None = None) -> DataFrame:
    """One row: each one-row section becomes a struct column, settings a map of text."""
    cols: list[Column] = []
    first: DataFrame | None = None
    for name, section in sections.items():
        row = section.select(F.struct(*section.columns).alias(name))
        if first is None:
            first = row
            cols.append(F.col(name))
        else:
            cols.append(row.scalar().alias(name))
    if first is None:
        raise ValueError("run_metadata needs at least one section")
    if settings:
        pairs = [F.lit(str(x)) for kv in settings.items() for x in kv]
        cols.append(F.create_map(*pairs).alias("settings"))
    return first.select(*cols)


def write_metadata(metadata: DataFrame, path: str) -> None:
    metadata.coalesce(1).write.mode("overwrite").json(path)
