"""Writers: stage tables, reports and final destinations."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plumbline.sources.readers import resolve_source


def save_stage(
    df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None
) -> DataFrame:
    """Write a stage boundary as Parquet and return the table read back."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def save_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a report (one row per column, pair or alert) as JSON lines."""
    df.write.mode(mode).json(path)


def save(df: DataFrame, uri: str, format: str | None = None, mode: str = "overwrite", **options: str) -> None:
    """Write to a path, an object store or, with ``dbtable``, a database."""
    spec = resolve_source(uri)
    if spec.kind == "database":
        url = uri if uri.startswith("jdbc:") else "jdbc:" + uri
        df.write.mode(mode).format("jdbc").options(url=url, **options).save()
        return
    kind = format or spec.format or "parquet"
    writer = df.write.mode(mode).options(**options)
    if kind in ("csv", "tsv"):
        writer.options(header=True, sep="\t" if kind == "tsv" else ",").csv(spec.uri)
    elif kind in ("json", "jsonl"):
        writer.json(spec.uri)
    elif kind in ("parquet", "orc"):
        writer.format(kind).save(spec.uri)
    else:
        raise ValueError(f"unsupported output format {kind!r}")
