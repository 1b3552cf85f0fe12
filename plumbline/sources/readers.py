"""Readers: one ``load`` for files and object stores, JDBC, streams and API payload columns."""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from plumbline.functions.rules import sql_is_select_only

# Format by extension, and the source kind by URI scheme.
FORMATS = {
    ".csv": "csv",
    ".tsv": "tsv",
    ".parquet": "parquet",
    ".json": "json",
    ".jsonl": "jsonl",
    ".feather": "feather",
    ".arrow": "feather",
    ".orc": "orc",
}
KINDS = {
    "s3": "cloud",
    "s3a": "cloud",
    "gs": "cloud",
    "az": "cloud",
    "abfss": "cloud",
    "http": "api",
    "https": "api",
    "postgresql": "database",
    "mysql": "database",
    "mongodb": "database",
    "jdbc": "database",
}
CONNECTORS = {"s3": "s3a", "az": "abfss"}
JVM_CHARSETS = {"iso8859-1": "iso-8859-1", "ascii": "us-ascii"}
PAYLOAD_KEYS = ["data", "results", "items", "records"]
DEFAULT_TABLE = "data"


@dataclass(frozen=True)
class SourceSpec:
    uri: str
    kind: str
    format: str | None


def resolve_source(uri: str) -> SourceSpec:
    """Kind and format of a source from its address alone."""
    scheme, separator, rest = uri.partition("://")
    scheme = scheme.split(":")[0].lower() if separator else ""
    if separator and scheme in CONNECTORS:
        uri = f"{CONNECTORS[scheme]}://{rest}"
    name = uri.rstrip("/").rsplit("/", 1)[-1]
    dot = name.rfind(".")
    extension = name[dot:].lower() if dot > 0 else ""
    return SourceSpec(uri, KINDS.get(scheme, "file"), FORMATS.get(extension))


def _sniff(spark: SparkSession, uri: str) -> str:
    """Parquet if the first file starts with its magic bytes, else CSV."""
    first = spark.read.format("binaryFile").load(uri).select(F.substring("content", 1, 4).alias("head")).first()
    if first is None:
        raise ValueError(f"no files at {uri}")
    return "parquet" if bytes(first["head"]) == b"PAR1" else "csv"


def _json_lines(spark: SparkSession, uri: str) -> bool:
    """Whether the first line with text is a whole JSON object, as Spark writes it, and not part of one document a file."""
    first = spark.read.text(uri).filter(F.trim("value") != "").first()
    try:
        return first is not None and isinstance(json.loads(first["value"]), dict)
    except ValueError:
        return False


def charset(encoding: str) -> str:
    """An encoding name as Spark spells it (``latin1`` is ``iso-8859-1``)."""
    name = codecs.lookup(encoding).name
    return JVM_CHARSETS.get(name, name)


def load(
    spark: SparkSession, source: str | DataFrame, format: str | None = None,
    schema: T.StructType | str | None = None, encoding: str = "utf-8", **options: str,
) -> DataFrame:
    """A table from a path, an object store or a DataFrame passed through."""
    if isinstance(source, DataFrame):
        return source
    spec = resolve_source(source)
    if spec.kind == "database":
        return load_jdbc(spark, source, **options)
    if spec.kind == "api":
        raise ValueError("fetch the payload first, then use unpack_json_payload on its column")
    kind = format or spec.format or _sniff(spark, spec.uri)
    if kind == "feather":
        return _load_feather(spark, spec.uri)
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    if kind in ("csv", "tsv"):
        reader = reader.options(header=True, encoding=charset(encoding), sep="\t" if kind == "tsv" else ",")
        if schema is None:
            reader = reader.option("inferSchema", True)
        return reader.csv(spec.uri)
    if kind == "json":
        return reader.option("multiLine", not _json_lines(spark, spec.uri)).json(spec.uri)
    if kind == "jsonl":
        return reader.json(spec.uri)
    if kind in ("parquet", "orc"):
        return reader.format(kind).load(spec.uri)
    raise ValueError(f"unsupported format {kind!r}")


def _load_feather(spark: SparkSession, uri: str) -> DataFrame:
    """Arrow IPC files, one task per group of files; record batches stream through."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{feather,arrow}").load(uri).select("content")

    def read_schema(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                found = pa.ipc.open_file(pa.BufferReader(content.as_py())).schema
                yield pa.RecordBatch.from_pydict({"schema": [found.serialize().to_pybytes()]})

    first = files.limit(1).mapInArrow(read_schema, "schema binary").first()
    if first is None:
        raise ValueError(f"no feather files at {uri}")
    arrow = pa.ipc.read_schema(pa.py_buffer(bytes(first["schema"])))
    plain = pa.schema([pa.field(f.name, _plain(f.type), f.nullable) for f in arrow])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                reader = pa.ipc.open_file(pa.BufferReader(content.as_py()))
                for i in range(reader.num_record_batches):
                    table = pa.Table.from_batches([reader.get_batch(i)]).cast(plain)
                    yield from table.to_batches()

    return files.mapInArrow(read, from_arrow_schema(plain))


def _plain(kind: pa.DataType) -> pa.DataType:
    if pa.types.is_dictionary(kind):
        return _plain(kind.value_type)
    if pa.types.is_large_string(kind) or pa.types.is_string_view(kind):
        return pa.string()
    if pa.types.is_timestamp(kind):
        return pa.timestamp("us", kind.tz)
    return kind


def jdbc_options(
    url: str, query: str | None = None, table: str | None = None, limit: int | None = None,
    partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8,
) -> dict[str, str]:
    """Reader options for a query (checked to be a plain SELECT) or a table."""
    if not url.startswith("jdbc:"):
        url = "jdbc:" + url
    if query is None and table is None:
        query = f"SELECT * FROM {DEFAULT_TABLE}" + (f" LIMIT {limit}" if limit else "")
    if query is not None and not sql_is_select_only(query):
        raise ValueError("only plain SELECT queries are allowed")
    options = {"url": url}
    if partition_column is None:
        options["query" if query is not None else "dbtable"] = query if query is not None else table
        return options
    if bounds is None:
        raise ValueError("a partition column needs bounds")
    return options | {
        "dbtable": f"({query}) AS source" if query is not None else table,
        "partitionColumn": partition_column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]),
        "numPartitions": str(partitions),
    }


def load_jdbc(spark: SparkSession, url: str, **options) -> DataFrame:
    """A database table or query, read in parallel when a partition column is named."""
    return spark.read.format("jdbc").options(**jdbc_options(url, **options)).load()


def load_stream(
    spark: SparkSession, uri: str, schema: T.StructType | str, format: str | None = None, **options: str
) -> DataFrame:
    """New files at ``uri`` as a stream; the schema must be given."""
    spec = resolve_source(uri)
    kind = format or spec.format or "parquet"
    reader = spark.readStream.schema(schema).options(**options)
    if kind in ("csv", "tsv"):
        reader = reader.options(header=True, sep="\t" if kind == "tsv" else ",")
        kind = "csv"
    return reader.format("json" if kind == "jsonl" else kind).load(spec.uri)


def unpack_json_payload(df: DataFrame, col: str | Column, element_schema: str, keep: list[str] | None = None) -> DataFrame:
    """Rows held in API payloads: a list, the first list under a known key, or the object itself.

    Text that is no JSON gives no row.
    """
    payload = F.col(col) if isinstance(col, str) else col
    rows = f"array<struct<{element_schema}>>"
    kinds = F.json_array_length(payload)

    def under(key: str) -> Column:
        held = F.get_json_object(payload, f"$.{key}")
        return F.when(F.trim(held).startswith("["), F.from_json(held, rows))

    single = F.when(F.json_object_keys(payload).isNotNull(), F.array(F.from_json(payload, f"struct<{element_schema}>")))
    found = F.coalesce(
        F.when(F.trim(payload).startswith("[") & kinds.isNotNull(), F.from_json(payload, rows)),
        *[under(k) for k in PAYLOAD_KEYS], single,
    )
    return df.select(*(keep or []), F.inline(found))
