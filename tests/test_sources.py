"""Readers and writers on local files."""

import hashlib
import json
import random

import pandas as pd
import pyarrow as pa
import pyarrow.feather as feather
import pytest

from plumbline.functions import md5
from plumbline.operators.diff import diff
from plumbline.sources import files as FI
from plumbline.sources import readers as RD
from plumbline.sources import writers as WR

SCHEMA = "id bigint, feature1 double, feature2 string, feature3 bigint, target bigint"


@pytest.mark.parametrize("uri, kind, fmt, resolved", [
    ("data/a.csv", "file", "csv", None), ("a.TSV", "file", "tsv", None), ("/x/a.parquet", "file", "parquet", None), ("a.json", "file", "json", None),
    ("a.jsonl", "file", "jsonl", None), ("a.feather", "file", "feather", None), ("a.orc", "file", "orc", None), ("a.bin", "file", None, None),
    ("s3://b/k.csv", "cloud", "csv", "s3a://b/k.csv"), ("gs://b/k.parquet", "cloud", "parquet", None), ("az://c/k.json", "cloud", "json", "abfss://c/k.json"),
    ("https://h/x", "api", None, None), ("postgresql://h/db", "database", None, None), ("mysql://h/db", "database", None, None),
    ("mongodb://h/db", "database", None, None), ("folder/.csv", "file", None, None),
])
def test_resolve(uri, kind, fmt, resolved):
    spec = RD.resolve_source(uri)
    assert (spec.kind, spec.format, spec.uri) == (kind, fmt, resolved or uri)


@pytest.mark.parametrize("kind", ["csv", "tsv", "jsonl", "parquet", "orc"])
def test_round_trips(spark, sample, tmp_path, kind):
    path = f"file://{tmp_path}/t.{kind}"
    WR.save(sample, path)
    assert diff(sample, RD.load(spark, path, schema=SCHEMA)).count() == 0
    assert RD.load(spark, path).count() == 10


def test_encoding_and_bad_format(spark, tmp_path):
    (tmp_path / "latin.csv").write_bytes("name\nJos\u00e9\n".encode("latin-1"))
    assert RD.load(spark, str(tmp_path / "latin.csv"), encoding="latin1").first()["name"] == "Jos\u00e9"
    with pytest.raises(ValueError):
        RD.load(spark, "x.csv", format="xlsx")
    with pytest.raises(ValueError):
        RD.load(spark, "https://example.com/x.json")


def test_json_document(spark, sample, tmp_path):
    rows = [r.asDict() for r in sample.collect()]
    (tmp_path / "doc.json").write_text(json.dumps(rows, indent=2))
    assert diff(sample, RD.load(spark, str(tmp_path / "doc.json"), schema=SCHEMA)).count() == 0


def test_unknown_extension(spark, sample, tmp_path):
    sample.write.parquet(str(tmp_path / "p"))
    sample.write.option("header", True).csv(str(tmp_path / "c"))
    assert diff(sample, RD.load(spark, str(tmp_path / "p"))).count() == 0
    assert RD.load(spark, str(tmp_path / "c")).count() == 10


def test_feather_folder(spark, sample, tmp_path):
    pdf = sample.toPandas()
    for i in range(3):
        part = pdf.iloc[i::3].reset_index(drop=True)
        table = pa.Table.from_pandas(part, preserve_index=False)
        if i == 1:
            table = table.set_column(2, "feature2", table["feature2"].dictionary_encode())
        feather.write_feather(table, str(tmp_path / f"{i}.feather"), compression="uncompressed")
    assert diff(sample, RD.load(spark, str(tmp_path), format="feather")).count() == 0


def test_dataframe_passes_through(spark, sample):
    assert RD.load(spark, sample) is sample


def test_jdbc_options():
    assert RD.jdbc_options("postgresql://h/db")["query"] == "SELECT * FROM data"
    assert RD.jdbc_options("jdbc:mysql://h/db", table="t") == {"url": "jdbc:mysql://h/db", "dbtable": "t"}
    got = RD.jdbc_options("jdbc:x", query="SELECT a FROM t", partition_column="a", bounds=(1, 9), partitions=3)
    assert got["dbtable"] == "(SELECT a FROM t) AS source" and got["numPartitions"] == "3" and got["upperBound"] == "9"
    with pytest.raises(ValueError):
        RD.jdbc_options("jdbc:x", query="DROP TABLE t")
    with pytest.raises(ValueError):
        RD.jdbc_options("jdbc:x", table="t", partition_column="a")


def test_payloads(spark):
    rows = [(1, '[{"a":1},{"a":2}]'), (2, '{"items":[{"a":3}]}'), (3, '{"a":4}'), (4, "nope"), (5, '{"data":5,"records":[{"a":6}]}'),
            (6, '{"results":[{"a":8}],"items":[{"a":9}]}'), (7, None), (8, "[]")]
    df = spark.createDataFrame(rows, "i int, p string")
    got = sorted((r.i, r.a) for r in RD.unpack_json_payload(df, "p", "a INT", ["i"]).collect())
    assert got == [(1, 1), (1, 2), (2, 3), (3, 4), (5, 6), (6, 8)]


def test_manifest_and_storage(spark, tmp_path):
    (tmp_path / "a.CSV").write_bytes(b"x,y\n1,2\n")
    (tmp_path / "b.bin").write_bytes(b"abc")
    rows = {r["name"]: r for r in FI.file_manifest(spark, f"{tmp_path}/*").collect()}
    assert rows["a.CSV"]["mime_type"] == "text/csv" and rows["b.bin"]["mime_type"] == "application/octet-stream"
    assert rows["b.bin"]["checksum"] == "900150983cd24fb0d6963f7d28e17f72" and rows["a.CSV"]["size_bytes"] == 8
    assert FI.storage_stats(spark, f"{tmp_path}/*").first().asDict() == {"files": 2, "total_bytes": 11}


def test_manifest_of_files_of_many_splits(spark, tmp_path, monkeypatch):
    noise = random.Random(3).randbytes(400_001)
    made = {"a b%.parquet": noise, "ends.csv": noise + b"\n", "mark.txt": b"\xef\xbb\xbf" + noise, "mark ends.txt": b"\xef\xbb\xbf" + noise + b"\n\n",
            "[x]{y}.bin": noise[::-1], "feeds.bin": b"\n" * 300_000, "crlf.csv": b"a,b\r\n" * 50_000,
            "long.bin": b"\n".join(bytes(90_000 + i) for i in range(4)), "small.bin": b"abc"}
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    monkeypatch.setattr(FI, "WHOLE", 100_000, raising=False)
    # no file may be one cell, no task may read more than a split
    conf = {"spark.sql.sources.binaryFile.maxLength": "100000", "spark.sql.files.maxPartitionBytes": "65536"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        got = FI.file_manifest(spark, [f"{tmp_path}/*", f"{tmp_path}/feeds.bin"]).collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert {r["name"] for r in got} == set(made)
    for r in got:
        assert (r["size_bytes"], r["checksum"]) == (len(made[r["name"]]), hashlib.md5(made[r["name"]]).hexdigest())


def test_manifest_of_packed_files(spark, tmp_path, monkeypatch):
    noise = random.Random(4).randbytes(200_000)
    (tmp_path / "no gzip.gz").write_bytes(noise)
    (tmp_path / "a.bin").write_bytes(noise)
    monkeypatch.setattr(FI, "WHOLE", 100_000, raising=False)
    got = {r["name"]: r["checksum"] for r in FI.file_manifest(spark, f"{tmp_path}/*").collect()}
    assert got == dict.fromkeys(["no gzip.gz", "a.bin"], hashlib.md5(noise).hexdigest())


def test_md5_goes_on(monkeypatch):
    for fast in (True, False):
        if not fast:
            monkeypatch.setattr(md5, "_fast", lambda: None)
        for n in (0, 1, 55, 56, 63, 64, 65, 119, 120, 128, 1000):
            data = random.Random(n).randbytes(n)
            state = md5.START
            for at in range(0, n, 37):
                state = md5.update(state, data[at:at + 37])
            assert md5.hexdigest(state) == hashlib.md5(data).hexdigest()


def test_stage_partitions(spark, sample, tmp_path):
    back = WR.save_stage(sample, str(tmp_path / "s"), partition_by=["feature2"])
    assert diff(sample, back.select(sample.columns)).count() == 0
    assert {p.name for p in (tmp_path / "s").glob("feature2=*")} == {"feature2=a", "feature2=b", "feature2=c"}


def test_stream_reader(spark, tmp_path):
    pd.DataFrame({"a": [1, 2]}).to_csv(tmp_path / "x.csv", index=False)
    stream = RD.load_stream(spark, str(tmp_path), "a int", "csv")
    query = stream.writeStream.format("memory").queryName("stream_reader").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("stream_reader").count() == 2
