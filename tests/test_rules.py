"""Row rules on good and bad inputs."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import rules as V
from plumbline.functions import text as TX


def verdicts(spark, rule, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.ok for r in df.select("i", rule(F.col("v")).alias("ok")).orderBy("i").collect()]


def test_paths(spark):
    values = ["data/input.csv", "../../../etc/passwd", "..\\..\\Windows\\System32", "/etc/passwd", "/proc/self/environ",
              "/home/user/data.csv", "c:\\windows\\x", "\\\\server\\share", "a" * 4097]
    assert verdicts(spark, V.path_ok, values) == [True] + [False] * 8
    assert verdicts(spark, lambda c: V.path_ok(c, allow_absolute=True), ["/home/user/data.csv"]) == [True]
    inside = lambda c: V.path_ok(c, "/srv/in", allow_absolute=True)
    assert verdicts(spark, inside, ["/srv/in/a.csv", "/srv/in", "/srv/inner/a.csv", "/tmp/a.csv", "x/..", "a.csv"]) == [
        True, True, False, False, False, True]


def test_extensions_and_types(spark):
    assert verdicts(spark, V.extension_ok, ["data.csv", "x/data.PARQUET", "script.exe", ".csv", "a.b/c", "noext"]) == [
        True, True, False, False, False, False]
    assert verdicts(spark, lambda c: V.extension_ok(c, [".pdf"]), ["doc.pdf"]) == [True]
    assert verdicts(spark, V.content_type_ok, ["text/csv", "application/json", "text/csv; charset=utf-8", "text/html"]) == [
        True, True, True, False]


def test_urls(spark):
    good = ["https://example.com/data.csv", "s3://bucket/key/data.parquet", "gs://bucket/data.csv", "file:///tmp/x"]
    bad = ["ftp://example.com/data.csv", "example.com/data.csv", "http://localhost:8000/d", "http://127.0.0.1:8000/d",
           "http://[::1]/x", "http://10.1.2.3/", "http://172.31.0.1", "http://169.254.1.1/", "http:///x", "http://u:p@192.168.0.9:1/"]
    assert verdicts(spark, V.url_ok, good + bad) == [True] * len(good) + [False] * len(bad)
    local = lambda c: V.url_ok(c, allow_localhost=True)
    assert verdicts(spark, local, ["http://localhost:8000/data.csv"]) == [True]
    assert verdicts(spark, V.url_ok, ["http://172.32.0.1/", "http://11.0.0.1/"]) == [True, True]


@pytest.mark.parametrize("query, ok", [
    ("SELECT * FROM users WHERE id = 1", True), ("  select 1", True), ("DROP TABLE users", False), ("DELETE FROM users", False),
    ("INSERT INTO users VALUES (1)", False), ("UPDATE users SET a = 1", False), ("SELECT * FROM users -- x", False), ("SHOW TABLES", False),
])
def test_select_only(spark, query, ok):
    assert verdicts(spark, V.select_only, [query]) == [ok]
    assert V.sql_is_select_only(query) is ok


def test_ids_and_names(spark):
    assert verdicts(spark, V.uuid_ok, ["550e8400-e29b-41d4-a716-446655440000", "550E8400-E29B-41D4-A716-446655440000", "not-a-uuid", ""]) == [
        True, True, False, False]
    assert verdicts(spark, V.name_ok, ["DataLoader", "Data_Loader", "123Agent", "Agent-Name", "A" * 101]) == [
        True, True, False, False, False]


def test_quarantine_splits_every_row(spark):
    df = spark.createDataFrame([("a.csv", 1), ("a.exe", 1), (None, 1), ("b.csv", 2 * V.MAX_FILE_BYTES)], "path string, size bigint")
    good, bad = V.validate_rows(df, V.file_rules(F.col("path"), F.col("size")))
    assert good.count() == 1 and good.columns == df.columns
    failed = {r.path: r.failed_rules for r in bad.collect()}
    assert failed == {"a.exe": ["extension"], None: ["path", "extension"], "b.csv": ["size"]}


def test_json_and_text(spark):
    df = spark.createDataFrame([('x {"a": 1} y',), ('```json\n{"a": 2}\n```',), ("none",), ("{bad}",), ('{"a": {"b": 1}} {',)], "t string")
    got = df.select(TX.extract_json(F.col("t"), "a INT", F.struct(F.lit(-1).alias("a")))["a"].alias("a"))
    assert [r.a for r in got.collect()][:4] == [1, 2, -1, -1]
    pair = spark.createDataFrame([("one two three four", "one two add an Example"), ("", "x")], "a string, b string")
    assert [r.g for r in pair.select(TX.text_change(F.col("a"), F.col("b")).alias("g")).collect()] == [0.15, 0.1]
    words = spark.createDataFrame([("a\u00a0b\u2003c\x1cd e",)], "t string")
    assert sorted(words.select(TX.tokens(F.col("t")).alias("w")).first().w) == ["a", "b", "c", "d", "e"]
