import math

import pytest
from pyspark.sql import functions as F

from lakescope.functions import paths, pii
from lakescope.functions.bloom import Bloom
from lakescope.plans.render import human_bytes


def values(spark, rows, column):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in frame.orderBy("i").select(column(F.col("x"))).collect()]


def test_table_ids(spark):
    ids = ["a.b", "a/b", "x", "a.b.c", "a/b.c", " s.t ", ".x/y"]
    got = values(spark, ids, paths.table_id_parts)
    assert [tuple(r) for r in got] == [("a", "b"), ("a", "b"), ("", "x"), ("a", "b.c"), ("a/b", "c"), ("s", "t"), (".x", "y")]
    assert [paths.parse_table_id(x) for x in ids] == [tuple(r) for r in got]
    with pytest.raises(ValueError):
        paths.parse_table_id("  ")


def test_schemes_and_resolution(spark):
    assert values(spark, ["S3://b/k", "/x", "://x", "hdfs://h/p"], paths.scheme_of) == ["s3", "", "", "hdfs"]
    assert [tuple(r) for r in values(spark, ["s3://b/k%20/y", "/a/b"], paths.split_uri)] == [("s3", "b", "/k%20/y"), ("file", "", "/a/b")]
    base = F.lit("s3://b/t/metadata/v1.metadata.json")
    assert values(spark, ["", "s3://c/x", "/abs", "snap-1.avro"], lambda x: paths.resolve(base, x)) == ["", "s3://c/x", "/abs", "s3://b/t/metadata/snap-1.avro"]
    assert values(spark, ["file:///a/b/", "/a/b", "file:/a/b", "s3://b/k//"], paths.normalized) == ["/a/b", "/a/b", "/a/b", "s3://b/k/"]
    assert values(spark, ["/m/v1.metadata.json", "/m/snap-1.avro", "/m/version-hint.text", "/m/abc-m0.avro"], paths.protected) == [True, True, True, False]


@pytest.mark.parametrize("n", [0, 1023, 1024, 1536, 1 << 20, 5 * (1 << 30) + 7, 3 << 40, 1126 * 1024 + 128 * 5])
def test_human_bytes(spark, n):
    assert spark.range(1).select(paths.human_bytes(F.lit(n).cast("long"))).first()[0] == human_bytes(n)


def test_small_texts(spark):
    day = 86_400_000
    got = spark.range(1).select(*(paths.duration_text(F.lit(x).cast("long")) for x in (0, -5, 59_999, 3_600_000, day - 1, day, 45 * day))).first()
    assert list(got) == ["0s", "0s", "0m", "1h", "23h", "1d", "45d"]
    assert values(spark, ["ns/t.x é"], paths.sanitized) == ["ns_t.x___"]
    assert values(spark, ["abcdef", "abc  def", "abc"], lambda x: paths.truncated(x, 5)) == ["abcd…", "abc…", "abc"]
    part = F.create_map(F.lit("z"), F.lit(None).cast("string"), F.lit("a"), F.lit("1"))
    assert spark.range(1).select(paths.partition_key(part), paths.partition_key(F.create_map().cast("map<string,string>"))).first()[:] == ("a=1/z=<nil>", "")


CASES = {
    "reach me at Jo.Doe+x@mail.example.org!": ["EMAIL"], "é123-45-6789": ["SSN_US"], "123-45-67890": [], "4111 1111 1111 1111": ["CREDIT_CARD"], "4111 1111 1111 1112": [],
    "call +14155552671": ["PHONE_E164"], "123 456 789": ["AU_TFN"], "2345 6789 0123": ["IN_AADHAAR"], "0000 0000 0000 0000": [], "": [],
    "aZ9_" * 6: [], "A1b2C3d4E5f6G7h8I9j0K_l-": ["API_KEY_ENTROPY"], "A1b2C3d4E5f6G7h8I9j0K_l": [], "A1b2C3d4E5f6G7h8I9j0K_l-\n": [],
}


def test_detection(spark):
    assert values(spark, list(CASES), pii.detected) == list(CASES.values())


def test_detection_gate(spark):
    mail = "a@b.org "
    assert values(spark, [mail + "x" * (4096 - len(mail)), mail + "x" * (4097 - len(mail))], pii.detected) == [["EMAIL"], []]


def test_luhn_and_entropy(spark):
    assert values(spark, ["79927398713", "79927398710", "7992-7398 713", "0000", "12a"], pii.luhn) == [True, False, True, False, False]
    assert values(spark, ["", "aaaa", "abab", "abcd"], pii.entropy) == [0.0, 0.0, 1.0, 2.0]


def test_bloom():
    b = Bloom(5000, 0.01)
    for i in range(5000):
        b.add(f"in-{i}")
    assert all(f"in-{i}" in b for i in range(5000)) and len(b) == 5000
    assert sum(f"out-{i}" in b for i in range(10_000)) <= 300
    assert b.memory_bytes * 8 >= -5000 * math.log(0.01) / math.log(2) ** 2
    for bad in ((0, 0.1), (5, 0), (5, 1)):
        with pytest.raises(ValueError):
            Bloom(*bad)
