"""Avro and SequenceFile containers: round trips, ranges of any size, Hadoop's own reader and writer."""

import datetime as dt
import decimal
import io
import json
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.errors import PySparkException

from shuffleworks.sources import containers as co
from shuffleworks.sources import formats

SCHEMA = "i int, l bigint, s string, b binary, d double, f float, t boolean, day date, at timestamp_ntz, m decimal(20,3), a array<int>, r struct<x:string,y:array<struct<z:bigint>>>, o map<string,double>"
ROWS = [
    (1, -(1 << 63), "é\n", b"\x00\xff", 0.5, -1.5, True, dt.date(1969, 12, 31), dt.datetime(1969, 12, 31, 23, 59, 59, 999999), decimal.Decimal("-12345.678"), [1, None], ("x", [(1,), None]), {"k": 1.0, "": None}),
    (-(1 << 31), (1 << 63) - 1, "", b"", float("inf"), 0.0, False, dt.date(9999, 12, 31), dt.datetime(2024, 2, 29), decimal.Decimal("0.000"), [], (None, []), {}),
    (None,) * 13,
]


def test_avro_keeps_types_and_nulls(spark, tmp_path):
    df = spark.createDataFrame(ROWS * 50, SCHEMA)
    for codec in ("deflate", "null"):
        path = str(tmp_path / codec)
        formats.write_avro(df, path, codec=codec)
        back = formats.read_avro(spark, path)
        assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in df.schema]
        assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))


@pytest.mark.parametrize("form", ["avro", "sequence"])
@pytest.mark.parametrize("split", [17, 1000, 65_536, 100_003, 1 << 30])
def test_ranges_of_any_size_read_each_record_once(spark, tmp_path, form, split):
    df = spark.range(0, 30_000, 1, 2).selectExpr("id as key", "concat('row ', id) as value")
    path = str(tmp_path / "c")
    formats.write_output(df, form, path, **({"codec": "null"} if form == "avro" else {}))
    if split < 1000:  # some ranges only, or there would be a task for each few bytes
        reader = co.RangeReader([path], split, None, co.FORMS[form])
        parts = reader.partitions()
        assert sum(p.end - p.start for p in parts) == sum(size for _, size in co.data_files([path]))
        return
    read = formats.read_avro(spark, path, split) if form == "avro" else formats.read_sequence(spark, path, "key bigint, value string", split)
    assert read.selectExpr("count(*)", "count(distinct key)", "sum(key)", "count_if(value = concat('row ', key))").first() == (30_000, 30_000, 449_985_000, 30_000)
    assert split > 1 << 20 or read.rdd.getNumPartitions() > 2


def test_hadoop_reads_and_writes_the_same_sequence_files(spark, tmp_path):
    rows = [(f"k{i}", i * 7 - 50) for i in range(5000)]
    df = spark.createDataFrame(rows, "key string, value bigint")
    formats.write_sequence(df, str(tmp_path / "ours"))
    assert sorted(spark.sparkContext.sequenceFile(str(tmp_path / "ours")).collect()) == sorted(rows)
    spark.sparkContext.parallelize(rows, 3).saveAsSequenceFile(str(tmp_path / "theirs"))
    back = formats.read_sequence(spark, str(tmp_path / "theirs"), "key string, value bigint", split=4096)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    spark.sparkContext.parallelize([(1.5, True), (2.5, False)]).saveAsSequenceFile(str(tmp_path / "packed"), "org.apache.hadoop.io.compress.DefaultCodec")
    back = formats.read_sequence(spark, str(tmp_path / "packed"), "key double, value boolean")
    assert sorted(map(tuple, back.collect())) == [(1.5, True), (2.5, False)]


def container(kind, blocks, codec="null", mark=b"0123456789abcdef"):
    text = json.dumps(kind).encode()
    meta = b"".join(co.zigzag(len(x)) + x for x in (b"avro.schema", text, b"avro.codec", codec.encode()))
    out = b"Obj\x01" + co.zigzag(2) + meta + b"\x00" + mark
    for count, data in blocks:
        data = zlib.compress(data)[2:-4] if codec == "deflate" else data
        out += co.zigzag(count) + co.zigzag(len(data)) + data + mark
    return out


def test_bytes_as_the_format_says(spark, tmp_path):
    kind = {
        "type": "record", "name": "Node", "fields": [
            {"name": "e", "type": {"type": "enum", "name": "E", "symbols": ["A", "B"]}},
            {"name": "f", "type": {"type": "fixed", "name": "F", "size": 2}},
            {"name": "u", "type": ["int", "null", "long"]},
            {"name": "again", "type": ["null", "E"]},
            {"name": "list", "type": {"type": "array", "items": "long"}},
        ],
    }
    # -2 items in 3 bytes, then 1 item; and a record with nothing in it
    one = b"\x02" + b"xy" + b"\x00\x7f" + b"\x02\x00" + b"\x03\x06" + b"\x01\x80\x02" + b"\x02\x04" + b"\x00"
    two = b"\x00" + b"zz" + b"\x02" + b"\x00" + b"\x00"
    for name, data in {"plain": container(kind, [(2, one + two), (0, b"")]), "small": container(kind, [(1, one), (1, two)], "deflate")}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.avro").write_bytes(data)
        (tmp_path / name / "_hidden").write_bytes(b"no data")
        rows = formats.read_avro(spark, str(tmp_path / name)).collect()
        assert sorted(map(tuple, rows)) == [("A", b"zz", None, None, []), ("B", b"xy", -64, "A", [-1, 128, 2])]


def test_missing_broken_and_empty(spark, tmp_path):
    with pytest.raises(PySparkException):
        formats.read_avro(spark, str(tmp_path / "nowhere"))
    (tmp_path / "bad.avro").write_bytes(b"something else")
    with pytest.raises(PySparkException, match="not an Avro"):
        formats.read_avro(spark, str(tmp_path / "bad.avro"))
    formats.write_avro(spark.range(0).selectExpr("id", "cast(id as string) as s"), str(tmp_path / "none"))
    with pytest.raises(FileExistsError):
        formats.write_avro(spark.range(1), str(tmp_path / "none"))
    formats.write_avro(spark.range(3), str(tmp_path / "none"), mode="overwrite")
    formats.write_avro(spark.range(3), str(tmp_path / "none"), mode="append")
    assert formats.read_avro(spark, str(tmp_path / "none")).count() == 6
    assert not [f for f in (tmp_path / "none").iterdir() if f.name.startswith("_temporary")]


@given(st.integers(-(1 << 63), (1 << 63) - 1))
def test_numbers(n):
    assert co.unzigzag(co.zigzag(n), 0) == (n, len(co.zigzag(n)))
    assert co.vint(co.to_vint(n), 0) == (n, len(co.to_vint(n)))
    assert co._file_long(io.BytesIO(co.zigzag(n))) == n
