"""Container files that are split at sync markers, read and written by tasks: Avro and SequenceFile.

A file has a header with 16 random bytes, and these bytes again between its blocks of
records. A task gets a range of a file, looks for the first marker that begins in it, and
reads on up to the first marker that begins behind it; so every block is read once, however
the file is cut, and no task needs the rest of the file. Records are decoded into Arrow
batches. Folders are listed and files opened through pyarrow's file systems, on the driver
only for the listing and for the header of the first file. Files whose name starts with
``_`` or ``.`` are no data. Tasks write below a temporary folder; the driver moves what
the successful ones wrote when all are done.
"""

from __future__ import annotations

import datetime as dt
import decimal
import io
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from shuffleworks.sources.tree import store_of

SPLIT = 128 << 20  # bytes of a range
BLOCK = 1 << 16  # bytes of records between two markers
ROWS = 10_000  # of a batch
MARK = 16
EPOCH = dt.datetime(1970, 1, 1)
FIRST_DAY = dt.date(1970, 1, 1).toordinal()


def data_files(paths: list[str]) -> list[tuple[str, int]]:
    """(address, size) of the data files at or below the paths, in order."""
    from pyarrow import fs

    out = []
    for path in paths:
        store, root = store_of(path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        prefix = path[: len(path) - len(root)] if path.endswith(root) else path.split("://")[0] + "://" if "://" in path else "file://"
        hidden = lambda f: any(part[:1] in ("_", ".") for part in f.path[len(root) :].split("/") if part) and not info.is_file
        out += sorted((prefix + f.path, f.size) for f in found if f.is_file and f.size and not hidden(f))
    return out


class FileRange(InputPartition):
    def __init__(self, uri: str, start: int, end: int):
        super().__init__(uri)
        self.uri, self.start, self.end = uri, start, end


def next_mark(file, mark: bytes, start: int) -> int | None:
    """Where the first marker at or behind ``start`` begins."""
    file.seek(start)
    kept, at = b"", start
    while more := file.read(1 << 16):
        kept += more
        if (found := kept.find(mark)) >= 0:
            return at + found
        at += max(0, len(kept) - MARK + 1)
        kept = kept[-MARK + 1 :]
    return None


class RangeReader(DataSourceReader):
    def __init__(self, paths: list[str], split: int, kinds: pa.Schema, form):
        self.paths, self.split, self.kinds, self.form = paths, split, kinds, form

    def partitions(self) -> list[InputPartition]:
        return [FileRange(uri, at, min(at + self.split, size)) for uri, size in data_files(self.paths) for at in range(0, size, self.split)]

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        store, name = store_of(partition.uri)
        with io.BufferedReader(store.open_input_file(name), 1 << 20) as file:
            header = self.form.header(file)
            at = next_mark(file, header.mark, partition.start)
            if at is None or at >= partition.end:
                return
            file.seek(at + MARK)
            held = []
            for row in self.form.records(file, header, partition.end):
                held.append(row)
                if len(held) >= ROWS:
                    yield self._batch(held)
                    held = []
            if held:
                yield self._batch(held)

    def _batch(self, rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), self.kinds)], schema=self.kinds)


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class RangeWriter(DataSourceArrowWriter):
    def __init__(self, path: str, form, schema: T.StructType):
        self.path, self.form, self.schema, self.job = path.rstrip("/"), form, schema, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = store_of(self.path)
        name = f"part-{uuid.uuid4().hex}{self.form.suffix}"
        store.create_dir(f"{root}/_temporary-{self.job}", recursive=True)
        with store.open_output_stream(f"{root}/_temporary-{self.job}/{name}") as out:
            self.form.write(out, iterator, self.schema)
        return Written(name)

    def commit(self, messages: list) -> None:
        store, root = store_of(self.path)
        for message in messages:
            if message is not None:
                store.move(f"{root}/_temporary-{self.job}/{message.name}", f"{root}/{message.name}")
        self._clean(store, root)
        with store.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list) -> None:
        self._clean(*store_of(self.path))

    def _clean(self, store, root: str) -> None:
        from pyarrow import fs

        folder = f"{root}/_temporary-{self.job}"
        if store.get_file_info(folder).type != fs.FileType.NotFound:
            store.delete_dir(folder)


@dataclass
class Header:
    mark: bytes
    kind: object  # what the form needs to decode
    codec: str


# --- Avro -----------------------------------------------------------------------------------

PRIMITIVES = {"null": T.NullType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "bytes": T.BinaryType(), "string": T.StringType()}
LOGICAL = {"date": T.DateType(), "timestamp-micros": T.TimestampType(), "local-timestamp-micros": T.TimestampNTZType()}
WIDER = {frozenset(["int", "long"]): "long", frozenset(["float", "double"]): "double"}
NAMES = {v: k for k, v in PRIMITIVES.items()} | {T.ShortType(): "int", T.ByteType(): "int"}


def zigzag(n: int) -> bytes:
    n = (n << 1) ^ (n >> 63)
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def unzigzag(data: bytes, at: int) -> tuple[int, int]:
    shift = total = 0
    while True:
        b = data[at]
        at += 1
        total |= (b & 127) << shift
        if b < 128:
            return (total >> 1) ^ -(total & 1), at
        shift += 7


def _file_long(file) -> int:
    raw = b""
    while True:
        b = file.read(1)
        if not b:
            raise EOFError("a number is cut off")
        raw += b
        if b[0] < 128:
            return unzigzag(raw, 0)[0]


def from_avro(kind, named: dict | None = None) -> T.DataType:
    """The Spark type of an Avro one. Unions are of null and one type, or of two widths of a number."""
    named = {} if named is None else named
    if isinstance(kind, list):
        rest = [k for k in kind if k != "null"]
        if len(rest) == 1:
            return from_avro(rest[0], named)
        if not rest:
            return T.NullType()
        if all(isinstance(k, str) for k in rest) and frozenset(rest) in WIDER:
            return PRIMITIVES[WIDER[frozenset(rest)]]
        raise ValueError(f"no single type for the union {kind}")
    if isinstance(kind, str):
        return PRIMITIVES[kind] if kind in PRIMITIVES else from_avro(named[kind], named)
    name = kind["type"]
    if "name" in kind:
        named[kind["name"]] = kind
    if kind.get("logicalType") in LOGICAL:
        return LOGICAL[kind["logicalType"]]
    if kind.get("logicalType") == "decimal":
        return T.DecimalType(kind["precision"], kind.get("scale", 0))
    if name == "record":
        return T.StructType([T.StructField(f["name"], from_avro(f["type"], named), _nullable(f["type"])) for f in kind["fields"]])
    if name == "array":
        return T.ArrayType(from_avro(kind["items"], named), _nullable(kind["items"]))
    if name == "map":
        return T.MapType(T.StringType(), from_avro(kind["values"], named), _nullable(kind["values"]))
    return T.StringType() if name == "enum" else T.BinaryType() if name == "fixed" else from_avro(name, named)


def _nullable(kind) -> bool:
    return kind == "null" or isinstance(kind, list) and "null" in kind


def to_avro(kind: T.DataType, nullable: bool = False, path: str = "row"):
    if nullable and not isinstance(kind, T.NullType):
        return ["null", to_avro(kind, False, path)]
    for name, spark in LOGICAL.items():
        if kind == spark:
            return {"type": "int" if name == "date" else "long", "logicalType": name}
    if isinstance(kind, T.DecimalType):
        return {"type": "bytes", "logicalType": "decimal", "precision": kind.precision, "scale": kind.scale}
    if isinstance(kind, T.StructType):
        return {"type": "record", "name": path, "fields": [{"name": f.name, "type": to_avro(f.dataType, f.nullable, f"{path}_{f.name}")} for f in kind.fields]}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": to_avro(kind.elementType, kind.containsNull, f"{path}_item")}
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        return {"type": "map", "values": to_avro(kind.valueType, kind.valueContainsNull, f"{path}_value")}
    if isinstance(kind, (T.VarcharType, T.CharType)):
        return "string"
    if kind not in NAMES:
        raise ValueError(f"{kind.simpleString()} has no Avro type")
    return NAMES[kind]


Decoder = Callable[[bytes, int], tuple[object, int]]


def decoder(kind, named: dict) -> Decoder:
    """Reads one value of an Avro type: (bytes, place) -> (value, place behind it)."""
    if isinstance(kind, list):
        branches = [decoder(k, named) for k in kind]

        def union(data, at):
            n, at = unzigzag(data, at)
            return branches[n](data, at)

        return union
    if isinstance(kind, str) and kind not in PRIMITIVES:
        return lambda data, at: named[kind][1](data, at)  # a type that was named before, perhaps one we are inside of
    name = kind if isinstance(kind, str) else kind["type"]
    if isinstance(name, (dict, list)):
        return decoder(name, named)
    if name == "null":
        return lambda data, at: (None, at)
    if name == "boolean":
        return lambda data, at: (data[at] == 1, at + 1)
    if name in ("int", "long"):
        return unzigzag
    if name in ("float", "double"):
        form, size = ("<f", 4) if name == "float" else ("<d", 8)
        return lambda data, at: (struct.unpack_from(form, data, at)[0], at + size)
    if name in ("bytes", "string"):
        logical = None if isinstance(kind, str) else kind.get("logicalType")

        def sized(data, at):
            n, at = unzigzag(data, at)
            raw = data[at : at + n]
            if logical == "decimal":
                return decimal.Decimal(int.from_bytes(raw, "big", signed=True)).scaleb(-kind.get("scale", 0)), at + n
            return raw.decode("utf-8", "replace") if name == "string" else raw, at + n

        return sized
    if name == "fixed":
        own = lambda data, at: (data[at : at + kind["size"]], at + kind["size"])
    elif name == "enum":
        own = lambda data, at: (kind["symbols"][unzigzag(data, at)[0]], unzigzag(data, at)[1])
    elif name in ("array", "map"):
        item = decoder(kind["items" if name == "array" else "values"], named)
        text = decoder("string", named)

        def own(data, at):
            out = []
            while True:
                n, at = unzigzag(data, at)
                if n == 0:
                    return out, at
                if n < 0:
                    n, (_, at) = -n, unzigzag(data, at)
                for _ in range(n):
                    key = None
                    if name == "map":
                        key, at = text(data, at)
                    value, at = item(data, at)
                    out.append(value if name == "array" else (key, value))
    else:
        fields: list = []

        def own(data, at):
            out = {}
            for field, read in fields:
                out[field], at = read(data, at)
            return out, at

        named[kind["name"]] = (kind, own)
        fields += [(f["name"], decoder(f["type"], named)) for f in kind["fields"]]
        return own
    if "name" in kind:
        named[kind["name"]] = (kind, own)
    return own


def encoder(kind) -> Callable[[object], bytes]:
    """Writes one value of a type that ``to_avro`` gives."""
    if isinstance(kind, list):
        inner = encoder(kind[1])
        return lambda v: b"\x00" if v is None else b"\x02" + inner(v)
    name = kind if isinstance(kind, str) else kind["type"]
    logical = None if isinstance(kind, str) else kind.get("logicalType")
    if logical == "date":
        return lambda v: zigzag(v.toordinal() - FIRST_DAY)
    if logical in LOGICAL:
        return lambda v: zigzag(((v.astimezone(dt.timezone.utc).replace(tzinfo=None) if v.tzinfo else v) - EPOCH) // dt.timedelta(microseconds=1))
    if logical == "decimal":

        def unscaled(v):
            n = int(v.scaleb(kind["scale"]))
            raw = n.to_bytes((n.bit_length() >> 3) + 1, "big", signed=True)
            return zigzag(len(raw)) + raw

        return unscaled
    if name == "record":
        parts = [(f["name"], encoder(f["type"])) for f in kind["fields"]]
        return lambda v: b"".join(write(v[field]) for field, write in parts)
    if name == "array":
        item = encoder(kind["items"])
        return lambda v: (zigzag(len(v)) + b"".join(map(item, v)) if v else b"") + b"\x00"
    if name == "map":
        value, text = encoder(kind["values"]), encoder("string")
        return lambda v: (zigzag(len(v)) + b"".join(text(k) + value(x) for k, x in v) if v else b"") + b"\x00"
    return {
        "null": lambda v: b"",
        "boolean": lambda v: b"\x01" if v else b"\x00",
        "int": zigzag,
        "long": zigzag,
        "float": lambda v: struct.pack("<f", v),
        "double": lambda v: struct.pack("<d", v),
        "bytes": lambda v: zigzag(len(v)) + v,
        "string": lambda v: zigzag(len(raw := v.encode("utf-8", "surrogatepass"))) + raw,
    }[name]


def inflated(data: bytes, codec: str) -> bytes:
    if codec == "deflate":
        return zlib.decompress(data, -15)
    if codec in ("zstandard", "snappy"):
        if codec == "snappy":
            data = data[:-4]  # a checksum follows
            size, shift, at = 0, 0, 0
            while True:
                size |= (data[at] & 127) << shift
                shift, at = shift + 7, at + 1
                if data[at - 1] < 128:
                    break
            return pa.decompress(data, decompressed_size=size, codec="snappy", asbytes=True)
        return pa.CompressedInputStream(pa.BufferReader(data), "zstd").read()
    if codec != "null":
        raise ValueError(f"unknown Avro codec {codec!r}")
    return data


class Avro:
    suffix = ".avro"

    def __init__(self, codec: str = "deflate"):
        if codec not in ("deflate", "null"):
            raise ValueError(f"Avro files are written with codec deflate or null, not {codec!r}")
        self.codec = codec

    @staticmethod
    def header(file) -> Header:
        if file.read(4) != b"Obj\x01":
            raise ValueError("not an Avro container file")
        meta: dict[str, bytes] = {}
        while n := _file_long(file):
            if n < 0:
                n = -n
                _file_long(file)
            for _ in range(n):
                key = file.read(_file_long(file)).decode()
                meta[key] = file.read(_file_long(file))
        return Header(file.read(MARK), json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode())

    @staticmethod
    def spark_schema(header: Header) -> T.StructType:
        kind = from_avro(header.kind)
        return kind if isinstance(kind, T.StructType) else T.StructType([T.StructField("value", kind)])

    @staticmethod
    def records(file, header: Header, end: int) -> Iterator[tuple]:
        read = decoder(header.kind, {})
        whole = not (isinstance(header.kind, dict) and header.kind["type"] == "record")
        while file.peek(1):
            count, size = _file_long(file), _file_long(file)
            data, at = inflated(file.read(size), header.codec), 0
            for _ in range(count):
                value, at = read(data, at)
                yield (value,) if whole else tuple(value.values())
            place = file.tell()
            if file.read(MARK) != header.mark:
                raise ValueError("a block does not end with the file's marker")
            if place >= end:
                return

    def write(self, out, batches: Iterator[pa.RecordBatch], schema: T.StructType) -> None:
        kind, mark = to_avro(schema), uuid.uuid4().bytes
        meta = {"avro.schema": json.dumps(kind).encode(), "avro.codec": self.codec.encode()}
        named = b"".join(zigzag(len(k)) + k.encode() + zigzag(len(v)) + v for k, v in meta.items())
        out.write(b"Obj\x01" + zigzag(len(meta)) + named + b"\x00" + mark)
        record = encoder(kind)
        held, size = [], 0

        def block() -> None:
            data = b"".join(held)
            if self.codec == "deflate":
                packer = zlib.compressobj(wbits=-15)
                data = packer.compress(data) + packer.flush()
            out.write(zigzag(len(held)) + zigzag(len(data)) + data + mark)

        for batch in batches:
            for row in batch.to_pylist():
                held.append(record(row))
                size += len(held[-1])
                if size >= BLOCK:
                    block()
                    held, size = [], 0
        if held:
            block()


# --- SequenceFile ---------------------------------------------------------------------------

WRITABLE = "org.apache.hadoop.io."


def vint(data: bytes, at: int) -> tuple[int, int]:
    """Hadoop's number of variable length."""
    first = struct.unpack_from("b", data, at)[0]
    if first >= -112:
        return first, at + 1
    negative, n = first < -120, (-120 if first < -120 else -112) - first
    value = int.from_bytes(data[at + 1 : at + 1 + n], "big")
    return ~value if negative else value, at + 1 + n


def to_vint(n: int) -> bytes:
    if -112 <= n <= 127:
        return struct.pack("b", n)
    first, n = (-120, ~n) if n < 0 else (-112, n)
    raw = n.to_bytes((n.bit_length() + 7) // 8, "big")
    return struct.pack("b", first - len(raw)) + raw


def _text(data: bytes) -> str:
    n, at = vint(data, 0)
    return data[at : at + n].decode("utf-8", "replace")


#: Writable -> Spark type, how it is read, how it is written.
WRITABLES = {
    "Text": (T.StringType(), _text, lambda v: to_vint(len(raw := v.encode("utf-8", "surrogatepass"))) + raw),
    "LongWritable": (T.LongType(), lambda d: struct.unpack(">q", d)[0], lambda v: struct.pack(">q", v)),
    "IntWritable": (T.IntegerType(), lambda d: struct.unpack(">i", d)[0], lambda v: struct.pack(">i", v)),
    "DoubleWritable": (T.DoubleType(), lambda d: struct.unpack(">d", d)[0], lambda v: struct.pack(">d", v)),
    "FloatWritable": (T.FloatType(), lambda d: struct.unpack(">f", d)[0], lambda v: struct.pack(">f", v)),
    "BooleanWritable": (T.BooleanType(), lambda d: d[0] != 0, lambda v: b"\x01" if v else b"\x00"),
    "BytesWritable": (T.BinaryType(), lambda d: d[4:], lambda v: struct.pack(">i", len(v)) + v),
    "NullWritable": (T.NullType(), lambda d: None, lambda v: b""),
    "VIntWritable": (T.IntegerType(), lambda d: vint(d, 0)[0], to_vint),
    "VLongWritable": (T.LongType(), lambda d: vint(d, 0)[0], to_vint),
}


class Sequence:
    """Keys and values in turn; records may be compressed one by one (zlib), blocks of records are not read."""

    suffix = ""

    @staticmethod
    def header(file) -> Header:
        if file.read(3) != b"SEQ" or file.read(1)[0] < 6:
            raise ValueError("not a SequenceFile of version 6")

        def text() -> str:
            first = file.read(1)
            more = struct.unpack("b", first)[0]
            n = vint(first + file.read(-112 - more if more < -112 else 0), 0)[0]
            return file.read(n).decode()

        names = [text().removeprefix(WRITABLE) for _ in range(2)]
        compressed, blocks = file.read(2)
        codec = text() if compressed else ""
        for _ in range(struct.unpack(">i", file.read(4))[0]):
            text(), text()
        if blocks or codec not in ("", "org.apache.hadoop.io.compress.DefaultCodec") or any(n not in WRITABLES for n in names):
            raise NotImplementedError(f"SequenceFile of {names}, codec {codec!r}, blocks {bool(blocks)}")
        return Header(file.read(MARK), names, codec)

    @staticmethod
    def spark_schema(header: Header) -> T.StructType:
        return T.StructType([T.StructField(n, WRITABLES[k][0]) for n, k in zip(("key", "value"), header.kind)])

    @staticmethod
    def records(file, header: Header, end: int) -> Iterator[tuple]:
        key, value = (WRITABLES[k][1] for k in header.kind)
        while head := file.read(4):
            size = struct.unpack(">i", head)[0]
            if size == -1:
                place = file.tell()
                if file.read(MARK) != header.mark:
                    raise ValueError("an escape is not followed by the file's marker")
                if place >= end:
                    return
                continue
            n = struct.unpack(">i", file.read(4))[0]
            data = file.read(size)
            yield key(data[:n]), value(zlib.decompress(data[n:]) if header.codec else data[n:])

    @staticmethod
    def write(out, batches: Iterator[pa.RecordBatch], schema: T.StructType) -> None:
        kinds = {v[0]: k for k, v in reversed(WRITABLES.items())}
        names = [kinds[{T.ShortType(): T.IntegerType(), T.ByteType(): T.IntegerType()}.get(f.dataType, f.dataType)] for f in schema.fields]
        mark = uuid.uuid4().bytes
        title = lambda n: to_vint(len(WRITABLE + n)) + (WRITABLE + n).encode()
        out.write(b"SEQ\x06" + title(names[0]) + title(names[1]) + b"\x00\x00" + struct.pack(">i", 0) + mark)
        key, value = (WRITABLES[n][2] for n in names)
        since = 0
        for batch in batches:
            for k, v in zip(*[c.to_pylist() for c in batch.columns]):
                k, v = key(k), value(v)
                if since >= BLOCK:
                    out.write(struct.pack(">i", -1) + mark)
                    since = 0
                out.write(struct.pack(">ii", len(k) + len(v), len(k)) + k + v)
                since += len(k) + len(v) + 8


# --- the data source ------------------------------------------------------------------------

FORMS = {"avro": Avro, "sequence": Sequence}


class Containers(DataSource):
    """``spark.read.format("containers").option("form", "avro").option("paths", json_list).load()``"""

    @classmethod
    def name(cls) -> str:
        return "containers"

    def _paths(self) -> list[str]:
        return json.loads(self.options["paths"])

    def schema(self) -> T.StructType:
        files = data_files(self._paths())
        if not files:
            raise ValueError(f"no data files in {self._paths()}")
        store, name = store_of(files[0][0])
        with io.BufferedReader(store.open_input_file(name)) as file:
            form = FORMS[self.options["form"]]
            return form.spark_schema(form.header(file))

    def reader(self, schema: T.StructType) -> RangeReader:
        return RangeReader(self._paths(), int(self.options.get("split", SPLIT)), to_arrow_schema(schema), FORMS[self.options["form"]])

    def writer(self, schema: T.StructType, overwrite: bool) -> RangeWriter:
        form = FORMS[self.options["form"]]
        return RangeWriter(self._paths()[0], form(self.options["codec"]) if "codec" in self.options else form(), schema)


def read_containers(spark: SparkSession, form: str, paths: list[str], split: int = SPLIT) -> DataFrame:
    spark.dataSource.register(Containers)
    return spark.read.format("containers").options(form=form, paths=json.dumps(paths), split=str(split)).load()


def write_containers(df: DataFrame, form: str, path: str, mode: str = "errorifexists", **options: str) -> None:
    """Write one file per task. ``mode`` is errorifexists, append or overwrite, which first removes what is there."""
    from pyarrow import fs

    store, root = store_of(path)
    there = store.get_file_info(root).type != fs.FileType.NotFound
    if mode in ("error", "errorifexists") and there:
        raise FileExistsError(path)
    if mode == "overwrite" and there:
        store.delete_dir(root)
    store.create_dir(root, recursive=True)
    df.sparkSession.dataSource.register(Containers)
    df.write.format("containers").options(form=form, paths=json.dumps([path]), **options).mode("append").save()
