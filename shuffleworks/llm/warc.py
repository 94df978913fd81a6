"""WARC archives: a Spark writer and a Python data source that reads them back.

Writing: every page is one record. Of pages with equal payloads of ``REVISIT``
bytes or more the one with the largest page_id is written as response, the others
as revisit records that refer to it and carry no payload. A record ends with the
two line ends that Spark's text writer puts after each row, so the archives are
written by Spark's own committer, to any store that Spark writes.

Reading: a partition is a file, since records can only be told apart from the
start of a file. Predicates on ``record_type``, ``page_id``, ``target_uri``,
``refers_to`` and ``payload_digest`` are pushed down. A record's headers are parsed
first; the block of a record that no predicate wants is skipped, neither split nor
decoded, and so are all payloads if the option ``payload`` is ``false``.

Null html counts as empty. Pages that repeat the largest page_id of their payload
are all responses; null page_ids are smaller than all others, and refer to nothing
if the group has no other. Control characters of an URL are left out of the
header. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull

from shuffleworks.llm.common import cut
from shuffleworks.session import scratch_path

REVISIT = 1000  # bytes from which equal payloads are stored once
END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"
DATE = "1970-01-01T00:00:00Z"
BATCH = 8 << 20  # bytes of payload that the reader gathers before it hands on a batch
SCHEMA = "page_id long, record_type string, target_uri string, refers_to long, payload_digest string, payload_bytes long, payload binary"
PUSHED = {"record_type", "page_id", "target_uri", "refers_to", "payload_digest"}


def mark_revisits(pages: DataFrame, least: int = REVISIT) -> DataFrame:
    """page_id, url, html, n_bytes, digest, response_id: the page that has the payload, null for the page itself."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        html.alias("html"),
        F.octet_length(html).cast("long").alias("n_bytes"),
        F.sha2(html, 256).alias("same"),
    )
    groups = rows.where(F.col("n_bytes") >= least).groupBy("same").agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n"))
    groups = cut(groups.where("n > 1 and response_id is not null").drop("n"), "payloads")
    joined = rows.join(groups, "same", "left")
    own = F.when(F.col("page_id").eqNullSafe(F.col("response_id")), F.lit(None)).otherwise(F.col("response_id"))
    return joined.select("page_id", "url", "html", "n_bytes", F.sha1("html").alias("digest"), own.alias("response_id"))


def write_warc(pages: DataFrame, path: str, least: int = REVISIT, compression: str = "gzip") -> None:
    """Archives of all pages below ``path``."""
    rows = mark_revisits(pages, least)
    revisit = F.col("response_id").isNotNull()
    number = F.col("n_bytes").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), number, F.lit(END + END))
    length = F.octet_length("http") + F.when(revisit, 0).otherwise(F.col("n_bytes"))
    refers = F.concat(F.lit(f"WARC-Refers-To: <{URN}"), F.col("response_id").cast("string"), F.lit(f">{END}WARC-Profile: {PROFILE}{END}"))
    record = F.concat(
        F.lit("WARC/1.1" + END + "WARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{END}WARC-Record-ID: <{URN}"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(f">{END}WARC-Date: {DATE}{END}WARC-Target-URI: "),
        F.regexp_replace("url", r"[\x00-\x1F\x7F]", ""),
        F.lit(f"{END}WARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.lit(END),
        F.when(revisit, refers).otherwise(""),
        F.lit(f"Content-Type: application/http;msgtype=response{END}Content-Length: "),
        length.cast("string"),
        F.lit(END + END),
        F.col("http"),
        F.when(revisit, "").otherwise(F.col("html")),
    )
    rows.withColumn("http", http).select(record.alias("value")).write.option("compression", compression).text(path, lineSep=END + END)


class WarcFile(InputPartition):
    def __init__(self, uri: str):
        super().__init__(uri)
        self.uri = uri


def _headers(stream) -> dict[str, str] | None:
    """The header lines up to the empty one, names in lower case; None at the end of the file."""
    first = stream.readline()
    if not first:
        return None
    out = {"": first.decode("utf-8", "replace").strip()}
    while line := stream.readline().rstrip(b"\r\n"):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _skip(stream, n: int) -> None:
    while n > 0:
        got = len(stream.read(min(n, 1 << 20)))
        if not got:
            raise EOFError("a record is cut off")
        n -= got


def _page(urn: str | None) -> int | None:
    digits = (urn or "").strip("<>").removeprefix(URN)
    return int(digits) if digits else None


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.wanted = path, payload, []

    def pushFilters(self, filters):  # noqa: N802
        """Take equality and membership on header columns; Spark applies the rest."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in PUSHED and isinstance(f, EqualTo):
                self.wanted.append((name, frozenset([f.value])))
            elif name in PUSHED and isinstance(f, In):
                self.wanted.append((name, frozenset(f.value)))
            elif name in PUSHED and isinstance(f, IsNotNull):
                self.wanted.append((name, None))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else "file://"
        prefix = self.path[: len(self.path) - len(root)] if self.path.endswith(root) else scheme
        names = sorted(f.path for f in found if f.is_file and not f.base_name.startswith(("_", ".")) and f.size)
        return [WarcFile(prefix + n) for n in names]

    def _keeps(self, row: dict) -> bool:
        return all(row[name] is not None and (values is None or row[name] in values) for name, values in self.wanted)

    def read(self, partition: WarcFile) -> Iterator[pa.RecordBatch]:
        import io

        from pyarrow import fs

        kinds = pa.schema(
            [("page_id", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.int64())]
            + [("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]
        )
        store, name = fs.FileSystem.from_uri(partition.uri)
        rows: list[dict] = []
        size = 0
        with io.BufferedReader(store.open_input_stream(name), 1 << 20) as stream:
            while (head := _headers(stream)) is not None:
                if not head[""].startswith("WARC/"):
                    raise ValueError(f"{partition.uri}: not a WARC record: {head['']!r}")
                length = int(head["content-length"])
                row = {
                    "page_id": _page(head.get("warc-record-id")),
                    "record_type": head.get("warc-type"),
                    "target_uri": head.get("warc-target-uri"),
                    "refers_to": _page(head.get("warc-refers-to")),
                    "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:"),
                }
                if not self._keeps(row):
                    _skip(stream, length + 4)
                    continue
                before = 0
                sizes = {}
                while line := stream.readline():
                    before += len(line)
                    if line == b"\r\n":
                        break
                    key, _, value = line.partition(b":")
                    sizes[key.lower()] = value.strip()
                row["payload_bytes"] = int(sizes.get(b"content-length", length - before))
                if self.payload:
                    row["payload"] = stream.read(length - before)
                    size += length
                else:
                    row["payload"] = None
                    _skip(stream, length - before)
                _skip(stream, 4)
                rows.append(row)
                if size >= BATCH or len(rows) >= 10_000:
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)


class WarcSource(DataSource):
    """``spark.read.format("warc").option("payload", "false").load(path)``"""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records below ``path``."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def round_trip(spark: SparkSession, pages: DataFrame, path: str | None = None, least: int = REVISIT) -> DataFrame:
    """Write all pages as archives, read them back: one row per page, digests taken of the payloads that were read."""
    path = path or scratch_path(spark, "warc")
    write_warc(pages, path, least)
    records = read_warc(spark, path)
    stored = F.col("record_type") == "response"
    return records.select(
        "page_id",
        F.when(stored, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(stored, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
