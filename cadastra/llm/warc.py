"""WARC archives of pages: a deterministic sharded writer, and a reader that checks what it reads.

A page becomes one record, compressed on its own, so any record can be read from its offset. Of
pages with equal payloads of at least `least` bytes the one with the smallest page_id (null last,
then by url) is a response; the others are revisits without payload that refer to it. Smaller
payloads are all responses. Headers, record ids and digests are made anew from the rows.

How it is written:
1. Rows are counted by the SHA-256 of their payload, summed in the tasks first.
2. A shard is a range of digests; their number follows the payloads' bytes. Digests are spread
   evenly, so ranges of equal width are equal shards, whatever the order or partitions of the
   input. A digest with more than its share of rows is cut further by a hash of the page; its
   first page is known from the counts, so the others travel without their payloads. There are
   less than HOT such digests for each partition, a proven bound for their broadcast.
3. Each shard is sorted by digest, page_id and url and written by one task, which begins a new
   file when the last has `file_bytes` of compressed records. Equal rows give equal files.
4. Files are written under temporary names. When all tasks are done, the driver gives the files
   their names and then a manifest (names, records, bytes, SHA-256) its own. Readers see what the
   manifest names, so a broken job shows nothing, and what failed attempts leave is never read.

Edge cases: a null html is an empty payload; a null page_id or url has no header and reads back as
null; urls are percent-encoded where headers can't hold them; repeated rows are records of their
own with ids of their own; an empty table gives a manifest without files. Only page_id, url and
html are read. Rows equal in page_id, url and html meet in one task.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from cadastra.llm.tables import parallelism, shared_dir, written

#: Bytes of payload in a shard, digests that may be cut for each partition, rows of a digest that never are.
SHARD, HOT, FEW = 128 << 20, 8, 64
#: Bytes of compressed records after which a file ends, bytes from which equal payloads are revisited, and the records' date.
FILE, LEAST, DATE = 1 << 30, 100, "2024-01-01T00:00:00Z"
MANIFEST = "manifest.json"
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return fs.FileSystem.from_uri(path)


def put(files: fs.FileSystem, path: str, data: bytes) -> None:
    """A small file, complete under its name or not there."""
    own = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(own) as out:
        out.write(data)
    files.move(own, path)


def record_id(*parts) -> str:
    h = hashlib.sha256("\x1f".join("\x00" if p is None else str(p) for p in parts).encode()).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=h[:16], version=5)}>"


def record(kind: str, own: str, date: str, block: bytes, content: str, **more: str | None) -> bytes:
    """A compressed record; more: headers by their names, with _ for -."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", f"WARC-Date: {date}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in more.items() if v is not None]
    lines += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Type: {content}", f"Content-Length: {len(block)}"]
    return zlib.compress("\r\n".join(lines).encode() + END + block + END, 6, wbits=31)


def header(x: str | None, safe: str = "") -> str | None:
    """A text as a header can hold it; safe: characters that stay."""
    return None if x is None else quote(x, safe=safe)


#: What stays in urls, which may be percent-encoded already.
URL = "!#$%&'()*+,-./:;=?@[]_~"


def page(row: dict, first: dict | None, occurrence: int, date: str) -> tuple[str, bytes]:
    """The id and record of a page; first: the page it revisits."""
    own = record_id(row["digest"], row["page"], row["url"], occurrence)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['bytes']}".encode() + END
    more = {"WARC_Target_URI": header(row["url"], URL), "WARC_Payload_Digest": f"sha256:{row['digest']}", "Page_Id": header(row["page"])}
    if first is None:
        return own, record("response", own, date, http + row["payload"], "application/http; msgtype=response", **more)
    more |= {"WARC_Profile": PROFILE, "WARC_Refers_To": first["id"], "WARC_Refers_To_Target_URI": header(first["url"], URL), "WARC_Refers_To_Date": date, "Refers_To_Page_Id": header(first["page"])}
    return own, record("revisit", own, date, http, "application/http; msgtype=response", **more)


@dataclass
class Written(WriterCommitMessage):
    files: list[dict] = field(default_factory=list)


class Shards:
    """The files of one task, under temporary names."""

    def __init__(self, path: str, job: str, file_bytes: int, date: str):
        self.files, self.at = place(path)
        self.folder, self.most, self.date = f"{self.at}/_temporary/{job}/{uuid.uuid4().hex}", file_bytes, date
        self.files.create_dir(self.folder, recursive=True)
        self.done: list[dict] = []
        self.out = self.shard = None

    def add(self, shard: str, member: bytes) -> None:
        if self.out is None or shard != self.shard or self.now["bytes"] >= self.most:
            roll = self.now["roll"] + 1 if self.out is not None and shard == self.shard else 0
            self.close()
            self.shard = shard
            self.now = {"name": f"pages-{shard}-{roll:05d}.warc.gz", "roll": roll, "records": 0, "bytes": 0}
            self.sha = hashlib.sha256()
            self.out = self.files.open_output_stream(f"{self.folder}/{self.now['name']}", compression=None)
            info = record("warcinfo", record_id("warcinfo", self.now["name"]), self.date, b"format: WARC File Format 1.1\r\n", "application/warc-fields", WARC_Filename=self.now["name"])
            self.write(info)
        self.write(member)
        self.now["records"] += 1

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.now["bytes"] += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            name = self.now["name"]
            self.done.append({"name": name, "from": f"{self.folder}/{name}", "records": self.now["records"], "bytes": self.now["bytes"], "sha256": self.sha.hexdigest()})
            self.out = None


class Writer(DataSourceArrowWriter):
    """Rows (shard, digest, page, url, bytes, payload, whether equal payloads are revisited, first page of a cut digest) in the order of their records."""

    def __init__(self, options: dict):
        self.path, self.job = options["path"], uuid.uuid4().hex
        self.file_bytes, self.date = int(options["file_bytes"]), options["date"]

    def write(self, iterator) -> Written:
        shards = Shards(self.path, self.job, self.file_bytes, self.date)
        first = last = None
        occurrence = 0
        for b in iterator:
            for row in b.to_pylist():
                key = (row["digest"], row["page"], row["url"])
                occurrence = occurrence + 1 if key == last else 0
                if row["cut"]:
                    first = {"digest": row["digest"], "page": row["first_page"], "url": row["first_url"], "id": record_id(row["digest"], row["first_page"], row["first_url"], 0)}
                    leads = occurrence == 0 and key[1:] == (row["first_page"], row["first_url"])
                else:
                    leads = first is None or first["digest"] != row["digest"]
                own, member = page(row, first if row["revisits"] and not leads else None, occurrence, self.date)
                if leads:
                    first = {"digest": row["digest"], "page": row["page"], "url": row["url"], "id": own}
                shards.add(row["shard"], member)
                last = key
        shards.close()
        return Written(shards.done)

    def commit(self, messages) -> None:
        files, at = place(self.path)
        done = sorted((f for m in messages if m is not None for f in m.files), key=lambda f: f["name"])
        for f in done:
            files.move(f["from"], f"{at}/{f['name']}")
        put(files, f"{at}/{MANIFEST}", json.dumps({"files": [{k: v for k, v in f.items() if k != "from"} for f in done]}, indent=1).encode())
        self.abort(messages)

    def abort(self, messages) -> None:
        files, at = place(self.path)
        if files.get_file_info(f"{at}/_temporary/{self.job}").type == fs.FileType.Directory:
            files.delete_dir(f"{at}/_temporary/{self.job}")


def members(stream, sha, step: int = 1 << 14):
    """The decompressed members of a stream, one at a time."""
    unzip, parts = zlib.decompressobj(wbits=31), []
    while data := stream.read(1 << 20):
        sha.update(data)
        view = memoryview(data)
        for i in range(0, len(view), step):  # short steps, as what follows a member's end is copied
            rest = bytes(view[i : i + step])
            while rest:
                parts.append(unzip.decompress(rest))
                rest = unzip.unused_data
                if unzip.eof:
                    yield b"".join(parts)
                    unzip, parts = zlib.decompressobj(wbits=31), []
    if parts and any(parts):
        raise ValueError("a record is cut off")


def parsed(data: bytes) -> tuple[dict, bytes]:
    """Headers by lower-case name, and the block, of a record whose digest fits."""
    head, _, rest = data.partition(END)
    version, *lines = head.decode().split("\r\n")
    found = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(found["content-length"])]
    if not version.startswith("WARC/") or rest[len(block) :] != END or f"sha256:{hashlib.sha256(block).hexdigest()}" != found["warc-block-digest"]:
        raise ValueError(f"not a whole record: {found.get('warc-record-id')}")
    return found, block


SCHEMA = "record_id string, record_type string, target_uri string, page string, payload_digest string, payload_bytes long, refers_to string, refers_to_page string, payload binary"
ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in SCHEMA.split(", "))])


class Reader(DataSourceReader):
    """The records of the files that the manifest names, a task a file."""

    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "true") == "true"

    def partitions(self) -> list[InputPartition]:
        files, at = place(self.path)
        with files.open_input_stream(f"{at}/{MANIFEST}") as f:
            return [InputPartition(x) for x in json.loads(f.read())["files"]] or [InputPartition(None)]

    def read(self, partition):
        if partition.value is None:
            return
        files, at = place(self.path)
        sha, rows, size, n = hashlib.sha256(), [], 0, 0
        with files.open_input_stream(f"{at}/{partition.value['name']}", compression=None) as stream:
            for data in members(stream, sha):
                found, block = parsed(data)
                if found["warc-type"] == "warcinfo":
                    continue
                n += 1
                http, _, payload = block.partition(END)
                fields = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
                digest, length = found["warc-payload-digest"].removeprefix("sha256:"), int(fields["Content-Length"])
                if found["warc-type"] == "response":
                    if hashlib.sha256(payload).hexdigest() != digest or len(payload) != length:
                        raise ValueError(f"the payload of {found['warc-record-id']} is not the one written")
                rows.append((found["warc-record-id"], found["warc-type"], found.get("warc-target-uri"), found.get("page-id"), digest, length, found.get("warc-refers-to"), found.get("refers-to-page-id"), payload if self.payload and found["warc-type"] == "response" else None))
                size += len(payload) if self.payload else 0
                if len(rows) == 4096 or size > 4 << 20:
                    yield self.batch(rows)
                    rows, size = [], 0
        if sha.hexdigest() != partition.value["sha256"] or n != partition.value["records"]:
            raise ValueError(f"{partition.value['name']} is not the file of the manifest")
        yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(ARROW)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)


class Archives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc_shards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(dict(self.options))


def sharded(pages: DataFrame, least: int = LEAST, shard_bytes: int = SHARD) -> DataFrame:
    """The rows that Writer takes, dealt and sorted."""
    spark = pages.sparkSession
    text = F.coalesce("html", F.lit(""))
    own = pages.select("page_id", "url", text.cast("binary").alias("payload"), F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("url").isNull().alias("no_url"), "url")
    counts = written(own.groupBy("digest", "bytes").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")))
    rows, size = (x or 0 for x in counts.agg(F.sum("n"), F.sum(F.col("n") * F.col("bytes"))).first())
    shards = max(1, -(-size // shard_bytes), min(parallelism(spark), rows // FEW))
    share = max(FEW, rows // (HOT * shards))
    hot = counts.filter(F.col("n") > share).select("digest", F.col("first.page_id").alias("first_page"), F.col("first.url").alias("first_url"), F.ceil(F.col("n") / share).alias("cuts"))
    own = own.join(F.broadcast(hot), "digest", "left").withColumn("cut", F.col("cuts").isNotNull())  # below HOT digests a shard
    split = F.when(F.col("cut"), F.pmod(F.xxhash64("page_id", "url"), "cuts"))
    ranged = ((F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * shards) / (1 << 32)).cast("int")
    leads = F.col("page_id").eqNullSafe(F.col("first_page")) & F.col("url").eqNullSafe(F.col("first_url"))
    revisits = F.col("bytes") >= least
    name = F.when(F.col("cut"), F.format_string("%05d-%s-%05d", ranged, F.substring("digest", 1, 16), split)).otherwise(F.format_string("%05d", ranged))
    own = own.withColumn("payload", F.when(~F.col("cut") | ~revisits | leads, F.col("payload"))).withColumn("shard", name).withColumn("revisits", revisits)
    dealt = own.repartitionById(shards, F.when(F.col("cut"), F.pmod(F.xxhash64("digest", split), F.lit(shards)).cast("int")).otherwise(ranged))
    sort = [F.col("page_id").asc_nulls_last(), F.col("url").asc_nulls_last()]
    return dealt.sortWithinPartitions("shard", "digest", *sort).select("shard", "digest", F.col("page_id").cast("string").alias("page"), "url", "bytes", "payload", "revisits", "cut", F.col("first_page").cast("string").alias("first_page"), "first_url")


def write(pages: DataFrame, path: str, file_bytes: int = FILE, least: int = LEAST, date: str = DATE, shard_bytes: int = SHARD) -> None:
    """Archives of the pages in a folder that holds none yet."""
    pages.sparkSession.dataSource.register(Archives)
    rows = sharded(pages, least, shard_bytes)
    rows.write.format(Archives.name()).mode("append").option("file_bytes", file_bytes).option("date", date).save(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """A row for each record; payload: with the bytes of responses."""
    spark.dataSource.register(Archives)
    return spark.read.format(Archives.name()).option("payload", "true" if payload else "false").load(path)


def archived(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each page, as the archives written for them say."""
    spark, kind = pages.sparkSession, dict(pages.dtypes)["page_id"]
    path = path or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write(pages, path, **options)
    own = lambda c: F.url_decode(c).cast(kind)
    return read(spark, path, payload=False).select(own("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", own("refers_to_page").alias("refers_to"))


def oracle(least: int = LEAST) -> str:
    """DuckDB SQL for the rows of archived over pages with distinct page_ids."""
    return f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= {least} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM f"""
