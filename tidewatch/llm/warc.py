"""Deterministic sharded WARC writer, and a reader.

Records are dealt to shards by ranges of page_id that follow exact counts, sorted within
them and written as gzip members, one a record; a file is closed when its compressed size
reaches a limit. Headers
are made anew from the record alone (fixed date, ids derived from page_id and payload), so
the archives of equal tables are equal byte by byte. Each file is written under a
temporary name and renamed; a task that runs twice renames equal files onto each other.
The manifest names the files with their sizes, counts and digests, and is committed last,
by one rename from a temporary name; readers ask for it and take only what it names.

Payload digests are counted over the whole table first. Of the records whose payloads are
equal and have at least `revisit_bytes` bytes, the one with the largest page_id is the
response, of several with that page_id the first by url; the others revisit it. Null payloads are empty. Null urls are empty. Rows
without a page_id come before all others: they are records without the header of the id, whose record id follows from the payload alone, and
a response only where no equal payload has an id; what revisits such a response refers to no page_id. Rows of one page_id are records of their own.
Other columns are ignored.

Shards: the range of all page_ids is cut into equal cells; cells of too many pages are cut again by their own lowest and
highest id until none holds more than a shard takes, so outlying ids do not matter; a single id of too many pages is cut by the digests of its payloads. Neighbouring cells
of few pages share a shard. Rows of one id and payload stay in one shard, one after the other.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import posixpath
import uuid

import pyarrow as pa
from pyarrow.fs import FileSelector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_partitions, shared_dir, written

#: Equal cells of the range of all page_ids, and of a range that is cut again, at most; how often ranges are cut; bytes that a partition holds about; shards at most.
CELLS, CELLS_AGAIN, DEPTH, PARTITION_BYTES, SHARDS = 4096, 1024, 6, 64 << 20, 200_000
#: The number by which rows without page_id are dealt.
NO_ID = -(1 << 63)
DATE = "2024-01-31T00:00:00Z"
WRITTEN = "shard long, file string, n_records long, n_bytes long, sha256 string"
READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, body binary"


def store(uri: str):
    """The file system and path of a URI, as seen from any executor."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str, payload: bytes, revisit: bool = False, refers_to: int | None = None) -> bytes:
    """One record: a response with its payload, or a revisit (of refers_to) with the payload's digest and length alone."""
    digest = base32_sha1(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")),
        *([("WARC-Page-ID", str(page_id))] if page_id is not None else []),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
    ]
    if revisit:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(refers_to, digest)),
            *([("WARC-Refers-To-Page-ID", str(refers_to))] if refers_to is not None else []),
        ]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parsed(stream) -> tuple[dict[str, str], bytes]:
    """Header fields and block of the next record of an uncompressed stream; no fields at its end."""
    line = stream.readline()
    if not line:
        return {}, b""
    if line.strip() != b"WARC/1.1":
        raise ValueError(f"no WARC record: {line[:40]!r}")
    fields = {}
    while (line := stream.readline()) not in (b"\r\n", b""):
        name, _, value = line.decode().rstrip("\r\n").partition(": ")
        fields[name] = value
    block = stream.read(int(fields["Content-Length"]))
    if stream.read(4) != b"\r\n\r\n" or f"sha1:{base32_sha1(block)}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return fields, block


def cut(known: DataFrame, pages_per_shard: int) -> tuple[list[DataFrame], DataFrame]:
    """The cuts of the range of ids, level by level (at, cell, to, low, step), and the ranges that are left with the number of their first shard and of their pieces (at, shard, pieces).

    known has the ids (number). All tables have as many rows as there are cells, whose number follows the number of shards."""

    def steps(low: Column, high: Column, n: Column, most: int) -> Column:
        """Width of the cells of a range, 0 where it is small enough or one id."""
        span = high.cast("decimal(20,0)") - low.cast("decimal(20,0)") + 1
        parts = F.least(F.lit(most), F.ceil(8 * n / pages_per_shard))
        return F.when((n > pages_per_shard) & (low < high), F.ceil(span / parts).cast("decimal(20,0)")).otherwise(F.lit(0).cast("decimal(20,0)"))

    ends = known.agg(F.min("number").alias("low"), F.max("number").alias("high"), F.count("*").alias("n"))
    ranges = written(ends.select(F.lit(0).cast("long").alias("to"), "low", "n", steps(F.col("low"), F.col("high"), F.col("n"), CELLS).alias("step")), "range")
    leaves, levels, first = [ranges.filter("step = 0")], [ranges], 1
    for _ in range(DEPTH):
        if levels[-1].filter("step > 0").isEmpty():
            break
        inside = located(known, levels).filter("step > 0")
        counts = inside.groupBy("at", cell_of(F.col("number")).alias("cell")).agg(F.min("number").alias("low"), F.max("number").alias("high"), F.count("*").alias("n"))
        numbers = F.row_number().over(Window.orderBy("at", "cell")) + F.lit(first - 1)
        found = written(counts.select("at", "cell", numbers.cast("long").alias("to"), "low", "n", steps(F.col("low"), F.col("high"), F.col("n"), CELLS_AGAIN).alias("step")), "range")
        levels.append(found)
        leaves.append(found.filter("step = 0").select("to", "low", "n", "step"))
        first += found.count()
    left = levels[-1].filter("step > 0").select("to", "low", "n", "step") if len(levels) > DEPTH else leaves[0].limit(0)
    for leaf in leaves:
        left = left.unionByName(leaf)
    pieces = F.greatest(F.lit(1), F.floor(F.col("n") / pages_per_shard))
    # pages before a range, in the order of ids; a range of one id is as many shards as it has pieces
    before = F.sum("n").over(Window.orderBy("low").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    return levels, left.select(F.col("to").alias("at"), F.floor(before / pages_per_shard).cast("long").alias("shard"), pieces.alias("pieces"))


def cell_of(number: Column) -> Column:
    return F.floor((number.cast("decimal(20,0)") - F.col("low").cast("decimal(20,0)")) / F.col("step")).cast("long")


def located(rows: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """rows with the range (at, low, step) that their number is in, by a look-up a level."""
    rows = rows.join(F.broadcast(levels[0].select(F.col("to").alias("at"), "low", "step")))
    columns = [c for c in rows.columns if c not in ("at", "low", "step")]
    for level in levels[1:]:
        known = F.broadcast(level.select(F.col("at").alias("_at"), F.col("cell").alias("_cell"), "to", F.col("low").alias("_low"), F.col("step").alias("_step")))
        rows = rows.withColumn("cell", F.when(F.col("step") > 0, cell_of(F.col("number"))))
        rows = rows.join(known, (F.col("at") == F.col("_at")) & (F.col("cell") == F.col("_cell")), "left")
        rows = rows.select(*columns, F.coalesce("to", "at").alias("at"), F.coalesce("_low", "low").alias("low"), F.coalesce("_step", "step").alias("step"))
    return rows


def write_archives(pages: DataFrame, target: str, revisit_bytes: int = 0, roll_bytes: int = 32 << 20, pages_per_shard: int = 4096, level: int = 6) -> DataFrame:
    """Writes the archives and their manifest below target; returns the manifest."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("content", F.unhex(F.sha2("payload", 256)))
    known = written(rows.select("page_id", "content", F.octet_length("payload").alias("n"), F.coalesce("page_id", F.lit(NO_ID)).alias("number")), "pages")
    first = known.filter(F.col("n") >= revisit_bytes).groupBy("content").agg(F.max("page_id").alias("response"), F.count("*").alias("size")).filter("size > 1").select("content", "response")
    revisits = known.join(first, "content").filter(~F.col("page_id").eqNullSafe(F.col("response"))).select("page_id", "content", "response").distinct()
    size = known.agg(F.count("*").alias("pages"), F.coalesce(F.sum("n"), F.lit(0)).alias("bytes")).first()
    n_parts = max(n_partitions(spark), -(-size.bytes // PARTITION_BYTES))
    pages_per_shard = max(pages_per_shard, -(-size.pages // SHARDS))
    # payloads are shuffled once: what a page revisits travels as a row of its own, which sorts before the pages of that id and payload
    none = {"url": F.lit(None).cast("string"), "payload": F.lit(None).cast("binary")}
    both = rows.withColumns({"kind": F.lit(1), "response": F.lit(None).cast("long")}).unionByName(revisits.withColumns({"kind": F.lit(0), **none}))
    levels, ranges = cut(known.select("number"), pages_per_shard)
    both = located(both.withColumn("number", F.coalesce("page_id", F.lit(NO_ID))), levels).join(F.broadcast(written(ranges, "shards")), "at")
    # the first four bytes of a digest, as parts of all such numbers
    part = F.conv(F.hex(F.substring("content", 1, 4)), 16, 10).cast("long") * F.col("pieces") / (1 << 32)
    both = both.withColumn("shard", F.col("shard") + F.floor(part).cast("long"))
    shards = both.select("shard", "page_id", "content", "kind", "url", "payload", "response").repartitionByRange(n_parts, "shard").sortWithinPartitions("shard", "page_id", "content", "kind", "url")

    def write(batches):
        fs, root = store(target)
        out, done, shard, part, mark, before = None, [], None, 0, None, None

        def close():
            nonlocal out
            data, n = out
            body = data.getvalue()
            name = f"part-{shard:012d}-{part:05d}.warc.gz"
            temporary = posixpath.join(root, f".{name}.{uuid.uuid4().hex}")
            with fs.open_output_stream(temporary) as f:
                f.write(body)
            fs.move(temporary, posixpath.join(root, name))
            done.append((shard, name, n, len(body), hashlib.sha256(body).hexdigest()))
            out = None

        for batch in batches:
            for at, page_id, content, url, payload, response in zip(*(batch.column(c) for c in ("shard", "page_id", "content", "url", "payload", "response")), strict=True):
                page_id, content = page_id.as_py(), content.as_py()
                if not payload.is_valid:
                    mark = (page_id, content, response.as_py())
                    continue
                # marked, or behind the response of the same id and payload
                payload, marked = payload.as_py(), mark is not None and mark[:2] == (page_id, content)
                revisit = marked or (before == (page_id, content) and len(payload) >= revisit_bytes)
                refers_to, before = mark[2] if marked else page_id, (page_id, content)
                if out and (at.as_py() != shard or out[0].tell() >= roll_bytes):
                    close()
                    part = part + 1 if at.as_py() == shard else 0
                if at.as_py() != shard:
                    shard, part = at.as_py(), 0
                out = out or (io.BytesIO(), 0)
                out[0].write(gzip.compress(record(page_id, url.as_py(), payload, revisit, refers_to), level, mtime=0))
                out = out[0], out[1] + 1
        if out:
            close()
        columns = list(zip(*done, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["shard", "file", "n_records", "n_bytes", "sha256"])

    fs, root = store(target)
    fs.create_dir(root, recursive=True)
    if committed(target):
        raise ValueError(f"{target} holds archives already")
    # the manifest is written under a temporary name and gets its own by one rename, so that it is there as a whole or not at all
    temporary = f".manifest-{uuid.uuid4().hex}"
    shards.mapInArrow(write, WRITTEN).write.parquet(f"{target}/{temporary}")
    fs.move(posixpath.join(root, temporary), posixpath.join(root, "manifest"))
    for left in fs.get_file_info(FileSelector(root)):
        # of attempts that failed or ran twice
        if left.is_file and left.base_name.startswith(".part-"):
            fs.delete_file(left.path)
    return manifest(spark, target)


def committed(target: str) -> bool:
    """Whether the manifest is there, with the mark that Spark leaves when all of it is written."""
    fs, root = store(target)
    return fs.get_file_info(posixpath.join(root, "manifest", "_SUCCESS")).is_file


def manifest(spark: SparkSession, target: str) -> DataFrame:
    if not committed(target):
        raise ValueError(f"{target} holds no committed archives")
    return spark.read.schema(WRITTEN).parquet(f"{target}/manifest")


def read_archives(spark: SparkSession, target: str) -> DataFrame:
    """The records of the files that the manifest names; each file is read as a stream by one task and held against its digest."""

    def read(batches):
        fs, root = store(target)
        for batch in batches:
            for name, size, sha256 in zip(*(batch.column(c).to_pylist() for c in ("file", "n_bytes", "sha256")), strict=True):
                with fs.open_input_stream(posixpath.join(root, name), compression=None) as f:
                    body = f.read()
                if len(body) != size or hashlib.sha256(body).hexdigest() != sha256:
                    raise ValueError(f"{name} is not what the manifest says")
                yield from records(body)

    def records(body: bytes):
        rows, held = [], 0
        with gzip.GzipFile(fileobj=io.BytesIO(body)) as stream:
            while True:
                fields, block = parsed(stream)
                if fields:
                    head, _, payload = block.partition(b"\r\n\r\n")
                    n = int(next(x for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
                    revisit = fields["WARC-Type"] == "revisit"
                    page_id, refers_to = (int(fields[k]) if k in fields else None for k in ("WARC-Page-ID", "WARC-Refers-To-Page-ID"))
                    rows.append((page_id, fields.get("WARC-Target-URI", ""), fields["WARC-Type"], n, fields["WARC-Payload-Digest"].removeprefix("sha1:"), refers_to, None if revisit else payload))
                    held += len(block)
                if rows and (not fields or held >= 4 << 20):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()), strict=True)],
                        ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "body"],
                    )
                    rows, held = [], 0
                if not fields:
                    return

    files = manifest(spark, target)
    n_parts = max(n_partitions(spark), -(-(files.agg(F.sum("n_bytes")).first()[0] or 0) // PARTITION_BYTES))
    return files.repartition(n_parts, "file").mapInArrow(read, READ)


def archive_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes pages to fresh archives in the shared folder and reads them back."""
    target = shared_dir(pages.sparkSession, "warc")
    write_archives(pages, target, **options)
    return read_archives(pages.sparkSession, target)
