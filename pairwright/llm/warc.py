"""WARC writing and reading with segment reassembly.

``write_archives`` writes gzip-compressed WARC/1.1 files with Spark's own text writer: a record per
page, its block an HTTP response in chunked transfer framing. Blocks longer than ``segment_bytes``
are cut into a first record and continuation records (WARC-Segment-Origin-ID, -Number and, on the
last, -Total-Length). Pages whose payload another page has too are written once in full, under the
largest page_id; the others are revisit records without payload.

``read_archives`` reads them with Spark's text reader, which unzips as it goes and cuts at the start of
records, so that a task holds a record and not an archive, however large; a payload that holds such a cut is put together
again by its Content-Length. It parses each record once, groups segments by origin, orders them by number, checks
the total length, and decodes the chunked framing.

Defined cases: null html is an empty payload; a null url becomes the record's own urn; control
characters and blanks in urls are percent-encoded; rows with a null page_id are revisits where the
group has a page_id and responses with no refers_to else; repeated rows (equal page_id and payload)
are records with one id, each read back; an empty table gives no records; other columns are ignored.
A record with a bad head, of fewer bytes than it declares or with bad framing, and a group of segments with gaps or a wrong
total length, gets ``error`` and a null payload; the records after it are read. What couldn't be measured has no digest.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, shared_dir, staged

CRLF = "\r\n"
#: What every record begins with. (No part of it is its own start: readers lose cuts at the edges of their buffers else.)
CUT = "WARC/1."
_HEX, _B32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PARSED = "record_id string, page_id long, record_type string, refers_to long, digest string, declared_bytes long, origin string, segment int, total_length long, block binary, payload binary, error string"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits are four base32 digits."""
    h = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(h, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _HEX, _B32)


def _chunked(payload: Column, size: int) -> Column:
    n = F.octet_length(payload)

    def chunk(i: Column) -> Column:
        length = F.least(F.lit(size), n - i * size)
        return F.concat(F.lower(F.hex(length)), F.lit(CRLF), F.substring(payload, i * size + 1, length).cast("string"), F.lit(CRLF))

    chunks = F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), chunk), "")).otherwise("")
    return F.concat(chunks, F.lit("0" + CRLF + CRLF))


def _urn(page_id: Column, digest: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"), digest, F.lit(">"))


def write_archives(
    pages: DataFrame, *, min_revisit_bytes: int = 0, segment_bytes: int = 32768, chunk_bytes: int = 8192,
    records_per_archive: int = 4096, date: str = "1970-01-01T00:00:00Z",
) -> str:
    """Write the records of ``pages`` (page_id, url, html) and return the folder of archives."""
    spark = pages.sparkSession
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    own = pages.select("page_id", "url", payload.alias("payload"))
    own = own.withColumns({"digest": base32_sha1(F.col("payload")), "n": F.octet_length("payload")})
    groups = own.where(F.col("n") >= min_revisit_bytes).groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.max("page_id").alias("holder"))
    # Written first, so that the planner knows its size when it joins: few groups are broadcast, many are shuffled.
    groups = staged(groups.where("copies > 1 and holder is not null").select("digest", "holder"), "warc-copies")
    own = own.join(groups, "digest", "left")
    revisit = F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    head = "HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF
    response = F.concat(F.lit(head + "Transfer-Encoding: chunked" + CRLF + CRLF), _chunked(F.col("payload"), chunk_bytes))
    bare = F.concat(F.lit(head + "Content-Length: "), F.col("n").cast("string"), F.lit(CRLF + CRLF))
    rid = _urn(F.col("page_id"), F.col("digest"))
    url = F.regexp_replace(F.coalesce("url", F.regexp_replace(rid, "[<>]", "")), r"[\x00-\x20\x7f]", "%20")
    own = own.select(
        "digest", rid.alias("rid"), url.alias("url"), F.when(revisit, _urn(F.col("holder"), F.col("digest"))).alias("refers"),
        F.when(revisit, bare).otherwise(response).cast("binary").alias("block"),
    )
    parts = F.greatest(F.lit(1), F.ceil(F.octet_length("block") / segment_bytes)).cast("int")
    own = own.withColumn("parts", parts)
    own = own.select("*", F.explode(F.sequence(F.lit(1), F.col("parts"))).alias("k"))
    piece = F.substring(F.col("block"), (F.col("k") - 1) * segment_bytes + 1, F.lit(segment_bytes))
    first, many, last = F.col("k") == 1, F.col("parts") > 1, F.col("k") == F.col("parts")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    blank = F.lit("")
    record = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.when(~first, F.lit("continuation")).when(F.col("refers").isNotNull(), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.when(first, F.col("rid")).otherwise(F.concat(F.rtrim(F.col("rid"), F.lit(">")), F.lit(":"), F.col("k").cast("string"), F.lit(">")))),
        F.lit(f"WARC-Date: {date}{CRLF}"),
        line("WARC-Target-URI", F.col("url")),
        F.when(first, line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))).otherwise(blank),
        F.when(F.col("refers").isNotNull(), F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", F.col("refers")))).otherwise(blank),
        F.when(~first, line("WARC-Segment-Origin-ID", F.col("rid"))).otherwise(blank),
        F.when(many, line("WARC-Segment-Number", F.col("k").cast("string"))).otherwise(blank),
        F.when(many & last, line("WARC-Segment-Total-Length", F.octet_length("block").cast("string"))).otherwise(blank),
        F.lit("Content-Type: application/http;msgtype=response" + CRLF),
        line("Content-Length", F.octet_length(piece).cast("string")),
        F.lit(CRLF),
        piece.cast("string"),
    )
    path = shared_dir(spark, "warc")
    own.select(record.alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", records_per_archive).text(path)
    return path


_PAGE = re.compile(rb"urn:page:(null|-?\d+):")


def _page_of(urn: bytes | None) -> int | None:
    m = _PAGE.search(urn or b"")
    return None if not m or m[1] == b"null" else int(m[1])


def _head(data: bytes) -> tuple[dict[bytes, bytes], bytes, int]:
    """(headers by lower-case name, what follows them, Content-Length) of a record without the start of its first line."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    size = int(fields.get(b"content-length", b"none"))
    if size < 0 or b"warc-type" not in fields or b"warc-record-id" not in fields:
        raise ValueError("the record's head is incomplete")
    return fields, block, size


def parse_records(pieces: Iterator[tuple[str, bytes]]) -> Iterator[tuple[dict[bytes, bytes], bytes, str | None]]:
    """(headers, block, error) of each record of archives that are cut at ``CUT``. pieces: (file, what follows a cut), in order."""
    cut, file = CUT.encode(), None
    source, queue = iter(pieces), deque()
    waiting: list[bytes] = []  # pieces of a record that declares more bytes than have come
    upto = want = 0
    while True:
        if queue:
            piece, begins = queue.popleft()
        else:
            name, piece = next(source, (None, None))
            begins, file = name != file, name
        if waiting and not begins:
            waiting.append(piece)
            upto += len(cut) + len(piece)
            if upto < want:
                continue
            whole = cut.join(waiting)
            if not whole[len(whole) - (upto - want) :].strip(b"\r\n"):
                fields, block, size = _head(whole)
                waiting = []
                yield fields, block[:size], None
                continue
        elif waiting:
            queue.appendleft((piece, begins))
        if waiting:  # the first piece is cut short; those after it are read for themselves
            fields, block, size = _head(waiting[0])
            queue.extendleft((x, False) for x in reversed(waiting[1:]))
            waiting = []
            yield fields, b"", f"{len(block)} bytes, the head says {size}"
            continue
        if piece is None:
            return
        if not piece.strip():  # what stands before a file's first record
            continue
        try:
            fields, block, size = _head(piece)
        except ValueError as e:
            yield {}, b"", f"bad record: {e}"
            continue
        if len(block) < size:
            waiting, upto, want = [piece], len(block), size
        elif block[size:].strip(b"\r\n"):
            yield fields, b"", f"{len(block)} bytes, the head says {size}"
        else:
            yield fields, block[:size], None


def decode_http(block: bytes) -> tuple[bytes | None, int | None]:
    """(payload, its length by Content-Length) of an HTTP response; chunked framing is decoded. Payload None if the body is absent."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    if fields.get(b"transfer-encoding", b"").lower() != b"chunked":
        n = int(fields.get(b"content-length", len(body)))
        return (body if len(body) == n else None), n
    out, at = [], 0
    while True:
        stop = body.index(b"\r\n", at)
        n = int(body[at:stop].split(b";")[0], 16)
        at = stop + 2
        if n < 0:
            raise ValueError("a chunk of negative size")
        if n == 0:
            return b"".join(out), None
        if len(body) < at + n + 2:
            raise ValueError("chunk is cut short")
        out.append(body[at : at + n])
        at += n + 2


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per record: whole ones with their payload or an error, segments with their block."""
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in _PARSED.split(", "))])
    rows: list[tuple] = []
    held = 0

    def flush() -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    def text(value: bytes | None) -> str | None:
        return value.decode("utf-8", "replace") if value else None

    for head, block, error in parse_records((f, p.as_py()) for b in batches for f, p in zip(b.column("file").to_pylist(), b.column("piece"), strict=True)):
        kind, rid = text(head.get(b"warc-type")), head.get(b"warc-record-id")
        number, total = (int(x) if (x := head.get(f"warc-segment-{name}".encode(), b"")).isdigit() else None for name in ("number", "total-length"))
        payload = declared = keep = None
        if error is None and number is not None:
            keep = block
        elif error is None:
            try:
                payload, declared = decode_http(block)
                payload = None if kind == "revisit" else payload
                if kind != "revisit" and payload is None:
                    error = "the body isn't as long as its head says"
            except ValueError as e:
                error = str(e)
        number = number if keep is not None else None
        origin = head.get(b"warc-segment-origin-id", rid) if number is not None else None
        digest = text(head.get(b"warc-payload-digest", b"").removeprefix(b"sha1:"))
        rows.append((text(rid), _page_of(rid), kind, _page_of(head.get(b"warc-refers-to")), digest, declared, text(origin), number, total, keep, payload, error))
        held += len(keep or b"") + len(payload or b"") + 200
        if held > 4 << 20:
            yield flush()
            rows, held = [], 0
    yield flush()


def _join_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of one origin, ordered by number, to a payload or an error."""
    for batch in batches:
        payloads, errors = [], []
        for r in batch.select(["parts", "total_length"]).to_pylist():
            payload = error = None
            numbers = [p["segment"] for p in r["parts"]]
            block = b"".join(p["block"] for p in r["parts"])
            if numbers != list(range(1, len(numbers) + 1)):
                error = f"segments {numbers[:20]} have gaps"
            elif r["total_length"] is None:
                error = "the last segment is missing"
            elif len(block) != r["total_length"]:
                error = f"{len(block)} bytes, the last segment says {r['total_length']}"
            else:
                try:
                    payload, _ = decode_http(block)
                except ValueError as e:
                    error = str(e)
            payloads.append(payload)
            errors.append(error)
        cols = [batch.column(c) for c in ("record_id", "page_id", "record_type", "refers_to", "digest", "copies")]
        names = ["record_id", "page_id", "record_type", "refers_to", "digest", "copies", "payload", "error"]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(payloads, pa.binary()), pa.array(errors, pa.string())], names=names)


def read_archives(spark: SparkSession, path: str, names: str = "*.txt*") -> DataFrame:
    """record_id, page_id, record_type, refers_to, digest (as the record says), declared_bytes, payload (null for revisits), error."""
    files = spark.read.option("lineSep", CUT).option("pathGlobFilter", names).text(path)
    parsed = staged(map_batches(files.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece")), _parse_batches, _PARSED), "warc-records")
    whole = parsed.where("segment is null").select("record_id", "page_id", "record_type", "refers_to", "digest", "declared_bytes", "payload", "error")
    one = parsed.where("segment is not null").groupBy("origin").agg(
        F.max(F.when(F.col("segment") == 1, F.struct("record_id", "page_id", "record_type", "refers_to", "digest"))).alias("first"),
        F.count(F.when(F.col("segment") == 1, 1)).alias("copies"),
        F.max("total_length").alias("total_length"),
        F.array_sort(F.collect_set(F.struct("segment", "block"))).alias("parts"),
    )
    one = map_batches(
        one.select("first.*", "copies", "total_length", "parts"), _join_batches,
        "record_id string, page_id long, record_type string, refers_to long, digest string, copies long, payload binary, error string",
    )
    one = one.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest("copies", F.lit(1).cast("long")))))
    return whole.unionByName(one.drop("copies", "copy"), allowMissingColumns=True)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to, error; of responses measured on the payload, of revisits as declared."""
    r = read_archives(spark, path).withColumn("measured", base32_sha1(F.col("payload")))
    r = r.withColumn("error", F.coalesce("error", F.when(F.col("measured") != F.col("digest"), "the payload's digest differs")))
    revisit = (F.col("record_type") == "revisit") & F.col("error").isNull()
    return r.select(
        "page_id",
        F.coalesce(F.octet_length("payload").cast("long"), F.when(revisit, F.col("declared_bytes"))).alias("payload_bytes"),
        F.coalesce("measured", F.when(revisit, F.col("digest"))).alias("payload_digest"),
        "record_type",
        "refers_to",
        "error",
    )
