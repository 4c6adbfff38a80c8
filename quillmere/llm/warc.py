"""Deterministic sharded WARC writer and reader.

Records are dealt into ranges of page_id, whose bounds follow from a histogram of the bytes and
not from a sample, and sorted. Each range is written as a series of files that are rolled when
they pass a compressed size. A task writes under temporary names that no other attempt uses and
reports its files; Spark's commit of that report decides which attempt counts. The files named
in it are then renamed, and the manifest of final names is what a reader goes by.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.llm.common import written

MOST_BINS = 16_384  # of a histogram; the driver sees so many rows at most
RANGE_BYTES, FILE_BYTES = 32 << 20, 8 << 20
LEAST_PAYLOAD = 100  # bytes from which an equal payload is written as a revisit
STEP = 8192  # compressed bytes that are read at a time
DATE = "2020-01-01T00:00:00Z"


def bounds(pages: DataFrame, range_bytes: int) -> list[int]:
    """The page_ids at which ranges of about range_bytes begin, from exact histograms; the driver sees at most MOST_BINS rows of each.

    A bin that holds more than a range is divided anew between the smallest and largest id that it has, so that ids far
    apart do not put all others into one; ranges grow with the table where MOST_BINS of them would not do.
    """
    sized = pages.select(F.coalesce("page_id", F.lit(-(2**63))).alias("id"), (F.octet_length("html") + 400).alias("n"))
    known = sized.filter(F.col("id") > -(2**63))
    low, high, total = known.agg(F.min("id"), F.max("id"), F.sum("n")).first()
    if total is None:
        return []
    range_bytes = max(range_bytes, -(-total // (MOST_BINS // 4)))
    done, open_ = [], [(low, high, total)]
    while open_:
        shares = [max(2, min(high - low + 1, 2 * -(-n // range_bytes))) for low, high, n in open_]  # together at most MOST_BINS
        edges = sorted({low + (high - low + 1) * k // share for (low, high, _), share in zip(open_, shares, strict=True) for k in range(share)})
        inside = F.expr(" or ".join(f"id between {low}L and {high}L" for low, high, _ in open_)) if len(open_) <= 64 else F.lit(True)
        rows = known.filter(inside).groupBy(place_in(edges, "id").alias("bin")).agg(F.min("id"), F.max("id"), F.sum("n")).collect()
        old, open_ = {(low, high) for low, high, _ in open_}, []
        for _, low, high, n in rows:
            heavy = n > range_bytes and low < high and (low, high) not in old
            (open_ if heavy else done).append((low, high, n))
    starts, held = [], 0
    for low, _, n in sorted(set(done)):
        if held and held + n > range_bytes:
            starts.append(low)
            held = 0
        held += n
    return starts


def place_in(edges: list[int], column: str) -> Column:
    """How many of the sorted edges are no larger than the column: a binary search."""
    if not edges:
        return F.lit(0)
    halves = len(edges).bit_length()
    step = f"if(s.lo >= s.hi, s, if(edges[(s.lo + s.hi) div 2] <= {column}, named_struct('lo', cast((s.lo + s.hi) div 2 + 1 as int), 'hi', s.hi), named_struct('lo', s.lo, 'hi', cast((s.lo + s.hi) div 2 as int))))"
    listed = "array(" + ", ".join(f"{e}L" if e > -(2**63) else "(-9223372036854775807L - 1L)" for e in edges) + ")"
    return F.expr(f"transform(array({listed}), edges -> aggregate(sequence(1, {halves}), named_struct('lo', 0, 'hi', {len(edges)}), (s, i) -> {step}, s -> s.lo))[0]")


def ranges(pages: DataFrame, range_bytes: int) -> DataFrame:
    """pages with `range`: numbers that rise with page_id and hold about range_bytes of html each; null ids come first."""
    starts = bounds(pages, range_bytes)
    return pages.withColumn("range", F.when(F.col("page_id").isNull(), 0).otherwise(place_in(starts, "page_id")))


def record(kind: str, page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None) -> bytes:
    """One WARC record. A revisit keeps the HTTP header and names the record whose payload it shares."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    target = "".join((url or "").split()) or f"urn:page:{page}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {target} {digest} {kind}')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        f"X-Page-Id: {'' if page is None else page}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {refers}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def _write(base: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(base)
        attempt, out = uuid.uuid4().hex, None
        now, number, page, firsts, seen, report = None, 0, None, {}, set(), []

        def close() -> None:
            nonlocal out
            if out is not None:
                out["file"].close()
                report.append((out["name"], out["tmp"], out["n"], out["bytes"], out["sha"].hexdigest()))
                out = None

        for batch in batches:
            for row in batch.to_pylist():
                if row["range"] != now:
                    close()
                    now, number = row["range"], 0
                if row["page_id"] != page:
                    page, firsts, seen = row["page_id"], {}, set()
                if row["kind"] == 0:
                    firsts[row["digest"]] = row["refers"]
                    continue
                payload, digest = row["html"] or b"", row["digest"]
                first = firsts.get(digest)
                again = first is not None and (first != page or digest in seen)
                seen.add(digest)
                member = zlib.compressobj(5, zlib.DEFLATED, 31)
                data = member.compress(record("revisit" if again else "response", page, row["url"], payload, digest, first)) + member.flush()
                if out is None:
                    name = f"pages-{now:06d}-{number:05d}.warc.gz"
                    number += 1
                    tmp = f".{name}.{attempt}"
                    out = {"name": name, "tmp": tmp, "n": 0, "bytes": 0, "sha": hashlib.sha256(), "file": store.open_output_stream(f"{root}/{tmp}", compression=None)}
                out["file"].write(data)
                out["n"] += 1
                out["bytes"] += len(data)
                out["sha"].update(data)
                if out["bytes"] >= file_bytes:
                    close()
        close()
        cols = list(zip(*report, strict=True)) if report else [[]] * 5
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["name", "tmp", "records", "bytes", "sha256"])

    return run


def _rename(base: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(base)
        for batch in batches:
            for name, tmp in zip(batch.column("name").to_pylist(), batch.column("tmp").to_pylist(), strict=True):
                if store.get_file_info(f"{root}/{tmp}").type != pafs.FileType.NotFound:  # else an earlier attempt renamed it
                    store.move(f"{root}/{tmp}", f"{root}/{name}")
            yield batch.select(["name", "records", "bytes", "sha256"])

    return run


def write_archives(pages: DataFrame, base: str, range_bytes: int = RANGE_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes `pages` (page_id, url, html) below `base` and returns the manifest: name, records, bytes, sha256 of each file.

    Of records with equal payloads of at least LEAST_PAYLOAD bytes the one with the smallest page_id
    is a response and the others revisit it. A null html is an empty payload, a null url a URN, a null page_id an
    empty field, sorted first. Of equal rows the first is the response. An empty table gives no file; other columns are not read.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = ranges(pages, range_bytes).withColumn("digest", F.sha2("html", 256))
    small = rows.filter(F.octet_length("html") >= LEAST_PAYLOAD).select("range", "page_id", "digest")
    firsts = small.groupBy("digest").agg(F.min("page_id").alias("refers"), F.count("*").alias("n")).filter("n > 1")
    flags = small.join(firsts, "digest").select("range", "page_id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), "digest", F.lit(None).cast("binary").alias("html"), "refers").distinct()
    both = flags.union(rows.select("range", "page_id", F.lit(1), "url", "digest", "html", F.lit(None).cast("long")))
    store, root = pafs.FileSystem.from_uri(base)
    store.create_dir(root, recursive=True)
    made = both.repartitionByRange("range").sortWithinPartitions("range", "page_id", "kind", "url", "digest")
    report = written(made.mapInArrow(_write(base, file_bytes), "name string, tmp string, records long, bytes long, sha256 string"), "warc-report")
    return written(report.repartition("name").mapInArrow(_rename(base), "name string, records long, bytes long, sha256 string"), "warc-manifest")


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each gzip member of an archive."""
    view, at = memoryview(data), 0
    while at < len(data):
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            if at >= len(data):
                raise ValueError("the last record is cut off")
            part = view[at : at + STEP]
            parts.append(member.decompress(part))
            at += len(part)
        at -= len(member.unused_data)  # of one step at most, so little is copied for each record
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
        yield fields, rest[: int(fields["Content-Length"])]


def _read(base: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(base)
        for batch in batches:
            for name, sha in zip(batch.column("name").to_pylist(), batch.column("sha256").to_pylist(), strict=True):
                with store.open_input_stream(f"{root}/{name}", compression=None) as file:
                    data = file.read()
                if hashlib.sha256(data).hexdigest() != sha:
                    raise ValueError(f"{name} differs from its manifest")
                rows = []
                for fields, block in records(data):
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    if fields["WARC-Type"] == "response" and hashlib.sha256(block.partition(b"\r\n\r\n")[2]).hexdigest() != digest:
                        raise ValueError(f"{name}: a payload differs from its digest")
                    number = lambda x: int(x) if x else None
                    rows.append((number(fields["X-Page-Id"]), int(fields["X-Payload-Length"]), digest, fields["WARC-Type"], number(fields.get("X-Refers-To-Page-Id"))))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return run


def read_archives(manifest: DataFrame, base: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record of the manifest's files, whose digests are checked."""
    n = max(1, manifest.count())
    return manifest.repartition(min(n, 4000)).mapInArrow(_read(base), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
