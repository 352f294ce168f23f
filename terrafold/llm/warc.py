"""WARC bundles: independent Zstandard frames, a footer seek table and a record index.

A bundle is a file ``<SHA-1>.warc.zst`` in the folder that all executors share. Records are grouped into independent
frames of about ``FRAME_BYTES`` each, so that like pages are compressed together, and a reader seeks to one frame, which is
read and decompressed alone; a skippable frame at the end holds the seek table (compressed and plain size of each frame) in
the public seekable Zstandard layout. The index, a table beside the files, maps each record id to its frame, its offset
in the plain frame and its size, and lists where each frame begins, as the seek table does. Files are written under another name and
then moved, so a task that runs again leaves the same files; the folder may be in any store that Arrow's file systems open.

Equal payloads of at least ``least_bytes`` are stored once: the record with the largest id is the response, the others
are revisits that refer to it. A response holds an HTTP message whose body is the payload; a revisit holds the message's
head, which tells the payload's length. Pages have no time of their own, so all records bear ``date``.

Null html is the empty payload; equal means equal SHA-1 and length; a null or blank url becomes ``urn:page:<id>``. Empty
tables give empty results; repeated ids give a record each, with record ids of their own (the digest's largest id is the
response, and its repeats are responses too); a null id is kept as null and its record is a response; extra columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, written

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1  # fixed values of the seekable format
#: A frame is closed when its plain records exceed the one, a bundle when its frames exceed the other.
FRAME_BYTES, BUNDLE_BYTES = 256_000, 8_000_000
BUNDLES = (
    "bundle string, record_id array<long>, frame array<int>, record_offset array<long>, record_size array<long>, "
    "frame_offset array<long>, frame_size array<long>"
)
DATE = "1970-01-01T00:00:00Z"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or a local path."""
    return fs.FileSystem.from_uri("/" + path[5:].lstrip("/") if path.startswith("file:") else path)


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer: a skippable frame with compressed and plain size of each frame."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(file: fs.NativeFile) -> list[tuple[int, int]]:
    """(offset, size) of every frame, from the footer alone."""
    end = file.size()
    count, _, magic = struct.unpack("<IBI", file.read_at(9, end - 9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    body, out, at = file.read_at(8 * count, end - 9 - 8 * count), [], 0
    for size, _ in struct.iter_unpack("<II", body):
        out.append((at, size))
        at += size
    return out


def record(page: dict, digest: str, name: str, date: str = DATE) -> bytes:
    """One WARC/1.1 record of a planned page; ``name`` makes its record id."""
    uri = lambda url, i: "".join(c for c in url or "" if c > " ") or f"urn:page:{i}"
    revisit = page["kind"] == "revisit"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {page['size']}\r\n\r\n".encode()
    if not revisit:
        block += page["payload"] or b""
    lines = [
        "WARC/1.1", f"WARC-Type: {page['kind']}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>",
        f"WARC-Date: {date}", f"WARC-Target-URI: {uri(page['url'], page['page_id'])}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if page["page_id"] is not None:
        lines.append(f"X-Page-ID: {page['page_id']}")
    if revisit:
        lines += [
            f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To-Target-URI: {uri(page['keeper_url'], page['refers_to'])}",
            f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page: {page['refers_to']}",
        ]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields after the first line, and what follows the blank line."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    return dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:]), rest


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Fields of a record, fields of its HTTP head, and the payload (empty in a revisit)."""
    fields, rest = headers(raw)
    http, payload = headers(rest[: int(fields["Content-Length"])])
    return fields, http, payload


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, size, sha1 (hex), kind and refers_to of each page.

    Only digests with more than one page are joined back; the counted side has one row a digest, so a hot payload
    lies on one side of the join only and Spark splits it there.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))
    digests = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    digests = digests.select("page_id", "url", F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("sha1"))
    shared = (
        digests.where(F.col("size") >= least_bytes)
        .groupBy("sha1", "size")
        .agg(F.max(F.struct("page_id", "url")).alias("keeper"), F.min("page_id").alias("least"))
        .where(F.col("least") < F.col("keeper")["page_id"])
        .select("sha1", "size", F.col("keeper")["page_id"].alias("keeper"), F.col("keeper")["url"].alias("keeper_url"))
    )
    joined = rows.join(shared, ["sha1", "size"], "left")
    other = F.coalesce(F.col("page_id") < F.col("keeper"), F.lit(False))
    return joined.select(
        "page_id", "url", F.when(~other, F.col("payload")).alias("payload"), "size", "sha1",
        F.when(other, "revisit").otherwise("response").alias("kind"), F.when(other, F.col("keeper")).alias("refers_to"), "keeper_url",
    )


def write_bundles(records: DataFrame, folder: str, bundle_bytes: int = BUNDLE_BYTES, date: str = DATE, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write the records of each partition as bundle files, named by their contents; one index row a bundle."""

    def bundles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, place = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId()
        store, root = opened(folder)
        frames: list[bytes] = []  # compressed, of the bundle at hand
        sizes: list[tuple[int, int]] = []
        index: list[tuple[int | None, int, int, int]] = []  # id, frame, offset in the frame, size
        plain: list[bytes] = []  # records of the frame at hand
        inside, n = 0, 0

        def close_frame() -> None:
            nonlocal inside
            if plain:
                frames.append(packer.compress(b"".join(plain)))
                sizes.append((len(frames[-1]), inside))
                plain.clear()
                inside = 0

        def close() -> pd.DataFrame:
            close_frame()
            whole = b"".join([*frames, seek_table(sizes)])
            name = f"{hashlib.sha1(whole).hexdigest()}.warc.zst"
            store.create_dir(root, recursive=True)
            hidden = f"{root}/.{uuid.uuid4().hex}"
            with store.open_output_stream(hidden) as out:
                out.write(whole)
            store.move(hidden, f"{root}/{name}")
            starts = list(accumulate((size for size, _ in sizes), initial=0))[:-1]
            row = [f"{folder}/{name}", *[list(x) for x in zip(*index, strict=True)], starts, [size for size, _ in sizes]]
            for x in (frames, sizes, index):
                x.clear()
            return pd.DataFrame([row], columns=[x.split()[0] for x in BUNDLES.split(", ")])

        for pdf in batches:
            for page in pdf.to_dict("records"):
                page |= {c: None if page[c] is None else int(page[c]) for c in ("page_id", "refers_to")}
                raw = record(page, base64.b32encode(bytes.fromhex(page["sha1"])).decode(), f"{page['page_id']}/{place}/{n}", date)
                index.append((page["page_id"], len(frames), inside, len(raw)))
                plain.append(raw)
                inside, n = inside + len(raw), n + 1
                if inside >= frame_bytes:
                    close_frame()
                if sum(size for size, _ in sizes) >= bundle_bytes:
                    yield close()
        if index:
            yield close()

    # ids as text: a nullable long would pass pandas as a double
    return records.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")}).mapInPandas(bundles, BUNDLES)


READ = "bundle string, record_id string, record_type string, url string, payload binary, payload_bytes long, payload_digest string, refers_to string"


def known(x: float | int | None) -> int | None:
    return None if x is None or x != x else int(x)


def read_bundles(bundles: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of an index's bundles, frame by frame through the seek table and checked against index and digest."""

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpacker = zstandard.ZstdDecompressor()
        for pdf in batches:
            for name, ids, frames, offsets, sizes, starts, lengths in zip(*(pdf[c] for c in pdf), strict=True):
                store, path = opened(name)
                rows, held, at, plain = [], 0, -1, b""
                with store.open_input_file(path) as file:
                    table = read_seek_table(file)
                    if table != list(zip(starts, lengths, strict=True)):
                        raise ValueError(f"bundle {name}: index and seek table differ")
                    for want, frame, offset, size in zip(map(known, ids), frames, offsets, sizes, strict=True):
                        if frame != at:
                            plain, at = unpacker.decompress(file.read_at(table[frame][1], table[frame][0])), frame
                        fields, http, payload = parse(plain[offset : offset + size])
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        whole = fields["WARC-Type"] == "response"
                        wrong = whole and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest
                        if wrong or fields.get("X-Page-ID") != (None if want is None else str(want)):
                            raise ValueError(f"bundle {name}, record {want}: wrong record at its offset")
                        url = fields["WARC-Target-URI"]
                        kept = payload if with_payload and whole else None
                        rows.append((
                            name, fields.get("X-Page-ID"), fields["WARC-Type"], None if url.startswith("urn:page:") else url, kept,
                            len(payload) if whole else int(http["Content-Length"]), digest, fields.get("X-Refers-To-Page"),
                        ))
                        held += len(kept or b"")
                        if held > 16_000_000:
                            yield pd.DataFrame(rows, columns=[x.split()[0] for x in READ.split(", ")])
                            rows, held = [], 0
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in READ.split(", ")])

    # The index is small beside its bundles: dealt by bundle, so that reading is spread over tasks.
    tasks = max(1, min(bundles.count(), 20_000))
    dealt = bundles.select("bundle", "record_id", "frame", "record_offset", "record_size", "frame_offset", "frame_size").repartition(tasks, "bundle")
    return dealt.mapInPandas(records, READ).withColumns({c: F.col(c).cast("long") for c in ("record_id", "refers_to")})


def fetch(bundles: DataFrame, wanted: DataFrame, id_col: str = "record_id") -> DataFrame:
    """The raw records of the wanted ids: the index gives file and frame, the footer where it lies, and only that is read."""
    index = bundles.select("bundle", F.explode(F.arrays_zip("record_id", "frame", "record_offset", "record_size")).alias("x"))
    hits = index.select("bundle", "x.*").join(wanted.select(F.col(id_col).alias("record_id")).distinct(), "record_id")

    def plain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpacker = zstandard.ZstdDecompressor()
        for pdf in batches:
            for name, part in pdf.groupby("bundle"):
                store, path = opened(name)
                with store.open_input_file(path) as file:
                    table = read_seek_table(file)
                    for frame, rows in part.groupby("frame"):
                        whole = unpacker.decompress(file.read_at(table[frame][1], table[frame][0]))
                        cut = [whole[at : at + size] for at, size in zip(rows["record_offset"], rows["record_size"], strict=True)]
                        yield pd.DataFrame({"record_id": rows["record_id"], "record": cut})

    return hits.select("record_id", "bundle", "frame", "record_offset", "record_size").mapInPandas(plain, "record_id long, record binary")


def archive(pages: DataFrame, least_bytes: int = 0, date: str = DATE, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write all pages as bundle files to the shared folder and return their written index."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return written(write_bundles(plan_records(pages, least_bytes), folder, date=date, frame_bytes=frame_bytes), "warc-index")[0]
