"""Web archives of Zstandard frames: a writer, and a reader that checks what it reads.

An archive starts with a skippable frame that carries a dictionary; then each record is one frame
compressed with it. Executors write archives to the shared folder under a name of the attempt and the
listing of archives has the successful attempts only, so a lost executor leaves no wrong record.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, shared_dir

SKIPPABLE = 0x184D2A5D
FRAME = 0xFD2FB528
DATE = "2024-01-01T00:00:00Z"
NO_ID = "null"


class BadArchive(ValueError):
    """A frame, header or length that isn't as it must be."""


@dataclass
class Record:
    kind: str
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, is_revisit: bool) -> bytes:
    """One WARC record; a revisit carries the HTTP header of the full payload and no body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    name = NO_ID if page_id is None else str(page_id)
    target = " ".join((url or "urn:x-none").split()) or "urn:x-none"
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{name}>", f"WARC-Target-URI: {target}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if is_revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{NO_ID if refers_to is None else refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> Record:
    """Headers, HTTP headers and payload of one record; raises BadArchive where they don't hold together."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise BadArchive("no WARC version line")
    headers = {}
    for line in lines[1:]:
        k, colon, v = line.partition(":")
        if not colon or not k:
            raise BadArchive(f"header without a name: {line[:60]!r}")
        headers[k.strip().lower()] = v.strip()
    for must in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if must not in headers:
            raise BadArchive(f"{must} is missing")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise BadArchive("Content-Length and block don't agree")
    kind = headers["warc-type"]
    http_head, found, payload = rest[:-4].partition(b"\r\n\r\n")
    http_lines = http_head.decode("utf-8").split("\r\n")
    if not found or not http_lines[0].startswith("HTTP/"):
        raise BadArchive("no HTTP header in the block")
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http_lines[1:])}
    if kind == "response":
        if int(http["content-length"]) != len(payload):
            raise BadArchive("HTTP Content-Length and payload don't agree")
        if headers.get("warc-payload-digest", "sha256:" + hashlib.sha256(payload).hexdigest()) != "sha256:" + hashlib.sha256(payload).hexdigest():
            raise BadArchive("payload digest doesn't agree")
    elif kind == "revisit":
        if payload or "warc-refers-to" not in headers or "warc-profile" not in headers:
            raise BadArchive("a revisit has a profile, what it refers to, and no payload")
    else:
        raise BadArchive(f"unexpected record type {kind}")
    return Record(kind, headers, http, payload)


def train_dictionary(samples: list[bytes], size: int = 16384) -> zstandard.ZstdCompressionDict:
    """Dictionary from the archive's first records; the plain records where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[:size] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive_start(dictionary: zstandard.ZstdCompressionDict) -> bytes:
    data = dictionary.as_bytes()
    return struct.pack("<II", SKIPPABLE, len(data)) + data


def frame_end(data: memoryview, at: int) -> int:
    """Offset after the Zstandard frame that begins at ``at``, from its block headers."""
    start = at
    at += zstandard.frame_header_size(data[at : at + 18])
    checksum = 4 if data[start + 4] & 4 else 0
    while True:
        if at + 3 > len(data):
            raise BadArchive("the archive ends inside a frame")
        block = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            break
    if at + checksum > len(data):
        raise BadArchive("the archive ends inside a frame")
    return at + checksum


def read_archive(data: bytes) -> Iterator[Record]:
    """Records of one archive: dictionary from the leading skippable frame, then one record a frame."""
    view, at = memoryview(data), 0
    dictionary = None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", data, 4)[0]
        if 8 + size > len(data):
            raise BadArchive("the archive ends inside its dictionary")
        own = bytes(view[8 : 8 + size])
        if own[:4] == struct.pack("<I", FRAME):  # the dictionary may be compressed itself
            own = zstandard.ZstdDecompressor().decompressobj().decompress(own)
        dictionary, at = zstandard.ZstdCompressionDict(own), 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(data):
        if len(data) - at < 8:
            raise BadArchive("bytes after the last frame")
        magic = struct.unpack_from("<I", data, at)[0]
        if magic >> 4 == SKIPPABLE >> 4:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        if magic != FRAME:
            raise BadArchive(f"no frame at {at}")
        end = frame_end(view, at)
        frame = view[at:end]
        raw = reader.decompress(frame) if zstandard.frame_content_size(frame) >= 0 else reader.decompressobj().decompress(frame)
        yield parse_record(raw)
        at = end


def _writer(root: str, roll_bytes: int, samples: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        context = TaskContext.get()
        state = {"out": None, "packer": None, "n": 0, "part": 0}
        waiting: list[bytes] = []
        waiting_bytes = 0
        done: list[tuple[str, int]] = []

        def close() -> None:
            if state["out"] is None:
                return
            name = f"{base}/pages-{context.partitionId():06d}-{context.taskAttemptId()}-{state['part']:04d}.warc.zst"
            with store.open_output_stream(name) as f:
                f.write(state["out"].getvalue())
            done.append((name, state["n"]))
            state.update(out=None, n=0, part=state["part"] + 1)

        def put(raw: bytes) -> None:
            state["out"].write(state["packer"].compress(raw))
            state["n"] += 1
            if state["out"].tell() >= roll_bytes:
                close()

        def flush() -> None:
            nonlocal waiting, waiting_bytes
            if waiting and state["out"] is None:
                dictionary = train_dictionary([r[:65536] for r in waiting[:samples]])
                state.update(out=io.BytesIO(archive_start(dictionary)), packer=zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True))
                state["out"].seek(0, 2)
            pending, waiting, waiting_bytes = waiting, [], 0
            for i, raw in enumerate(pending):
                if state["out"] is None:  # rolled over in the middle
                    waiting = pending[i:]
                    flush()
                    return
                put(raw)

        for batch in batches:
            for page_id, url, page, digest, size, refers, again in zip(*(batch.column(i) for i in range(batch.num_columns)), strict=True):
                again = again.as_py()
                body = b"" if again else (page.as_py() or "").encode("utf-8", "replace")
                raw = record_bytes(page_id.as_py(), url.as_py(), body, digest.as_py(), size.as_py(), refers.as_py(), again)
                waiting.append(raw)
                waiting_bytes += len(raw)
                if state["out"] is not None or len(waiting) >= samples or waiting_bytes > 16_000_000:
                    flush()
        flush()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["path", "records"])

    return write


#: Groups that the rows of one digest, and the rows that have no digest to look up, are dealt to.
SALTS, SPREAD = 16, 4096


def with_first_copies(rows: DataFrame, least: int) -> DataFrame:
    """``rows`` (page_id, url, html, digest, size) with ``refers``, the smallest page_id of the payload, and ``again``, whether the row is a revisit.

    Digests of repeated payloads of ``least`` bytes are looked up by digest and one of ``SALTS`` groups, so
    a payload that a third of all rows share is many groups; shorter payloads carry a group number that no
    digest has and are spread evenly, though a million of them may be equal. The html of revisits doesn't leave the join.
    """
    firsts = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = firsts.where("n > 1 and first is not null").select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("group"))
    own = F.xxhash64("page_id", "url")
    group = F.when(F.col("size") >= least, F.pmod(own, F.lit(SALTS))).otherwise(SALTS + F.pmod(own, F.lit(SPREAD)))
    rows = rows.withColumn("group", group.cast("int")).join(firsts, ["digest", "group"], "left").drop("group")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select("page_id", "url", F.when(~again, F.col("html")).alias("html"), "digest", "size", F.when(again, F.col("first")).alias("refers"), again.alias("again"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100, roll_bytes: int = 16_000_000, samples: int = 200) -> DataFrame:
    """Writes a record for every row; returns the checkpointed listing ``path``, ``records``.

    Of the rows with equal payloads of at least ``least`` bytes that with the smallest id is the
    response (all its repeats too, if the id is repeated); the others are revisits. The folder stays until its owner removes it.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha2(F.col("html").cast("binary"), 256), "size": F.octet_length("html").cast("long")})
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    return checkpoint(with_first_copies(rows, least).mapInArrow(_writer(folder, roll_bytes, samples), "path string, records long"))


def _page(name: str) -> int | None:
    found = name.removeprefix("<urn:x-page:").removesuffix(">")
    return None if found == NO_ID else int(found)


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, records in zip(batch["path"].to_pylist(), batch["records"].to_pylist(), strict=True):
                with store.open_input_stream(path) as f:
                    data = f.read()
                cols: list[list] = [[] for _ in range(7)]
                for r in read_archive(data):
                    refers = r.headers.get("warc-refers-to")
                    digest = r.headers["warc-payload-digest"].removeprefix("sha256:")
                    body = None if r.kind == "revisit" else r.payload.decode("utf-8")
                    values = (_page(r.headers["warc-record-id"]), r.headers["warc-target-uri"], int(r.http["content-length"]), digest, r.kind, _page(refers) if refers else None, body)
                    for c, v in zip(cols, values, strict=True):
                        c.append(v)
                if len(cols[0]) != records:
                    raise BadArchive(f"{path} holds {len(cols[0])} records, not {records}")
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                for i in range(0, records, 1000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 1000], k) for c, k in zip(cols, kinds, strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"])

    return read


def read_archives(listing: DataFrame, folder: str) -> DataFrame:
    """Records of the listed archives, validated: page_id, url, payload_bytes, payload_digest, record_type, refers_to, html (null for revisits).

    One task reads the archives of one partition of the listing; :func:`write_archives` has one for each writing task. The listing is
    not shuffled: it is so small that adaptive execution would put all of it in one task.
    """
    return listing.mapInArrow(_reader(folder), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None) -> DataFrame:
    """Archives written for ``pages`` in the shared folder and read back; see :func:`read_archives`.

    Null html is the empty payload; payloads under 100 bytes are always responses; a null id is kept
    (it refers to the smallest id that is not null); a null url becomes ``urn:x-none`` and line ends in urls become spaces.
    An empty table gives no record. Other columns are ignored.
    """
    folder = folder or f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(pages, folder, id_col, url_col, html_col), folder)
