"""WARC archives compressed with Zstandard and a dictionary of their own.

An archive begins with a skippable frame that holds its dictionary; after it every record
is one frame. Archives are written by Spark's text writer: a row is a frame as it is,
and the line separator is an empty skippable frame, which every reader passes over.
An archive is a partition; it is written in a stream, and read as one file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtrace.llm.tables import ship


# Fixed values of the formats: frame magic numbers, WARC names.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
EMPTY_FRAME = struct.pack("<II", 0x184D2A50, 0)
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSIONS = (b"WARC/1.0", VERSION)
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
DIGESTS = ("md5", "sha1", "sha256", "sha512")

#: Payloads from this size on are written once.
MIN_REVISIT_BYTES = 1_000
#: The first records of an archive that its dictionary is trained on, and its size.
DICTIONARY_RECORDS = 256
DICTIONARY_BYTES = 16 << 10
_FEED = 64 << 10
_EMIT = 2_000
_DATE = "2024-01-01T00:00:00Z"


# --- records -------------------------------------------------------------------


def _digest(sha1: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()


def _clean(value: str) -> str:
    """A header value without control characters."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record_bytes(page_id, url, payload: bytes, sha1: str, refers_to) -> bytes:
    """One WARC record: a response, or a revisit of the page ``refers_to``."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'none' if page_id is None else page_id}>"),
        ("WARC-Date", _DATE),
        ("WARC-Payload-Digest", _digest(sha1)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", _clean(url)))
    if revisit:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head)
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def _headers(text: bytes, strict: bool = True) -> dict[str, str]:
    """Values by name in lower case; of a repeated name the first. A folded line goes on with the one before.

    Lines without a name are an error, or passed over where not ``strict``: servers send what they like.
    """
    out, last = {}, None
    for line in text.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if line[:1] in (b" ", b"\t") and last is not None:
            out[last] += " " + line.decode("utf-8" if strict else "latin-1").strip()
        elif colon and name.strip():
            key = name.decode("utf-8" if strict else "latin-1").strip().lower()
            last = None if key in out else key
            out.setdefault(key, value.decode("utf-8" if strict else "latin-1").strip())
        elif strict:
            raise ValueError(f"bad header line {line[:60]!r}")
    return out


def _page(urn: str | None) -> int | None:
    """The page of an id that this module wrote; ids of other archives name none."""
    found = re.fullmatch(r"<urn:page:(-?[0-9]{1,19})>", urn or "")
    return int(found[1]) if found else None


def _length(value: str) -> int:
    if not re.fullmatch("[0-9]+", value):
        raise ValueError(f"bad length {value[:60]!r}")
    return int(value)


def _read_digest(value: str) -> tuple[str, str]:
    """Algorithm and hexadecimal digest; archives write it in base 32 or in hexadecimal."""
    algorithm, _, text = value.partition(":")
    algorithm = algorithm.strip().lower().replace("-", "")
    if algorithm not in DIGESTS:
        raise ValueError(f"unknown digest {value[:60]!r}")
    size = hashlib.new(algorithm).digest_size
    text = text.strip()
    raw = bytes.fromhex(text) if len(text) == 2 * size else base64.b32decode(text.upper() + "=" * (-len(text) % 8))
    if len(raw) != size:
        raise ValueError(f"bad digest {value[:60]!r}")
    return algorithm, raw.hex()


def parse_record(record: bytes) -> dict:
    """The parts of a record of any type; a ValueError if a header, a length or a digest is wrong.

    A response or revisit of HTTP has the body as its payload, every other record its block. The HTTP head need not
    name a length; one that it names has to be right, unless ``WARC-Truncated`` says otherwise. A payload
    digest is optional and has to be right. A revisit has no payload; its length is the one its head names, its
    ``payload_digest`` the one its record names, null if that is no SHA-1.
    """
    head, found, rest = record.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not found or version not in VERSIONS:
        raise ValueError("no record of WARC/1.0 or WARC/1.1")
    headers = _headers(lines)
    if missing := [n for n in REQUIRED if n.lower() not in headers]:
        raise ValueError(f"headers missing: {missing}")
    length = _length(headers["content-length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError(f"the block does not have {length} bytes")
    kind, payload, size = headers["warc-type"].lower(), rest[:length], None
    of_http = headers.get("content-type", "").lower().replace(" ", "").startswith("application/http")
    if kind in ("response", "revisit") and of_http and payload:
        http, found, payload = payload.partition(b"\r\n\r\n")
        if not found:
            raise ValueError("no HTTP header")
        told = _headers(http.partition(b"\r\n")[2], strict=False).get("content-length")
        size = None if told is None else _length(told)
    declared = headers.get("warc-payload-digest")
    algorithm, digest = _read_digest(declared) if declared else (None, None)
    if kind == "revisit":
        if payload or "warc-profile" not in headers:
            raise ValueError("bad revisit record")
        sha1 = digest if algorithm == "sha1" else None
    else:
        if size not in (None, len(payload)) and "warc-truncated" not in headers:
            raise ValueError(f"the payload has {len(payload)} bytes instead of {size}")
        # Only for these does the digest speak of what is here taken for the payload.
        if algorithm and (kind == "resource" or of_http and kind == "response"):
            if hashlib.new(algorithm, payload).hexdigest() != digest:
                raise ValueError("the payload does not have the digest")
        sha1, size = hashlib.sha1(payload).hexdigest(), len(payload)
    return {
        "record_id": headers["warc-record-id"],
        "page_id": _page(headers["warc-record-id"]),
        "url": headers.get("warc-target-uri"),
        "record_type": kind,
        "payload_bytes": size,
        "payload_digest": sha1,
        "refers_to": _page(headers.get("warc-refers-to")),
        "payload": None if kind == "revisit" else payload,
    }


# --- archives ------------------------------------------------------------------


def train_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A trained dictionary, or one of plain content where there is too little to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records)
    except zstandard.ZstdError:
        content = b"".join(r[:4096] for r in records)[: DICTIONARY_BYTES] or b"WARC/1.1"
        return zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive_frames(records):
    """The frames of one archive: the dictionary, then one per record."""
    first, codec = [], None

    def start():
        dictionary = train_dictionary(first)
        data = dictionary.as_bytes()
        return struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data, zstandard.ZstdCompressor(
            level=6, dict_data=dictionary, write_content_size=True, write_checksum=True
        )

    for record in records:
        if codec is not None:
            yield codec.compress(record)
            continue
        first.append(record)
        if len(first) == DICTIONARY_RECORDS or sum(map(len, first)) > 8 << 20:
            frame, codec = start()
            yield frame
            yield from map(codec.compress, first)
            first = []
    if first:
        frame, codec = start()
        yield frame
        yield from map(codec.compress, first)


def read_frames(archive: bytes):
    """(offset, record) of each frame behind the dictionary, if there is one; a ValueError if a frame is wrong."""
    if not archive:
        return
    view = memoryview(archive)
    if len(view) < 8:
        raise ValueError("the archive is cut off")
    at, codec = 0, zstandard.ZstdDecompressor()
    if struct.unpack_from("<I", view)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", view, 4)[0]
        if 8 + size > len(view):
            raise ValueError("the dictionary is cut off")
        data = bytes(view[8 : 8 + size])
        if data[:4] == zstandard.FRAME_HEADER:
            data = zstandard.ZstdDecompressor().decompress(data)
        trained = data[:4] == b"\x37\xa4\x30\xec"
        kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
        codec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data, dict_type=kind))
        at = 8 + size
    while at < len(view):
        if len(view) - at < 8:
            raise ValueError(f"{len(view) - at} bytes behind the last frame")
        magic, skip = struct.unpack_from("<II", view, at)
        if magic in SKIPPABLE:
            at += 8 + skip
            if at > len(view):
                raise ValueError("a skippable frame is cut off")
            continue
        size = zstandard.frame_content_size(bytes(view[at : at + 18]))
        frame, parts, end = codec.decompressobj(), [], at
        try:
            while not frame.eof and end < len(view):
                piece = view[end : end + _FEED]
                parts.append(frame.decompress(piece))
                end += len(piece)
        except zstandard.ZstdError as error:
            raise ValueError(f"bad frame at {at}: {error}") from None
        if not frame.eof:
            raise ValueError(f"the frame at {at} is cut off")
        record = b"".join(parts)
        if size >= 0 and size != len(record):
            raise ValueError(f"the frame at {at} has {len(record)} bytes instead of {size}")
        yield at, record
        at = end - len(frame.unused_data)


# --- Spark ---------------------------------------------------------------------


def _write(batches):
    def records():
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha1", "refers_to")]
            for row in zip(*columns):
                yield record_bytes(*row)

    held, size = [], 0
    for frame in archive_frames(records()):
        held.append(frame)
        size += len(frame)
        if size > 4 << 20 or len(held) >= _EMIT:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["frame"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["frame"])


_RECORD = (
    "path string, offset long, record_id string, page_id long, url string, record_type string, payload_bytes long, "
    "payload_digest string, refers_to long, payload binary, error string"
)


def _read(with_payload: bool):
    kinds = {
        "path": pa.string(), "offset": pa.int64(), "record_id": pa.string(), "page_id": pa.int64(), "url": pa.string(),
        "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
        "refers_to": pa.int64(), "payload": pa.binary(), "error": pa.string(),
    }

    def rows(path: str, archive: bytes):
        frames = read_frames(archive)
        while True:
            try:
                found = next(frames, None)
            except ValueError as error:
                yield {"path": path, "error": str(error)}
                return
            if found is None:
                return
            try:
                row = parse_record(found[1])
            except (ValueError, KeyError) as error:
                row = {"error": str(error)}
            yield row | {"path": path, "offset": found[0]}

    def batch_of(held: list[dict]) -> pa.RecordBatch:
        arrays = [pa.array([r.get(n) for r in held], t) for n, t in kinds.items()]
        return pa.RecordBatch.from_arrays(arrays, names=list(kinds))

    def run(batches):
        for batch in batches:
            held, size = [], 0
            for path, content in zip(batch.column("path"), batch.column("content")):
                for row in rows(path.as_py(), content.as_py()):
                    if not with_payload:
                        row.pop("payload", None)
                    held.append(row)
                    size += len(row.get("payload") or b"")
                    if len(held) >= _EMIT or size > 8 << 20:
                        yield batch_of(held)
                        held, size = [], 0
            if held:
                yield batch_of(held)

    return run


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``page_id, url, payload, sha1, refers_to`` of ``pages(page_id, url, html)``.

    Of pages with equal payloads of at least ``min_bytes`` bytes, those with the largest id
    have null in ``refers_to``, the others that id. Null html is an empty payload. A page
    with a null id refers to the others, or is a response if all ids are null. Repeated
    rows with the largest id are all responses.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")
    ).withColumn("sha1", F.sha1("payload"))
    size = F.octet_length("payload")
    large = rows.where(size >= min_bytes).select("page_id", "sha1")
    leader = large.groupBy("sha1").agg(F.max("page_id").alias("leader"), F.count(F.lit(1)).alias("held"))
    leader = leader.where("held > 1").select("sha1", "leader")
    joined = rows.join(leader, "sha1", "left")
    again = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("leader")), F.col("leader"))
    return joined.select("page_id", "url", "payload", "sha1", again.alias("refers_to"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Write ``pages(page_id, url, html)`` as a folder of archives, one per partition."""
    ship(pages.sparkSession)
    frames = with_revisits(pages, min_bytes).mapInArrow(_write, "frame binary")
    raw = frames.select(F.col("frame").cast("string").alias("value"))
    raw.write.option("lineSep", EMPTY_FRAME.decode("ascii")).option("compression", "none").text(path)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record: ``path, offset, record_id, page_id, url, record_type, payload_bytes,
    payload_digest, refers_to, payload, error``.

    ``payload_bytes`` and ``payload_digest`` (hexadecimal SHA-1) are those of the full payload,
    also for a revisit, whose ``payload`` is null. A record whose headers, lengths or
    digest are wrong has only its place and ``error``; a broken frame ends its archive
    with such a row. A folder without records gives an empty result.
    """
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_read(with_payload), _RECORD)
