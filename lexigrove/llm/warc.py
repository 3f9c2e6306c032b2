"""WARC archives of web pages, and a reader that splits them by byte ranges.

Every record is a gzip member of its own. A reading task gets a range of a file: it looks for the magic bytes of gzip, takes
a place for a member if it decodes to a WARC header, and owns the records that begin inside its range, wherever they end. What
comes before the first of them belongs to the range before. Compressed bytes can hold the magic by chance, but to decode to
``WARC/1.`` as well they would have to be a member; text in UTF-8 cannot hold one that is stored as it stands.

Of equal payloads one page has a response record, the others a revisit that names it and carries the headers only. Groups are
found by digest and length, and the leader is joined to the pages: the largest groups, a fixed number, by a broadcast, so that
none of them is the key of a shuffle; the rest by the digest.
"""

from __future__ import annotations

import base64
import hashlib
import string
import urllib.parse
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import store
from . import tokens

#: Payloads of fewer bytes are always stored, whoever else has them.
LEAST = 0
#: Groups of equal payloads that are joined by a broadcast.
HOT = 256
#: Compressed bytes after which a file is closed.
FILE_BYTES = 256 << 20
#: Bytes of a reading task's range.
SPLIT = 8 << 20
#: Bytes that are read at once beyond a range.
CHUNK = 1 << 18
#: Pages of a batch.
BATCH = 256
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"

# The magic bytes of a gzip member with the deflate method, and names of the WARC format.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "name string, n_records long, n_bytes long"
ROWS = "name string, offset long, record_type string, page_id long, target_uri string, refers_to long, payload_digest string, payload_bytes long"
_ID = "urn:x-page:"
_PRINTED = string.ascii_letters + string.digits + string.punctuation


def decided(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, html, sha1, revisit, leader): which pages of equal payload revisit which other."""
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    source = source.withColumn("sha1", F.sha1("html")).withColumn("size", F.octet_length("html"))
    copies = source.where(F.col("size") >= least).groupBy("sha1", "size").agg(F.max("page_id").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = store.materialise(copies, "warc-copies")
    largest = copies.orderBy(F.desc("n"), "sha1", "size").limit(HOT).select("sha1", "size", F.struct("leader").alias("hot"))
    largest = store.materialise(largest, "warc-largest")
    rest = copies.join(F.broadcast(largest.select("sha1", "size")), ["sha1", "size"], "left_anti").select(F.col("sha1").alias("key"), "size", F.struct("leader").alias("cold"))
    met = source.join(F.broadcast(largest), ["sha1", "size"], "left")
    # A page of a large group has its leader already: a key that no group has spreads it.
    key = F.when(F.col("hot").isNull(), F.col("sha1")).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string")))
    joined = met.withColumn("key", key).join(rest, ["key", "size"], "left")
    group = F.coalesce("hot", "cold")
    return joined.select("page_id", "url", "html", "sha1", (group.isNotNull() & ~F.col("page_id").eqNullSafe(group["leader"])).alias("revisit"), group["leader"].alias("leader"))


def _uri(page_id: int | None) -> str:
    return f"{_ID}{'null' if page_id is None else page_id}"


def _page_id(uri: str) -> int | None:
    own = uri.strip("<>").removeprefix(_ID)
    return None if own == "null" else int(own)


def member(kind: str, headers: dict[str, str], block: bytes, level: int = LEVEL) -> bytes:
    """One record as a gzip member."""
    lines = {"WARC-Type": kind, **headers, "Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()) + "\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return b"".join((packer.compress(head.encode()), packer.compress(block), packer.compress(b"\r\n\r\n"), packer.flush()))


def page_record(page_id: int | None, url: str | None, payload: bytes, sha1: str, revisit: bool, leader: int | None) -> bytes:
    """The record of a page: the whole payload behind HTTP headers, or for a revisit the headers alone."""
    target = urllib.parse.quote(url, safe=_PRINTED) if url else _uri(page_id)
    headers = {"WARC-Record-ID": f"<{_uri(page_id)}>", "WARC-Date": DATE, "WARC-Target-URI": target, "WARC-Payload-Digest": f"sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}"}
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if revisit:
        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{_uri(leader)}>"}
    headers["Content-Type"] = "application/http; msgtype=response"
    return member("revisit" if revisit else "response", headers, http if revisit else http + payload)


def write(pages: DataFrame, folder: str, least: int = LEAST, most: int = FILE_BYTES) -> DataFrame:
    """Write a record a page and return the manifest: (name, n_records, n_bytes) by file.

    Files have names of their own in every attempt of a task, and the manifest has those of the attempts that counted.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).cast(pa.binary()).to_pylist() if c == "html" else b.column(c).to_pylist() for c in ("page_id", "url", "html", "sha1", "revisit", "leader")), strict=True))
        row = next(rows, None)
        while row is not None:
            name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
            with tokens.writing(folder, name) as f:
                info = b"format: WARC File Format 1.1\r\n"
                size += f.write(member("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": DATE, "WARC-Filename": name, "Content-Type": "application/warc-fields"}, info))
                while row is not None and size < most:
                    size += f.write(page_record(*row))
                    n, row = n + 1, next(rows, None)
            yield pa.RecordBatch.from_pylist([{"name": name, "n_records": n, "n_bytes": size}], schema=_MANIFEST)

    return store.materialise(decided(pages, least).mapInArrow(pack, MANIFEST), "warc-manifest", records=BATCH)


_MANIFEST = pa.schema([("name", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])
_ROWS = pa.schema([("name", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("target_uri", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64())])


def members(read: Callable[[int, int], bytes], size: int, start: int, stop: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of the records that begin in [start, stop) of a file of ``size`` bytes.

    ``read(offset, length)`` reads the file. A record that begins as one and does not decode to its stated length is an error.
    """
    data = read(start, min(stop + len(MAGIC) - 1, size) - start)  # a magic that begins inside can end outside
    at = data.find(MAGIC)
    while 0 <= at < stop - start:
        unpacker, fed, out, wrong = zlib.decompressobj(31), at, bytearray(), ""
        try:
            while not unpacker.eof and (len(out) < len(VERSION) or out.startswith(VERSION)):
                more = data[fed : fed + CHUNK] if fed < len(data) else read(start + fed, min(CHUNK, size - start - fed))
                if not more:
                    raise zlib.error("the file ends inside the record")
                fed += len(more)
                out += unpacker.decompress(more)
        except zlib.error as e:
            wrong = str(e)
        if not out.startswith(VERSION):
            at = data.find(MAGIC, at + 1)
            continue
        head, _, rest = bytes(out).partition(b"\r\n\r\n")
        headers = _headers(head)
        if wrong or not rest.endswith(b"\r\n\r\n") or str(len(rest) - 4) != headers.get("content-length"):
            raise ValueError(f"damaged record at byte {start + at}: {wrong or 'it is not as long as its header says'}")
        yield start + at, headers, rest[:-4]
        at = data.find(MAGIC, fed - len(unpacker.unused_data))


def _headers(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; the first line is not one."""
    found = {}
    for line in head.decode().split("\r\n")[1:]:
        name, _, value = line.partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def page_of(headers: dict[str, str], block: bytes) -> tuple[dict, bytes] | None:
    """A record's row and payload; None for records that hold no page. A payload that is not what its digest says is an error."""
    kind = headers["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    stated, length = headers["warc-payload-digest"].removeprefix("sha1:"), int(_headers(http)["content-length"])
    if kind == "response" and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != stated):
        raise ValueError(f"the payload of {headers['warc-record-id']} is not what its digest says")
    refers = headers.get("warc-refers-to")
    row = {"record_type": kind, "page_id": _page_id(headers["warc-record-id"]), "target_uri": headers["warc-target-uri"], "refers_to": _page_id(refers) if refers else None}
    return row | {"payload_digest": stated, "payload_bytes": length}, payload


def read(manifest: DataFrame, folder: str, split: int = SPLIT, payload: bool = False) -> DataFrame:
    """The pages' records of the files in a manifest, by byte ranges of ``split``.

    (name, offset, record_type, page_id, target_uri, refers_to, payload_digest, payload_bytes), and with ``payload`` the
    bytes themselves (none for a revisit).
    """
    schema = _ROWS.append(pa.field("payload", pa.binary())) if payload else _ROWS

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size, start in zip(*(batch.column(c).to_pylist() for c in ("name", "n_bytes", "start")), strict=True):
                system, base = tokens.open_folder(folder)
                rows, held = [], 0
                with system.open_input_file(f"{base}/{name}") as f:
                    for offset, headers, block in members(lambda at, n, f=f: f.read_at(n, at), size, start, min(size, start + split)):
                        if found := page_of(headers, block):
                            rows.append({"name": name, "offset": offset, **found[0]} | ({"payload": found[1]} if payload else {}))
                            held += len(found[1]) if payload else 0
                        if len(rows) >= 4096 or held > CHUNK * 64:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    ranges = manifest.select("name", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bytes") - 1, F.lit(split).cast("long"))).alias("start"))
    tasks = manifest.agg(F.sum(F.ceil(F.col("n_bytes") / split))).first()[0]
    return ranges.repartition(max(1, tasks or 0)).mapInArrow(scan, ROWS + ", payload binary" if payload else ROWS)


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write the archives to a new folder of the shared directory and read the pages back from them.

    ``pages``: page_id, url, html; more columns are ignored. Returns (page_id, payload_bytes, payload_digest, record_type,
    refers_to). A null html is an empty payload; empty payloads are equal ones like others. Null ids count as smaller than all and
    come back as null. Rows that repeat the page_id and the payload of the leader are that page again: responses, not revisits of
    themselves. A null url is replaced by the page's own urn. Payloads of any length are stored whole. An empty table gives an empty
    result. The archives go once they have been read.
    """
    with store.scratch(pages.sparkSession):
        folder = store.new_path(pages.sparkSession, "warc-files")
        found = read(write(pages, folder, least), folder)
        return store.kept(found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "warc-rows")
