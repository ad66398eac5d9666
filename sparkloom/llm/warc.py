"""WARC archives compressed with Zstandard, a dictionary in front and a frame a record.

An archive is bytes: a leading skippable frame that holds the dictionary, then
one frame for each record. Tasks write the archives as ``*.warc.zst`` files into a
shared folder and return their paths; other tasks read them from there. The reader
also takes rows (path, length, content) as Spark's ``binaryFile`` source gives them,
so archives of others may lie in any store that Spark reads.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, new_folder

#: Fixed values of the formats: the skippable frame that may hold a dictionary, a frame's and a dictionary's magic.
SKIPPABLE, FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
#: So many shared digests are broadcast; more are met by a shuffle.
FEW = 200_000
VERSION = b"WARC/1.1"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVES = "path string, length long, content binary"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, path string, position long"


def plan(pages: DataFrame, least: int = 100) -> DataFrame:
    """Add payload_bytes, payload_digest, record_type and refers_to to (page_id, url, html).

    Of equal payloads of ``least`` bytes or more the smallest page_id is the
    response (all its rows, if that row repeats; all rows of a group whose ids
    are all null) and the others revisit it. A null html is an empty payload.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    large = p.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("payload_digest").alias("shared"), "first")
    # A small payload has no equal: its key is its own, so that no key is hot for nothing.
    key = F.when(F.col("payload_bytes") >= least, F.col("payload_digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("page_id"), F.xxhash64("url")).cast("string")))
    # A digest that many pages share meets its first page by a broadcast of that one row; payloads stay where they are.
    digests = p.withColumn("shared", key)
    j = digests.join(F.broadcast(large) if large.limit(FEW + 1).count() <= FEW else large, "shared", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return j.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def _uri(url: str | None) -> bytes:
    """A header-safe form: bytes outside printable ASCII are percent-encoded."""
    return b"".join(bytes([c]) if 0x20 < c < 0x7F else b"%%%02X" % c for c in (url or "about:blank").encode("utf-8", "replace"))


def _record(page_id, url, payload: bytes, size: int, digest: str, kind: str, refers_to) -> bytes:
    name = "null" if page_id is None else str(page_id)
    block = HTTP_HEAD + (payload if kind == "response" else b"")
    head = [b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <urn:x-page:%s>" % name.encode(), b"WARC-Date: 1970-01-01T00:00:00Z", b"WARC-Target-URI: " + _uri(url), b"WARC-Payload-Digest: sha256:" + digest.encode(), b"X-Payload-Length: %d" % size, b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    if url is None:
        head.append(b"X-Target-Null: 1")
    if kind == "revisit":
        head += [b"WARC-Profile: " + SAME_PAYLOAD.encode(), b"WARC-Refers-To: <urn:x-page:%d>" % refers_to]
    return VERSION + b"\r\n" + b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write(archive_bytes: int, dictionary_bytes: int, samples: int, level: int):
    def archive(records: list[bytes]) -> bytes:
        import zstandard as z

        # A dictionary is trained on some of the archive's own records; a few short ones give raw content instead.
        some = records[:: max(1, len(records) // samples)][:samples]
        some = [r[:65_536] for r in some]
        try:
            known = z.train_dictionary(dictionary_bytes, some) if len(some) >= 16 else None
        except z.ZstdError:
            known = None
        known = known or z.ZstdCompressionDict(b"".join(some)[-dictionary_bytes:].ljust(8, b" "), dict_type=z.DICT_TYPE_RAWCONTENT)
        packer = z.ZstdCompressor(level=level, dict_data=known, write_checksum=True, write_content_size=True)
        body = z.ZstdCompressor(level=level).compress(known.as_bytes())
        return b"".join([struct.pack("<II", SKIPPABLE, len(body)), body, *map(packer.compress, records)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[bytes] = []
        size = 0

        def out() -> pd.DataFrame:
            data = archive(held)
            return pd.DataFrame({"path": [hashlib.sha256(data).hexdigest()[:24] + ".warc.zst"], "length": [len(data)], "content": [data]})

        for b in batches:
            for row in zip(b["page_id"], b["url"], b["payload"], b["payload_bytes"], b["payload_digest"], b["record_type"], b["refers_to"], strict=True):
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (row[0], row[6]))
                r = _record(page_id, row[1], bytes(row[2]), int(row[3]), row[4], row[5], refers_to)
                held.append(r)
                size += len(r)
                if size >= archive_bytes:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return run


def write(planned: DataFrame, archive_bytes: int = 16 << 20, dictionary_bytes: int = 32 << 10, samples: int = 200, level: int = 3) -> DataFrame:
    """Archives (path, length, content) of about ``archive_bytes`` of records each."""
    return planned.mapInPandas(_write(archive_bytes, dictionary_bytes, samples, level), ARCHIVES)


class BadArchive(ValueError):
    """An archive that breaks the format."""


def _frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(position, record) of each frame; the first frame may be a dictionary to skip."""
    import zstandard as z

    known, at = None, 0
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", data, 4)[0]
        body = data[8 : 8 + size]
        if len(body) != size:
            raise BadArchive("the dictionary is cut off")
        if body[:4] == struct.pack("<I", FRAME):
            body = z.ZstdDecompressor().decompress(body, max_output_size=1 << 27)
        known = z.ZstdCompressionDict(body, dict_type=z.DICT_TYPE_FULLDICT if body[:4] == struct.pack("<I", DICTIONARY) else z.DICT_TYPE_RAWCONTENT)
        at = 8 + size
    opener = z.ZstdDecompressor(dict_data=known) if known else z.ZstdDecompressor()
    while at < len(data):
        if struct.unpack_from("<I", data.ljust(at + 4, b"\0"), at)[0] != FRAME:
            raise BadArchive(f"no frame at byte {at}")
        one = opener.decompressobj()
        try:
            record = b"".join([one.decompress(data[i : i + (1 << 18)]) for i in _until_over(one, data, at)])
        except z.ZstdError as e:
            raise BadArchive(f"frame at byte {at}: {e}") from e
        if not one.eof:
            raise BadArchive(f"the frame at byte {at} is cut off")
        yield at, record
        at = min(len(data), _until_over.last + (1 << 18)) - len(one.unused_data)


def _until_over(one, data: bytes, at: int) -> Iterator[int]:
    for i in range(at, len(data), 1 << 18):
        if one.eof:
            return
        _until_over.last = i
        yield i


def _parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, mark, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or not lines[0].startswith(b"WARC/1."):
        raise BadArchive("no WARC header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise BadArchive(f"bad header line {line[:60]!r}")
        fields[name.strip().decode("latin-1").lower()] = value.strip().decode("latin-1")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise BadArchive(f"no {name}")
    if not fields["content-length"].isdigit():
        raise BadArchive("bad content-length")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise BadArchive(f"content-length {size}, but {len(rest) - 4} bytes")
    return fields, rest[:size]


def _read(keep_payload: bool):
    from urllib.parse import unquote

    def number(name: str | None) -> int | None:
        tail = (name or "").strip("<>").rpartition(":")[2]
        return int(tail) if tail.lstrip("-").isdigit() else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, length, content in zip(b["path"], b["length"], b["content"], strict=True):
                data = bytes(content)
                if len(data) != length:
                    raise BadArchive(f"{path}: {len(data)} of {length} bytes")
                rows: list[tuple] = []
                for at, record in _frames(data):
                    f, block = _parse(record)
                    if f["warc-type"] not in ("response", "revisit"):
                        continue
                    payload = block.partition(b"\r\n\r\n")[2]
                    digest = f.get("warc-payload-digest", "").rpartition(":")[2].lower()
                    size = int(f.get("x-payload-length", len(payload)))
                    if f["warc-type"] == "response":
                        if hashlib.sha256(payload).hexdigest() != digest or len(payload) != size:
                            raise BadArchive(f"{path}, byte {at}: the payload is not that of the header")
                    elif "warc-refers-to" not in f:
                        raise BadArchive(f"{path}, byte {at}: a revisit without a target")
                    url = None if f.get("x-target-null") else unquote(f.get("warc-target-uri", ""))
                    rows.append((number(f["warc-record-id"]), url, size, digest, f["warc-type"], number(f.get("warc-refers-to")), payload if keep_payload and f["warc-type"] == "response" else None, path, at))
                    if len(rows) == 512:
                        yield _frame(rows)
                        rows = []
                if rows:
                    yield _frame(rows)

    return run


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [x.split()[0] for x in RECORDS.split(", ")]
    out = pd.DataFrame(rows, columns=names, dtype=object)
    return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64", "position": "int64"})


def read(archives: DataFrame, keep_payload: bool = False) -> DataFrame:
    """One row a record of archives (path, length, content); a broken archive fails with its path and byte.

    A revisit's payload is null: it is that of the record it refers to.
    """
    return archives.select("path", "length", "content").mapInPandas(_read(keep_payload), RECORDS)


def _store(folder: str):
    """The file system of a folder, as tasks see it, and the folder's path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write_files(planned: DataFrame, folder: str, archive_bytes: int = 16 << 20, dictionary_bytes: int = 32 << 10, samples: int = 200, level: int = 3) -> DataFrame:
    """Write the archives of planned pages as files into ``folder``; gives their (path, length).

    A file's name is a hash of its content, so a task that runs again writes the
    same file or another one that nobody is told of.
    """
    make = _write(archive_bytes, dictionary_bytes, samples, level)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _store(folder)
        for b in make(batches):
            for path, content in zip(b["path"], b["content"], strict=True):
                store.create_dir(base, recursive=True)
                part = f"{base}/_{path}.{uuid.uuid4().hex}"
                with store.open_output_stream(part, compression=None) as out:
                    out.write(bytes(content))
                store.move(part, f"{base}/{path}")
            yield b[["path", "length"]]

    return planned.mapInPandas(run, "path string, length long")


def read_files(files: DataFrame, folder: str, keep_payload: bool = False) -> DataFrame:
    """What ``read`` gives, from files (path, length) in ``folder``."""
    parse = _read(keep_payload)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _store(folder)

        def opened() -> Iterator[pd.DataFrame]:
            for b in batches:
                for path, length in zip(b["path"], b["length"], strict=True):
                    with store.open_input_stream(f"{base}/{path}", compression=None) as f:
                        yield pd.DataFrame({"path": [path], "length": [length], "content": [f.read()]})

        yield from parse(opened())

    return files.mapInPandas(run, RECORDS)


def round_trip(pages: DataFrame, least: int = 100) -> DataFrame:
    """Write every page into archive files in the shared folder and read them back.

    Null html is an empty payload; null ids and repeated rows stay; an empty
    table gives no rows and no file; columns other than page_id, url and html are not read.
    """
    folder = f"{new_folder(pages.sparkSession)}/warc"
    files = cut(write_files(plan(pages, least), folder))
    return read_files(files, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
