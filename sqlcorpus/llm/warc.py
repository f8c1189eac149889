"""WARC archives with an embedded Zstandard dictionary, written and read by Spark tasks.

An archive starts with a skippable frame that holds a dictionary built from the archive's own records;
then every record is one Zstandard frame compressed with it, so that a record can be read alone. Of
records with equal payloads (SHA-1 and length) the one with the smallest id is a response with the
payload; the others are revisits that carry the payload's headers and refer to it.

Tasks write below the shared folder, each attempt to files of its own name, and return what they wrote;
only files of successful attempts are in the manifest, so retried and speculative tasks do no harm.
Records reach their task by a hash of the id, so neither a hot host nor a group of copies gathers.

Defined cases: a null payload is an empty one; empty payloads are equal to each other; rows that repeat
an id and its payload are all of the kind of the first; a null id is written as none and read back as
null (it is never referred to unless all copies have null ids); a null url is written without a target;
control characters and non-ASCII in urls are percent-encoded in the header; an empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlcorpus.llm.common import attach
from sqlcorpus.session import scratch_path, stage

#: Raw bytes after which an archive is closed, bytes of its dictionary, and bytes of records that it is built from.
ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 4 << 20
#: Archives that one task reads back.
ARCHIVES_A_TASK = 4
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
#: FIXED VALUES: magic number of the skippable frame that holds a dictionary, and the profile of revisits.
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_WRITTEN = "path string, records bigint, bytes bigint"
_READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string"


def record(page_id, url: str | None, payload: bytes, size: int, digest: str, refers_to=None, revisit: bool = False, date: str = DATE) -> bytes:
    """One WARC/1.1 record; ``size`` and ``digest`` are those of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(3, "WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    if revisit:
        head.append(f"WARC-Profile: {PROFILE}")
        if refers_to is not None:
            head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple:
    """(page id, payload bytes, digest, kind, refers to, url) of a record; a response's payload is digested again."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")

    def number(value):
        text = value.removeprefix("<urn:page:").rstrip(">") if value else "none"
        return None if text == "none" else int(text)

    return number(fields["warc-record-id"]), size, digest, fields["warc-type"], number(fields.get("warc-refers-to")), fields.get("warc-target-uri")


def digest_of(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def archive(records: list[bytes]) -> bytes:
    """The bytes of an archive: dictionary frame, then one frame per record.

    The dictionary is built from records spread evenly over the archive, up to SAMPLE_BYTES; an archive
    of too few records to train on gets the head of its longest record instead.
    """
    import zstandard

    step = max(1, -(-sum(map(len, records)) // SAMPLE_BYTES))
    samples = [r[:SAMPLE_BYTES] for r in records[::step]]
    try:
        dictionary = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, sum(map(len, samples)) // 8)), samples, k=256, d=8)
    except zstandard.ZstdError:
        dictionary = zstandard.ZstdCompressionDict(max(records, key=len)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    content = dictionary.as_bytes()
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=True)
    frames = [SKIPPABLE.to_bytes(4, "little"), len(content).to_bytes(4, "little"), content]
    return b"".join(frames + [compressor.compress(r) for r in records])


def read_records(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Records of an archive, read in chunks from a file-like ``stream``."""
    import zstandard

    magic, size = stream.read(4), int.from_bytes(stream.read(4), "little")
    if int.from_bytes(magic, "little") != SKIPPABLE:
        raise ValueError("an archive starts with its dictionary")
    content = stream.read(size)
    trained = content[:4] == b"\x37\xa4\x30\xec"
    dictionary = zstandard.ZstdCompressionDict(
        content, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    data = stream.read(chunk)
    while data:
        frame, parts = decompressor.decompressobj(), []
        while True:
            parts.append(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data or stream.read(chunk)
                break
            data = stream.read(chunk)
            if not data:
                raise ValueError("an archive ends within a record")
        yield b"".join(parts)


def _file_system(folder: str):
    """(file system, path) of a Hadoop-style uri, as pyarrow names it."""
    from pyarrow import fs

    if "://" not in folder:
        return fs.LocalFileSystem(), folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder)


def _writer(folder: str, limit: int):
    def write(batches) -> Iterator:
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        system, root = _file_system(folder)
        system.create_dir(root, recursive=True)
        uri = folder[: len(folder) - len(root)] if folder.endswith(root) else ""
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        pending, size, made = [], 0, 0

        def close():
            nonlocal pending, size, made
            data, path = archive(pending), f"{root}/{name}-{made:05d}.warc.zst"
            with system.open_output_stream(path) as out:
                out.write(data)
            row = pa.RecordBatch.from_pydict({"path": [uri + path], "records": [len(pending)], "bytes": [len(data)]}, schema=pa.schema(
                [("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))
            pending, size, made = [], 0, made + 1
            return row

        for batch in batches:
            for page, url, html, length, sha, refers, revisit in zip(*batch.columns, strict=True):
                raw = record(page.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8", "replace"), length.as_py(),
                             base64.b32encode(sha.as_py()).decode(), refers.as_py(), revisit.as_py())
                pending.append(raw)
                size += len(raw)
                if size >= limit:
                    yield close()
        if pending:
            yield close()

    return write


def kinds(pages: DataFrame) -> DataFrame:
    """``(page_id, sha, size, refers_to, revisit)``, one row per distinct id and payload.

    ``pages(page_id, sha, size)`` is staged; payload groups are aggregated before they are shuffled, and
    the largest meet their rows by a broadcast of fixed size.
    """
    same = pages.groupBy("page_id", "sha", "size").count()
    first = same.groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.sum("count").alias("_n"))
    out = attach(same.drop("count"), first, ["sha", "size"], "_n")
    revisit = F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull())
    return out.select("page_id", "sha", "size", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html", limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Write archives of ``pages`` below ``folder``; the manifest ``(path, records, bytes)`` is staged and returned."""
    html = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    body = F.encode(html, "UTF-8")
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), html.alias("html"),
        F.unhex(F.sha1(body)).alias("sha"), F.octet_length(body).cast("long").alias("size"))
    found = kinds(stage(rows.select("page_id", "sha", "size"), "payloads")).select(
        F.col("page_id").alias("_id"), F.col("sha").alias("_sha"), "refers_to", "revisit")
    typed = rows.join(found, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")))
    # a revisit's payload stays behind
    records = typed.select("page_id", "url", F.when(~F.col("revisit"), F.col("html")).alias("html"), "size", "sha", "refers_to", "revisit")
    return stage(records.mapInArrow(_writer(folder, limit), _WRITTEN), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """Records of the archives in the manifest: ``page_id, payload_bytes, payload_digest, record_type, refers_to, url``."""

    def records(batches) -> Iterator:
        import pyarrow as pa

        kind = pa.schema([
            ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
            ("refers_to", pa.int64()), ("url", pa.string())])
        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, at = _file_system(path)
                with system.open_input_stream(at) as stream:
                    rows = [parse(r) for r in read_records(stream)]
                if len(rows) != expected:
                    raise ValueError(f"{path} has {len(rows)} records, {expected} were written")
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind, strict=True)], schema=kind)

    # a stated number of tasks: manifest rows are tiny, so adaptive execution would read all archives in one
    archives = manifest.count()
    return manifest.select("path", "records").repartition(max(1, -(-archives // ARCHIVES_A_TASK))).mapInArrow(records, _READ)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write the archives to a fresh shared folder and read them back."""
    return read(write(pages, scratch_path(pages.sparkSession, "warc"), **options))
