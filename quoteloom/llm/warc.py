"""WARC archives with a Zstandard dictionary of their own.

``write`` turns pages into WARC 1.1 records and writes them as ``.warc.zst`` files: a skippable frame that
holds a Zstandard dictionary, then one frame for each record, so that any record can be read alone with
the dictionary. The dictionary is trained from the archive's own first ``SAMPLE`` bytes of records; where
these are too few to train, they serve as a plain-content dictionary. A record is compressed as it comes:
a task holds the sample, then one record.

Pages with an equal payload of at least ``LEAST`` bytes are stored once: the one of the smallest page_id
(null last; then the smallest url, then one of equal rows) is the response, the others are revisit
records, with their headers and a reference. Payloads meet by SHA-256; only digests that occur more than
once are joined to the pages, so the pages themselves are dealt out again only where many repeat.

A task names its files by its attempt and returns them; the returned manifest, a written table, is what
counts. Files of a lost attempt are in no manifest. ``read`` streams the archives of a manifest.

Edge cases: a null html is an empty payload; a null page_id or url is left out of the record and null
when read. Repeated rows are records of their own. Control characters, blanks and per cent signs of a url are escaped.
An empty table writes no archive. Other columns are not read. The pages must give the same rows each time
they are read, as files do.
"""

from __future__ import annotations

import hashlib
import urllib.parse
import uuid
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteloom.llm.common import shared_dir, written

LEAST = 100
SAMPLE = 1 << 22
DICTIONARY = 1 << 16
ARCHIVE = 1 << 30
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of capture
CHUNK = 1 << 20

#: Fixed values of the format: a skippable frame, the Zstandard dictionary, the profile of a revisit.
SKIPPABLE = b"\x5d\x2a\x4d\x18"
TRAINED = b"\x37\xa4\x30\xec"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "path string, records long, bytes long, dictionary_bytes long"
RECORDS = "page_id long, url string, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to long, refers_to_record string, payload binary"


def _record_id(page_id: int | None, url: str | None, row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {row} {url}')}>"


def _head(first: str, fields: list[tuple[str, object]]) -> bytes:
    return "".join(f"{line}\r\n" for line in [first, *(f"{k}: {v}" for k, v in fields if v is not None), ""]).encode()


def _escaped(url: str | None) -> str | None:
    return None if url is None else urllib.parse.quote(url, safe="!\"#$&'()*+,-./:;<=>?@[\\]^_`{|}~")


def record(page: dict, date: str = DATE) -> bytes:
    """A page as a WARC record. ``page``: page_id, url, row, html, digest and, for a revisit, first
    (page_id, url and row of the response)."""
    html = (page["html"] or "").encode("utf-8", "surrogatepass")
    first = page["first"]
    http = _head("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(html))])
    block = http if first else http + html
    fields = [
        ("WARC-Type", "revisit" if first else "response"),
        ("WARC-Record-ID", _record_id(page["page_id"], page["url"], page["row"])),
        ("WARC-Target-URI", _escaped(page["url"])),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha256:{page['digest']}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
        ("Page-ID", page["page_id"]),
    ]
    if first:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(first["page_id"], first["url"], first["row"]))]
        fields += [("WARC-Refers-To-Target-URI", _escaped(first["url"])), ("WARC-Refers-To-Date", date), ("Refers-To-Page-ID", first["page_id"])]
    return _head("WARC/1.1", fields) + block + b"\r\n\r\n"


def dictionary(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary trained from ``samples``, or the end of their content where they are too few."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _loaded(raw: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(raw, zstandard.DICT_TYPE_FULLDICT if raw.startswith(TRAINED) else zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: Iterator[bytes], sink, sample: int = SAMPLE, most: int = ARCHIVE) -> dict:
    """Writes ``records`` to ``sink`` until ``most`` bytes or their end; its line of the manifest."""
    held, size = [], 0
    for one in records:
        held.append(one)
        size += len(one)
        if size >= sample:
            break
    raw = dictionary(held)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_loaded(raw))
    sink.write(SKIPPABLE + len(raw).to_bytes(4, "little") + raw)
    done = {"records": 0, "bytes": 8 + len(raw), "dictionary_bytes": len(raw)}

    def put(one: bytes) -> None:
        frame = packer.compress(one)
        sink.write(frame)
        done["records"] += 1
        done["bytes"] += len(frame)

    for one in held:
        put(one)
    held.clear()
    while done["bytes"] < most and (one := next(records, None)) is not None:
        put(one)
    return done


def frames(source) -> Iterator[bytes]:
    """The records of an archive, one after the other, from a stream of its bytes."""
    data = source.read(8)
    raw = source.read(int.from_bytes(data[4:], "little")) if data.startswith(SKIPPABLE) else None
    rest = b"" if raw is not None else data
    unpacker = zstandard.ZstdDecompressor(dict_data=_loaded(raw)) if raw else zstandard.ZstdDecompressor()
    one, parts = unpacker.decompressobj(), []
    while True:
        rest = rest or source.read(CHUNK)
        if not rest:
            break
        parts.append(one.decompress(rest))
        rest = b""
        if one.eof:
            rest = one.unused_data
            yield b"".join(parts)
            one, parts = unpacker.decompressobj(), []
    if any(parts):
        raise ValueError("an archive ends within a record")


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}


def parsed(one: bytes) -> dict:
    """A record's columns (see RECORDS); a response whose payload is not what its digest says fails."""
    head, _, rest = one.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    if not head.startswith(b"WARC/1.1\r\n") or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"not a whole record: {head[:200]!r}")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    kind = fields["warc-type"]
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"the payload of {fields['warc-record-id']} does not have its digest")
    number = lambda n: int(fields[n]) if n in fields else None
    url = fields.get("warc-target-uri")
    return {
        "page_id": number("page-id"),
        "url": None if url is None else urllib.parse.unquote(url),
        "record_id": fields["warc-record-id"],
        "record_type": kind,
        "payload_bytes": int(_fields(http)["content-length"]),
        "payload_digest": digest,
        "refers_to": number("refers-to-page-id"),
        "refers_to_record": fields.get("warc-refers-to"),
        "payload": payload if kind == "response" else None,
    }


def _store(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder) if ":" in folder else (pyarrow.fs.LocalFileSystem(), folder)


def _writer(folder: str, sample: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        task = TaskContext.get()
        records = (record(page) for batch in batches for some in (batch.slice(at, 64) for at in range(0, batch.num_rows, 64)) for page in some.to_pylist())
        first, k = next(records, None), 0
        while first is not None:
            name = f"pages-{task.partitionId():06d}-{k:04d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.zst"
            with store.open_output_stream(f"{root}/{name}", compression=None) as sink:
                done = archive(chain([first], records), sink, sample, most)
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", **done}], pa.schema([("path", pa.string()), *((n, pa.int64()) for n in ("records", "bytes", "dictionary_bytes"))]))
            first, k = next(records, None), k + 1

    return run


def write(pages: DataFrame, folder: str | None = None, least: int = LEAST, sample: int = SAMPLE, most: int = ARCHIVE) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as archives of about ``most`` bytes into ``folder`` (a new
    one in the shared folder, if not given); returns the manifest: path, records, bytes, dictionary_bytes."""
    spark = pages.sparkSession
    if folder is None:
        folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    store, root = _store(folder)
    store.create_dir(root)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).withColumn("row", F.monotonically_increasing_id())
    place = F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", "url", "row")
    firsts = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    repeated = written(firsts.where("n > 1").select("digest", "first"))
    rows = rows.join(repeated, "digest", "left")
    rows = rows.withColumn("first", F.when(F.col("first.row") != F.col("row"), F.col("first")))
    return written(rows.select("page_id", "url", "row", "html", "digest", "first").mapInArrow(_writer(folder, sample, most), MANIFEST))


def _reader(with_payload: bool):
    order = [c.split()[0] for c in RECORDS.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in RECORDS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for batch in batches for p in batch.column("path").to_pylist()):
            store, at = _store(path)
            held, size = [], 0
            with store.open_input_stream(at, compression=None) as source:
                for one in frames(source):
                    found = parsed(one)
                    if not with_payload:
                        found["payload"] = None
                    held.append(found)
                    size += len(found["payload"] or b"") + 200
                    if size > CHUNK:
                        yield pa.RecordBatch.from_pylist(held, schema).select(order)
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema).select(order)

    return run


def read(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives of ``manifest`` (path): page_id, url, record_id, record_type,
    payload_bytes, payload_digest, refers_to, refers_to_record and the payload (null for revisits, or
    where it is not asked for). Every payload is checked against its digest."""
    paths = manifest.select("path")
    files = paths.count()  # archives are of a set size, so each can be a task
    return paths.repartition(max(1, min(files, 10_000)), "path").mapInArrow(_reader(with_payload), RECORDS)


SQL = """
WITH sized AS (
  SELECT page_id, url, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY html ORDER BY page_id, url) AS place, first_value(page_id) OVER (PARTITION BY html ORDER BY page_id, url) AS first FROM sized
)
SELECT page_id, payload_bytes, sha256(html) AS payload_digest, CASE WHEN payload_bytes >= 100 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND place > 1 THEN first END AS refers_to
FROM ranked
"""
