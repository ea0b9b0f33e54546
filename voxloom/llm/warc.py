"""WARC in Zstandard: dictionary in a leading skippable frame, one frame for each record.

The writer fits a dictionary on a bounded sample (``sample`` pages, at most ``sample_bytes`` of each), finds
payloads that occur again by length and SHA-1, and writes a ``response`` record with the HTTP header and the
payload, or a ``revisit`` with the header only. The reader takes the dictionary from the file alone, finds
each frame's end by its block headers, decodes one frame at a time and checks version line, block length,
HTTP content length and, for payloads that are there, the digest.

Equal payloads are found by counting digests (combined before the shuffle); a payload that a third of the
pages share makes one row there. A task writes files of about ``file_bytes``, under a temporary name, then
renamed, so that it can run again. Small tables are dealt to as many tasks as there are cores, not to more, so
archives don't become scraps. The list of archives (one row for 64 MB) goes by way of the driver.

Defined results: null html is an empty payload; a null id or url stays null, is never referred to and its
record is a response; rows that repeat the smallest id with its payload are responses too; an empty table
gives no files; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SharedFiles, Workspace, worker

#: Fixed values of the formats: magic numbers of a skippable frame that holds a dictionary and of a frame.
DICT_MAGIC, FRAME_MAGIC, VERSION = 0x184D2A5D, 0xFD2FB528, b"WARC/1.1"
#: Characters of a target that stand as they are; "%" is not one, so what is read back is what was written.
URI = "!#$&'()*+,/:;=?@[]-._~"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id, url, payload: bytes, sha1: str, refers_to=None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=URI)}")
    lines += [f"WARC-Payload-Digest: sha1:{sha1}", f"Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's fields and its block; raises where the record is not well formed."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first.encode() != VERSION or not gap:
        raise ValueError(f"not a {VERSION.decode()} record: {first[:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines)
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError(f"record {fields['WARC-Record-ID']}: block isn't {n} bytes long")
    return fields, rest[:n]


def frame_end(buf: memoryview, at: int) -> int:
    """Where the frame that starts at ``at`` ends, from its header and block headers."""
    magic, how = struct.unpack_from("<IB", buf, at)
    if magic != FRAME_MAGIC:
        raise ValueError(f"no frame at {at}")
    single = how >> 5 & 1
    p = at + 5 + (not single) + (0, 1, 2, 4)[how & 3] + ((1 if single else 0), 2, 4, 8)[how >> 6]
    last = 0
    while not last:
        b = int.from_bytes(buf[p : p + 3], "little")
        last, kind, size = b & 1, b >> 1 & 3, b >> 3
        p += 3 + (1 if kind == 1 else size)
    return p + 4 * (how >> 2 & 1)


def read_archive(buf):
    """Fields, payload (None for a revisit), payload length of each record of an archive in memory."""
    import zstandard

    buf = memoryview(buf)
    magic, n = struct.unpack_from("<II", buf)
    if magic != DICT_MAGIC:
        raise ValueError("no dictionary in front")
    words = bytes(buf[8 : 8 + n])
    decode = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None).decompress
    at = 8 + n
    while at < len(buf):
        end = frame_end(buf, at)
        fields, block = headers(decode(buf[at:end]))
        http, _, payload = block.partition(b"\r\n\r\n")
        length = next(int(x[16:]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
        if fields["WARC-Type"] == "response":
            if len(payload) != length or f"sha1:{digest(payload)}" != fields["WARC-Payload-Digest"]:
                raise ValueError(f"record {fields['WARC-Record-ID']}: payload doesn't fit its header")
            yield fields, payload, length
        else:
            yield fields, None, length
        at = end


def fit_dictionary(pages: DataFrame, *, sample: int = 512, sample_bytes: int = 8192, dict_bytes: int = 16_384) -> bytes:
    """A dictionary from at most ``sample`` pages; empty where they are too few to fit one."""
    import zstandard

    pages = pages.filter("html is not null").withColumn("k", F.xxhash64("page_id"))
    most = pages.select("k").orderBy("k").limit(sample).agg(F.max("k")).first()[0]
    rows = pages.filter(F.col("k") <= F.lit(most)).select(F.substring("html", 1, sample_bytes).alias("h"), "k").limit(2 * sample).collect()
    rows = sorted(rows, key=lambda r: (r["k"], r["h"]))[:sample]
    texts = [r["h"].encode() for r in rows if r["h"]]
    if len(texts) < 16 or sum(map(len, texts)) < 10 * dict_bytes:
        return b""
    try:
        return zstandard.train_dictionary(dict_bytes, texts).as_bytes()
    except zstandard.ZstdError:
        return b""


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, sha, size, refers_to`` of the pages whose payload an earlier id has."""
    html = F.coalesce("html", F.lit(""))
    keyed = pages.filter(F.col("page_id").isNotNull()).select("page_id", F.sha1(html).alias("sha"), F.octet_length(html).alias("size"))
    first = keyed.groupBy("sha", "size").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"))
    first = first.filter((F.col("last") > F.col("refers_to")) & (F.col("size") >= min_bytes)).drop("last")
    return keyed.join(first, ["sha", "size"]).filter(F.col("page_id") > F.col("refers_to")).distinct()


def write_archives(pages: DataFrame, folder: str, *, min_bytes: int = 0, file_bytes: int = 64 << 20, level: int = 3) -> DataFrame:
    """Writes the archives; ``name, n_records, n_bytes`` of each. Run its plan once (``listed`` does)."""
    words = fit_dictionary(pages)
    html = F.coalesce("html", F.lit(""))
    seen = revisits(pages, min_bytes).withColumnRenamed("page_id", "seen_id")
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("k"), F.octet_length(html).alias("n"))
    n_bytes = pages.agg(F.sum(F.octet_length(html))).first()[0] or 0
    n_tasks = max(pages.sparkSession.sparkContext.defaultParallelism, 2, -(-n_bytes // file_bytes))
    rows = rows.join(seen, (F.col("page_id") == F.col("seen_id")) & (F.col("k") == F.col("sha")) & (F.col("n") == F.col("size")), "left")

    def write(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        part, shared = TaskContext.get().partitionId(), SharedFiles(folder)
        front = struct.pack("<II", DICT_MAGIC, len(words)) + words
        encode = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(words) if words else None).compress
        done, held, size = [], [], 0

        def close() -> None:
            nonlocal held, size
            name = f"pages-{part:06d}-{len(done):04d}.warc.zst"
            done.append((name, len(held), shared.write(name, [front, *held])))
            held, size = [], 0

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part_of = b.slice(at, 256)
                for page_id, url, h, sha, to in zip(*(part_of[c].to_pylist() for c in ("page_id", "url", "html", "k", "refers_to")), strict=True):
                    sha1 = base64.b32encode(bytes.fromhex(sha)).decode()
                    held.append(encode(record("response" if to is None else "revisit", page_id, url, h.encode(), sha1, to)))
                    size += len(held[-1])
                    if size >= file_bytes:
                        close()
        if held:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["name", "n_records", "n_bytes"])

    rows = rows.select("page_id", "url", "html", "k", "refers_to").coalesce(min(n_tasks, 2**31 - 1))
    return rows.mapInArrow(worker(write), "name string, n_records long, n_bytes long")


def read_archives(files: DataFrame, folder: str, n_tasks: int | None = None) -> DataFrame:
    """A row for each record: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to``."""

    def read(batches):
        import pyarrow as pa

        kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        number = lambda x: int(x[len("<urn:page:") : -1]) if x and x != "<urn:page:>" else None
        shared = SharedFiles(folder)
        for b in batches:
            for name, n in zip(b["name"].to_pylist(), b["n_records"].to_pylist(), strict=True):
                with shared.open(name) as f:
                    data = f.read_buffer()
                    rows = []
                    for fields, _, length in read_archive(data):
                        url = fields.get("WARC-Target-URI")
                        rows.append((number(fields["WARC-Record-ID"]), url if url is None else unquote(url), length, fields["WARC-Payload-Digest"][5:], fields["WARC-Type"], number(fields.get("WARC-Refers-To"))))
                if len(rows) != n:
                    raise ValueError(f"{name} has {len(rows)} records, {n} were written")
                for at in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x, k.type) for x, k in zip(zip(*rows[at : at + 10_000], strict=True), kinds, strict=True)], schema=kinds)

    files = files.select("name", "n_records")
    spread = files.repartition(n_tasks or files.sparkSession.sparkContext.defaultParallelism * 2)
    return spread.mapInArrow(worker(read), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def warc_round_trip(pages: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back."""
    work = Workspace(pages.sparkSession, "warc")
    folder = work.folder("archives")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return read_archives(work.listed(write_archives(pages, folder, min_bytes=min_bytes)), folder)
