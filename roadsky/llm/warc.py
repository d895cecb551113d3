"""WARC archives with a two-level capture index.

``write_archives`` writes one gzip member per page to ``.warc.gz`` files in the
shared folder. Of pages with equal payloads the one with the largest id is a
response, the others are revisits that refer to it.

``build_index`` sorts the captures by reversed-host URL and id, cuts them into
compressed blocks, and keeps the first key of each block as a sparse
directory. The blocks lie in shards of about ``SHARD_CAPTURES``; a shard is
one range of keys. ``locate`` sends keys to their shard, bisects the shard's
directory, unpacks one block, and bisects that; ``read_records`` then reads
just the found byte ranges, in the order in which they lie in the files.

Files are written and read by ``pyarrow.fs``, so the shared folder may be any
store it opens. A task's files have names of their own; only those of tasks
that ended well are in the table of captures, which is written before it is
used, so a lost executor leaves no half of an archive in the index.

Cases: a null page is an empty payload; a null URL is the empty key; equal
URLs are kept apart by the id; repeated rows (equal id and payload) are
records of their own, all responses where the id is the largest, and each is
read back; rows with a null id stand behind all others; empty tables give
empty results. Columns beside id, URL and page are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadsky.llm.common import spread_lookup, stored, table
from roadsky.session import scratch_path

#: Captures in a compressed block; the directory has one entry for each block.
BLOCK_CAPTURES = 1000
#: Captures in a shard of the index, about, and shards at most: their first keys reach every task.
SHARD_CAPTURES = 50_000
MOST_SHARDS = 65_536
#: An archive file is closed beyond this size.
FILE_BYTES = 128 << 20
#: Neighbouring ranges are read together up to this size.
READ_BYTES = 256 << 10
DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CAPTURE = "key string, page_id long, file string, offset long, length long"


def reversed_host(url: str | None) -> str:
    """``com,example,www)/path?query``: a URL's sort key, so that captures of a domain lie together."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return url.replace("\t", "%09").replace("\n", "%0A").replace(" ", "%20")
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + path
    return key.replace("\t", "%09").replace("\n", "%0A").replace(" ", "%20")


def capture_key(url: str | None, page_id: int | None) -> str:
    return f"{reversed_host(url)} {'-' if page_id is None else page_id}"


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record, not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {urn(page_id)}",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {uri}"] if uri else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: {urn(refers_to)}", f"WARC-Profile: {_PROFILE}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Type, id, payload (None for a revisit), length and digest of the full payload, and what a revisit refers to."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    named = lambda x: None if x is None or x == urn(None) else int(x[len("<urn:page:") : -1])
    revisit = fields["warc-type"] == "revisit"
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if not revisit and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"record {fields['warc-record-id']} does not have the payload it tells of")
    return {
        "page_id": named(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"),
        "record_type": fields["warc-type"],
        "payload": None if revisit else payload,
        "payload_bytes": length,
        "payload_digest": digest,
        "refers_to": named(fields.get("warc-refers-to")) if revisit else None,
    }


def _ids(values: list) -> pd.Series:
    return pd.Series(pd.array(values, "Int64"))


def _or_none(value):
    return None if value is None or value is pd.NA or value != value else int(value)


def write_archives(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write every page's record; (key, page_id, file, offset, length) of each. Payloads under ``least_bytes`` are all responses."""
    folder = scratch_path(pages.sparkSession, "warc")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    keepers = (
        rows.filter(F.octet_length("payload") >= least_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    known = spread_lookup(rows, keepers, ["digest"], [F.col("page_id")])

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, _ = fs.FileSystem.from_uri(folder)
        out = path = None
        offset = 0
        for frame in frames:
            made = []
            for page_id, url, payload, digest, keeper in zip(
                frame["page_id"], frame["url"], frame["payload"], frame["digest"], frame["keeper"], strict=True
            ):
                page_id, keeper = _or_none(page_id), _or_none(keeper)
                if out is None or offset >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    path, offset = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                    _, plain = fs.FileSystem.from_uri(path)
                    files.create_dir(plain.rpartition("/")[0], recursive=True)
                    out = files.open_output_stream(plain, compression=None)
                base32 = base64.b32encode(bytes.fromhex(digest)).decode()
                revisit = keeper is not None and page_id != keeper
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = packer.compress(record(page_id, url, payload, base32, keeper, revisit)) + packer.flush()
                out.write(data)
                made.append((capture_key(url, page_id), page_id, path, offset, len(data)))
                offset += len(data)
            found = pd.DataFrame(made, columns=["key", "page_id", "file", "offset", "length"])
            yield found.assign(page_id=_ids(found["page_id"].tolist()))
        if out is not None:
            out.close()

    return stored(known.mapInPandas(write, _CAPTURE), "captures")


def build_index(captures: DataFrame) -> DataFrame:
    """(shard, block, first, captures, data): sorted captures in compressed blocks, shards being ranges of keys."""
    shards = min(MOST_SHARDS, max(1, -(-captures.count() // SHARD_CAPTURES)))

    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, block, held = TaskContext.get().partitionId(), 0, []

        def packed() -> pd.DataFrame:
            data = zlib.compress("\n".join("\t".join(map(str, x)) for x in held).encode(), 6)
            return pd.DataFrame([(shard, block, held[0][0], len(held), data)], columns=["shard", "block", "first", "captures", "data"])

        for frame in frames:
            for row in frame[["key", "file", "offset", "length"]].itertuples(index=False):
                held.append(tuple(row))
                if len(held) == BLOCK_CAPTURES:
                    yield packed()
                    block, held = block + 1, []
        if held:
            yield packed()

    ordered = captures.repartitionByRange(shards, "key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    return stored(ordered.mapInPandas(blocks, "shard int, block int, first string, captures long, data binary"), "index")


def find_in_shard(wanted: list[str], firsts: list[str], data: list[bytes]) -> list[tuple]:
    """(key, file, offset, length) of all captures whose key begins with a wanted one: directory, then block."""
    out, open_block, lines = [], -1, []
    for key in sorted(set(wanted)):
        at = max(0, bisect_left(firsts, key.rstrip("\t")) - 1)
        while at < len(firsts) and (firsts[at] <= key or firsts[at].startswith(key)):
            if at != open_block:
                open_block, lines = at, zlib.decompress(data[at]).decode().split("\n")
            i = bisect_left(lines, key)
            while i < len(lines) and lines[i].startswith(key):
                found, file, offset, length = lines[i].split("\t")
                out.append((found, file, int(offset), int(length)))
                i += 1
            at += 1
    return out


def locate(index: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, file, offset, length) of the captures whose key begins with one of ``keys`` (column ``key``).

    A key that ends in a blank finds all captures of a URL, a whole key one capture.
    """
    rows = index.groupBy("shard").agg(F.min("first").alias("first")).orderBy("first").collect()  # MOST_SHARDS at most
    firsts, shards = [r["first"] for r in rows], [r["shard"] for r in rows]

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key in frame["key"]:
                low = max(0, bisect_left(firsts, key.rstrip("\t")) - 1)
                high = max(low, bisect_right(firsts, key + "\U0010ffff") - 1)
                out += [(shards[s], key) for s in range(low, high + 1)] if shards else []
            yield pd.DataFrame(out, columns=["shard", "key"])

    def find(wanted: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("block")
        found = find_in_shard(wanted["key"].tolist(), blocks["first"].tolist(), blocks["data"].tolist())
        return pd.DataFrame(found, columns=["key", "file", "offset", "length"])

    dealt = keys.select("key").mapInPandas(deal, "shard int, key string")
    both = dealt.groupBy("shard").cogroup(index.select("shard", "block", "first", "data").groupBy("shard"))
    return both.applyInPandas(find, "key string, file string, offset long, length long")


def read_records(places: DataFrame, payload: bool = True) -> DataFrame:
    """The records at (file, offset, length), read range by range."""
    columns = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]
    schema = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source = path = None
        start, held = 0, b""
        for frame in frames:
            out = []
            for file, offset, length in zip(frame["file"], frame["offset"], frame["length"], strict=True):
                if file != path:
                    files, plain = fs.FileSystem.from_uri(file)
                    source, path, held = files.open_input_file(plain), file, b""
                if not (start <= offset and offset + length <= start + len(held)):
                    source.seek(offset)
                    start, held = offset, source.read(max(length, READ_BYTES))
                fields = parse(zlib.decompress(held[offset - start : offset - start + length], 31))
                if not payload:
                    fields["payload"] = None
                out.append([fields[c] for c in columns])
            made = pd.DataFrame(out, columns=columns)
            for c in ("page_id", "refers_to"):
                made[c] = _ids(made[c].tolist())
            yield made

    ordered = places.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInPandas(read, schema)


def page_keys(pages: DataFrame) -> DataFrame:
    """The index key of every page, each once."""

    def keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids = [_or_none(x) for x in frame["page_id"]]
            yield pd.DataFrame({"key": [capture_key(u, i) + "\t" for u, i in zip(frame["url"], ids, strict=True)]})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    return rows.mapInPandas(keys, "key string").distinct()


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    index = build_index(write_archives(pages))
    found = read_records(locate(index, page_keys(pages)), payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


#: The contract's result without archives. The base-32 digest: 32 groups of five bits, four to five hexadecimal digits.
OP1_SQL = """
WITH payloads AS (
    SELECT page_id, url, coalesce(html, '') AS payload,
           max(page_id) OVER (PARTITION BY coalesce(html, '')) AS latest
    FROM pages
)
SELECT page_id,
       strlen(payload)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  1 + ((('0x' || substr(sha1(payload), 1 + 5 * (i // 4), 5))::INTEGER
                        >> (15 - 5 * (i % 4))::INTEGER) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> latest THEN latest END AS refers_to,
       coalesce(url, '') AS url
FROM payloads
"""
