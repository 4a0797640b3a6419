"""Operator 1: a deterministic sharded WARC writer, and its reader.

Records are range-sorted by page_id into shards; a shard's files roll by compressed size; every record is a gzip member of
its own. Headers and digests are made anew from the payload, so the same pages give the same bytes. Files are written
under temporary names and published by a manifest (see common.commit).
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import common

#: Payloads below this many bytes are never revisits.
LEAST_REVISIT = 100
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, file string, offset long"


def roles(pages: DataFrame) -> DataFrame:
    """page_id, url, html (null: empty), digest, refers_to, is_page: a row for each page, and for each page that repeats another one without url and html that says which one it refers to.

    Of equal payloads of LEAST_REVISIT bytes or more the smallest page_id stays and the others refer to it. Null page_ids
    refer to the smallest one there is; rows that repeat the smallest page_id are responses too. The payloads don't move
    for this: both kinds of rows meet in the sort by page_id.
    """
    html = F.coalesce("html", F.lit(""))
    page_id, digest = F.col("page_id").cast("long").alias("page_id"), F.sha2(html.cast("binary"), 256).alias("digest")
    slim = common.saved(pages.where(F.octet_length(html) >= LEAST_REVISIT).select(page_id, digest), "digests")
    first = common.saved(slim.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated")
    repeats = common.join_facts(slim, first, "digest", "n").where("NOT page_id <=> refers_to").distinct()
    rows = pages.select(page_id, "url", html.alias("html"), digest, F.lit(None).cast("long").alias("refers_to"), F.lit(True).alias("is_page"))
    return rows.unionByName(repeats.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "refers_to", F.lit(False).alias("is_page")))


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def target_uri(page_id: int | None, url: str | None) -> str:
    """The URL with white space and control characters percent-encoded; a URN where there is none."""
    if not url:
        return f"urn:page:{page_id}"
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _sha(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP header only; its Content-Length there is still the payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE), ("WARC-Target-URI", target_uri(page_id, url)), ("WARC-Page-ID", "" if page_id is None else page_id)]
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("WARC-Refers-To-Page-ID", refers_to)]
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", _sha(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _info(name: str) -> bytes:
    body = b"software: pagemill\r\nformat: WARC File Format 1.1\r\n"
    rid = uuid.uuid5(uuid.NAMESPACE_URL, f"file:{name}")
    return f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{rid}>\r\nWARC-Date: {DATE}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def write(pages: DataFrame, folder: str, shard_bytes: int = 16 << 20, roll_bytes: int = 4 << 20, level: int = 4) -> None:
    """Write `pages` (page_id, url, html) to WARC files in `folder`, a shared folder.

    A shard covers a range of page_ids with about `shard_bytes` of payload; its file closes once it has `roll_bytes`
    compressed. Rows without a page_id come last. Rows with one page_id stand by their digests.
    """
    rows = roles(pages)
    bounds = common.range_bounds(pages.select("page_id", "html"), "page_id", F.octet_length(F.coalesce("html", F.lit(""))) + 400, shard_bytes)
    rows = common.in_shards(rows, "page_id", bounds, ["page_id", "digest", "is_page", "url"], spread=["digest"])

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, seq, out, temp, name, size, n, found = None, 0, None, "", "", 0, 0, []
        repeat: tuple = ()

        def close() -> None:
            out.close()
            found.append((shard, seq, temp, name, size, n, ""))

        for pdf in batches:
            for page_id, url, html, digest, refers_to, is_page, s in pdf[["page_id", "url", "html", "digest", "refers_to", "is_page", "shard"]].itertuples(index=False, name=None):
                page_id = _int(page_id)
                if not is_page:
                    repeat = (page_id, digest, _int(refers_to))
                    continue
                if out and (s != shard or size >= roll_bytes):
                    close()
                    out, seq = None, seq + 1
                if s != shard:
                    shard, seq = s, 0
                if out is None:
                    name = f"pages-{shard:06d}-{seq:05d}.warc.gz"
                    temp = common.temp_name(folder, name)
                    fs, path = common.filesystem(temp)
                    out, n = fs.open_output_stream(path, compression=None), 0
                    size = out.write(first := _gzip(_info(name), level)) or len(first)
                refers_to = repeat[2] if repeat[:2] == (page_id, digest) else None
                data = _gzip(record(page_id, url, html.encode(), digest, refers_to), level)
                out.write(data)
                size, n = size + len(data), n + 1
        if out:
            close()
        yield pd.DataFrame(found, columns=["shard", "seq", "temp", "name", "size", "n", "note"])

    ids = rows.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})  # long ids and nulls, exactly
    common.commit(ids.mapInPandas(put, common.WRITTEN), folder)


def _int(x: object) -> int | None:
    return None if x is None or x != x else int(x)


def members(uri: str, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member of a file, one in memory at a time."""
    fs, path = common.filesystem(uri)
    with fs.open_input_stream(path, compression=None) as f:
        data, start, at = b"", 0, 0
        while data := data or f.read(chunk):
            z, parts = zlib.decompressobj(31), []
            start = at
            while not z.eof:
                if not data and not (data := f.read(chunk)):
                    raise ValueError(f"{uri} ends within the member at {start}")
                parts.append(z.decompress(data))
                at += len(data) - len(z.unused_data)
                data = z.unused_data
            yield start, b"".join(parts)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record; checks the length and the block digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n" or headers.get("warc-block-digest", _sha(block)) != _sha(block):
        raise ValueError(f"damaged record {headers.get('warc-record-id')}")
    return headers, block


def read(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """Rows of READ (and `payload`, binary, null for revisits, if asked for) from the files in the folder's manifest.

    A response's size and digest come from its payload as read; a revisit's from its headers.
    """
    files = common.manifest(spark, folder).select(F.concat(F.lit(f"{folder}/"), "name").alias("path"))
    schema = READ + (", payload binary" if payload else "")
    names = [x.split()[0] for x in schema.split(", ")]
    def get(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                rows, held = [], 0
                for offset, raw in members(path):
                    headers, block = parse(raw)
                    if headers["warc-type"] == "warcinfo":
                        continue
                    http, _, body = block.partition(b"\r\n\r\n")
                    revisit = headers["warc-type"] == "revisit"
                    size = int(re.search(rb"\nContent-Length: (\d+)", http)[1]) if revisit else len(body)
                    digest = headers["warc-payload-digest"].removeprefix("sha256:") if revisit else hashlib.sha256(body).hexdigest()
                    row = (headers.get("warc-page-id") or None, size, digest, headers["warc-type"], headers.get("warc-refers-to-page-id") or None, headers["warc-target-uri"], path.rsplit("/", 1)[-1], offset)
                    rows.append(row + ((None if revisit else body),) * payload)
                    held += len(body) * payload + 500
                    if held > 32 << 20:
                        yield _frame(rows, names)
                        rows, held = [], 0
                yield _frame(rows, names)

    return files.repartition(min(max(1, files.count()), common.MAX_SHARDS), "path").mapInPandas(get, schema)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=names)
    for c in ("page_id", "refers_to"):
        pdf[c] = pd.array([None if x is None else int(x) for x in pdf[c]], dtype="Int64")
    return pdf


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.new_dir(spark, "warc")
    write(common.table(spark, sf_dir, "pages"), folder)
    return read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op1_warc": op1_warc}
ORACLE_SQL = {
    "op1_warc": f"""
        WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS keep FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes < {LEAST_REVISIT} OR page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN payload_bytes >= {LEAST_REVISIT} AND page_id <> keep THEN keep END AS refers_to FROM g"""
}
