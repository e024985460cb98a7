"""WARC archives of pages and their two-level capture index.

Archives: every page becomes one gzip member holding one WARC/1.1 record; members are laid end to end in chunks of
about ``CHUNK`` bytes, which are rows of a written table (the chunks of an archive in order are a ``.warc.gz`` file).
So a lost executor, or a store that only Spark can reach, is no matter.

Index: one line per record, ``key archive chunk offset length``, where the key is the url with its host reversed.
Lines are range-sorted over the cluster and compressed in blocks of ``LINES`` lines. The first level is the range of
keys of each sorted part (as many as there are partitions), the second the first and last key of each block. A look-up
bisects the parts, meets the part's blocks by an equi-join, bisects the lines of the block, and reads a byte range.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written

CHUNK = 1 << 20
LINES = 3000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "urn:page:"


def sort_key(url: str | None) -> str:
    """Reversed host labels, ``)``, then the rest of the url; control characters and blanks are percent-encoded."""
    # Encoded first, so that a url and the target header made of it have one key.
    url = quote(url or "", safe="".join(map(chr, range(33, 127))))
    _, found, rest = url.partition("://")
    rest = rest if found else url
    host = rest
    for c in "/?#":
        host = host.partition(c)[0]
    return ",".join(reversed(host.lower().split("."))) + ")" + rest[len(host) :]


def record(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, refers_to: int | None, date: str) -> bytes:
    """One gzip member. A revisit keeps the payload's digest and length, not the payload."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{RECORD}{'' if page_id is None else page_id}>"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(33, 127)))))
    head += [f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{RECORD}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return made.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + made.flush()


def parse(raw: bytes) -> dict:
    """Headers (lower-case names), and ``payload`` of a response, whose digest must be the one in its header."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = top.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    out: dict = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(out["content-length"])]
    if out["warc-type"] == "response":
        out["payload"] = block.partition(b"\r\n\r\n")[2]
        if "sha1:" + base64.b32encode(hashlib.sha1(out["payload"]).digest()).decode() != out["warc-payload-digest"]:
            raise ValueError(f"digest of {out['warc-record-id']} differs")
    return out


def _id(header: str | None) -> int | None:
    digits = (header or "").removeprefix(f"<{RECORD}").removesuffix(">")
    return int(digits) if digits else None


def revisits(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(__page, d, n, __refers_to)``: pages, by id, digest and length of the payload, whose payload, of ``min_bytes``
    or more, a page with a larger id has too."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    digests = pages.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("__page"), F.sha1(payload).alias("d"), F.octet_length(payload).alias("n")
    ).where(F.col("n") >= min_bytes)
    # Payloads that occur once, nearly all of them, end in the aggregation.
    keepers = digests.groupBy("d", "n").agg(F.max("__page").alias("__refers_to"), F.min("__page").alias("low")).where("low < __refers_to")
    return digests.join(keepers, ["d", "n"]).where("__page < __refers_to").select("__page", "d", "n", "__refers_to").distinct()


def archives(pages: DataFrame, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Written table ``(archive, chunk, data)`` with a record per page.

    Null html is an empty payload; a null url has no target header; a null id has an empty record id and is a
    response. Of pages with one id and payload none revisits another. Other columns are ignored.
    """
    again = written(revisits(pages, min_bytes, id_col, html_col), "warc-revisits")
    given = pages.select(F.col(id_col).alias("__page"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    # An id may have several payloads; there is at most one answer for each id and payload.
    payload = F.coalesce("html", F.lit("")).cast("binary")
    given = given.withColumns({"d": F.sha1(payload), "n": F.octet_length(payload)}).join(again, ["__page", "d", "n"], "left").drop("d", "n") if not again.isEmpty() else given.withColumn("__refers_to", F.lit(None).cast("bigint"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archive = f"part-{TaskContext.get().partitionId():06d}"
        chunk, held, size = 0, [], 0
        for b in batches:
            for page, url, html, ref in zip(b["__page"], b["url"], b["html"], b["__refers_to"]):
                payload = (html or "").encode()
                made = record(
                    None if pd.isna(page) else int(page), url, payload, hashlib.sha1(payload).digest(), None if pd.isna(ref) else int(ref), date
                )
                held.append(made)
                size += len(made)
                if size >= CHUNK:
                    yield pd.DataFrame({"archive": [archive], "chunk": [chunk], "data": [b"".join(held)]})
                    chunk, held, size = chunk + 1, [], 0
        if held:
            yield pd.DataFrame({"archive": [archive], "chunk": [chunk], "data": [b"".join(held)]})

    return written(given.mapInPandas(write, "archive string, chunk int, data binary"), "warc-archives")


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """``(offset, length, content)`` of the gzip members of a chunk."""
    at, view = 0, memoryview(data)
    while at < len(data):
        parts, unzip, end = [], zlib.decompressobj(31), at
        while not unzip.eof and end < len(data):
            parts.append(unzip.decompress(view[end : end + 16384]))
            end += 16384
        end = min(end, len(data)) - len(unzip.unused_data)
        yield at, end - at, b"".join(parts)
        at = end


def index(stored: DataFrame) -> DataFrame:
    """Written table ``(part, block, first, last, lines binary)`` of the records of ``stored`` archives."""

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for archive, chunk, data in zip(b["archive"], b["chunk"], b["data"]):
                rows = [
                    (sort_key(parse(raw).get("warc-target-uri")), archive, chunk, offset, length) for offset, length, raw in members(data)
                ]
                yield pd.DataFrame(rows, columns=["key", "archive", "chunk", "offset", "length"])

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def made(rows: list[tuple]) -> pd.DataFrame:
            lines = "\n".join(" ".join(map(str, r)) for r in rows).encode()
            return pd.DataFrame({"part": [part], "block": [number], "first": [rows[0][0]], "last": [rows[-1][0]], "lines": [zlib.compress(lines)]})

        for b in batches:
            held += b.itertuples(index=False, name=None)
            while len(held) >= LINES:
                yield made(held[:LINES])
                held, number = held[LINES:], number + 1
        if held:
            yield made(held)

    order = ["key", "archive", "chunk", "offset"]
    listed = written(stored.mapInPandas(entries, "key string, archive string, chunk int, offset bigint, length bigint"), "warc-entries")
    ranged = listed.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    return written(ranged.mapInPandas(blocks, "part int, block int, first string, last string, lines binary"), "warc-index")


def _read(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Records at ``(archive, chunk, offset, length)``. Ranges of a chunk are gathered first (a chunk holds so many),
    so that its bytes are read once. They are a written table: where it is small the ranges go to the chunks and no
    archive byte is shuffled."""
    wanted = written(found.groupBy("archive", "chunk").agg(F.collect_list(F.struct("offset", "length")).alias("ranges")), "warc-ranges")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data, ranges in zip(b["data"], b["ranges"]):
                rows = []
                for r in ranges:
                    got = parse(zlib.decompress(data[r["offset"] : r["offset"] + r["length"]], 31))
                    payload = got.get("payload")
                    rows.append(
                        (_id(got["warc-record-id"]), got.get("warc-target-uri"), got["warc-type"], int(got["x-payload-length"]),
                         got["warc-payload-digest"].removeprefix("sha1:"), _id(got.get("warc-refers-to")), payload)
                    )
                out = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    return stored.join(wanted, ["archive", "chunk"]).select("data", "ranges").mapInPandas(
        run, "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"
    )


def read_all(stored: DataFrame, indexed: DataFrame) -> DataFrame:
    """Every record, read by the ranges that the index names."""

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lines in b["lines"]:
                rows = [x.split(" ") for x in zlib.decompress(lines).decode().split("\n")]
                out = pd.DataFrame(rows, columns=["key", "archive", "chunk", "offset", "length"])
                yield out.drop(columns="key").astype({"chunk": "int32", "offset": "int64", "length": "int64"})

    return _read(indexed.select("lines").mapInPandas(places, "archive string, chunk int, offset bigint, length bigint"), stored)


def look_up(wanted: DataFrame, stored: DataFrame, indexed: DataFrame, url_col: str = "url") -> DataFrame:
    """The records of the urls of ``wanted`` (equal urls once; nulls find records without a target)."""
    spark = stored.sparkSession
    parts = indexed.groupBy("part").agg(F.min("first").alias("first"), F.max("last").alias("last")).orderBy("first", "part").collect()
    sent = spark.sparkContext.broadcast([(r["part"], r["first"], r["last"]) for r in parts])

    def part_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lasts, firsts = [x[2] for x in sent.value], [x[1] for x in sent.value]
        for b in batches:
            keys = [sort_key(u) for u in b["u"]]
            rows = [(k, sent.value[i][0]) for k in keys for i in range(bisect_left(lasts, k), bisect_right(firsts, k))]
            yield pd.DataFrame(rows, columns=["key", "part"])

    def lines_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for keys, lines in zip(b["keys"], b["lines"]):
                rows = [x.split(" ") for x in zlib.decompress(lines).decode().split("\n")]
                names, out = [r[0] for r in rows], []
                for k in keys:
                    out += rows[bisect_left(names, k) : bisect_right(names, k)]
                found = pd.DataFrame(out, columns=["key", "archive", "chunk", "offset", "length"])
                yield found.astype({"chunk": "int32", "offset": "int64", "length": "int64"})

    def block_of(asked: pd.DataFrame, directory: pd.DataFrame) -> pd.DataFrame:
        """The keys of each block of a part, by bisection of the blocks' first and last keys."""
        directory = directory.sort_values("block")
        firsts, lasts, met = directory["first"].tolist(), directory["last"].tolist(), {}
        for k in asked["key"].tolist():
            for i in range(bisect_left(lasts, k), bisect_right(firsts, k)):
                met.setdefault(i, []).append(k)
        part = int(directory["part"].iloc[0]) if len(directory) else 0
        return pd.DataFrame([(part, int(directory["block"].iloc[i]), ks) for i, ks in met.items()], columns=["part", "block", "keys"])

    keys = wanted.select(F.col(url_col).alias("u")).distinct().mapInPandas(part_of, "key string, part int").distinct()
    # A block is met by the distinct keys that lie in it; neither its lines nor its place are repeated for them.
    blocks = keys.groupBy("part").cogroup(indexed.select("part", "block", "first", "last").groupBy("part")).applyInPandas(
        block_of, "part int, block int, keys array<string>"
    )
    found = indexed.join(blocks, ["part", "block"]).select("keys", "lines")
    return _read(found.mapInPandas(lines_of, "key string, archive string, chunk int, offset bigint, length bigint").drop("key"), stored)


#: What a page's record must say, by grouping the payloads. Base 32 is built from the digest's bits.
ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS keeper FROM p),
b AS (SELECT *, array_to_string(list_transform(range(40), lambda i: lpad(bin(instr('0123456789abcdef', hex[i + 1]) - 1), 4, '0')), '') AS bits FROM k)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * bits[5 * i + 1]::INT + 8 * bits[5 * i + 2]::INT
         + 4 * bits[5 * i + 3]::INT + 2 * bits[5 * i + 4]::INT + bits[5 * i + 5]::INT]), '') AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id < keeper THEN keeper END AS refers_to
FROM b
"""
