r"""WARC archives: a writer with payload revisits, and a salvage reader.

The writer makes one record a page. Of records with equal payloads the one
with the largest page_id is a response, the others are revisits that refer to
it. Files come from Spark's committed text writer, whose line separator is the
two line ends that close a record, and hold about FILE_BYTES each.

The reader takes files as bytes, plain or in gzip members of one or more records.
Each record is checked: version line, headers, length, closing line ends, and
the payload's digest. Where a check fails, it searches for the next gzip member
or version line at which a record passes, goes on from there, and logs the
bytes between as a gap. Inside a member it does the same with the unpacked
bytes; of a member that breaks off or is damaged, it reads what unpacks before
the damage. Such gaps have the member's range, and their place in its unpacked
bytes (inner_offset, inner_length).

Defined results
  null html          an empty payload, equal to other empty ones
  null page_id       a response, referred to by none
  repeated page_ids  all rows of the largest page_id are responses
  null url           no target header; line ends in a url are percent-encoded
  empty table        an archive without records
  extra columns      ignored
  very long html     one record; archives of over 2 GB can't be read, and a
                     gzip member is unpacked whole, in one task's memory
  payload digests    SHA-1, SHA-256 or MD5, in base32 or hexadecimal of any
                     case; digests of other algorithms aren't checked
  damaged headers    lengths and ids are up to 18 ASCII digits; a record with
                     any other is quarantined, one with another id has none
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrywork.llm.scratch import Scratch
from quarrywork.llm.workers import lean

FILE_BYTES = 16 << 20
#: Payloads under so many bytes are never revisits.
REVISIT_BYTES = 0
#: More revisits are joined by a shuffle.
BROADCAST_REVISITS = 200_000
DATE = "2020-01-01T00:00:00Z"
_END = b"\r\n\r\n"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_START = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORD = "file string, offset bigint, length bigint, kind string, reason string, record_type string, record_id string, page_id bigint, uri string, payload_bytes bigint, payload_digest string, refers_to bigint, inner_offset bigint, inner_length bigint, payload binary"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_FIELDS = [c.split()[0] for c in RECORD.split(", ")]


def _page_of(record_id: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?[0-9]{1,19})>", record_id or "")
    return int(found[1]) if found and -(1 << 63) <= int(found[1]) < 1 << 63 else None


def _length_of(value: str) -> int | None:
    return int(value) if re.fullmatch("[0-9]{1,18}", value) else None


def base32(hexadecimal: Column) -> Column:
    """Of 40 hexadecimal digits: five digits are four letters."""

    def letters(group: Column) -> Column:
        at = [F.shiftright(group, 5 * (3 - k)).bitwiseAND(F.lit(31)) + 1 for k in range(4)]
        return F.concat(*[F.substring(F.lit(_ALPHABET), x, F.lit(1)) for x in at])

    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.conv(F.substring(hexadecimal, k * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    return F.array_join(F.transform(groups, letters), "")


def _clean(url: Column) -> Column:
    """Without the characters that would end a header line."""
    out = url
    for c in ("\r", "\n", " ", "\t", "\0"):
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return out


def record_text() -> Column:
    """A whole record of a row (page_id, url, html, sha1, n, refers_to), without the line ends that close it."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    page = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    length = F.when(revisit, F.lit(0)).otherwise(F.col("n")) + len(_HTTP)
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", page("page_id")),
        line("WARC-Date", F.lit(DATE)),
        F.when(F.coalesce(F.col("url"), F.lit("")) == "", F.lit("")).otherwise(line("WARC-Target-URI", _clean(F.col("url")))),
        F.when(revisit, F.concat(line("WARC-Refers-To", page("refers_to")), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        line("WARC-Payload-Length", F.col("n").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit(f"\r\n{_HTTP}"),
        F.when(revisit, F.lit("")).otherwise(F.col("html")),
    )


def write_warc(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Writes pages (page_id, url, html) as plain WARC files."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"), F.octet_length(html).alias("n"))
    known = rows.select("page_id", "sha1", "n")
    latest = known.filter(F.col("n") >= revisit_bytes).groupBy("sha1", "n").agg(F.max("page_id").alias("latest"), F.count("*").alias("k")).filter("k > 1").drop("k")
    # Only revisits are joined, so that payloads needn't move: broadcast while they are few.
    scratch = Scratch(pages.sparkSession, "revisits")
    again = known.join(latest, ["sha1", "n"]).filter("page_id < latest").select("page_id", "sha1", "n", F.col("latest").alias("refers_to")).distinct()
    again = scratch.write(again, "revisits")
    again = F.broadcast(again) if again.limit(BROADCAST_REVISITS + 1).count() <= BROADCAST_REVISITS else again
    named = rows.join(again, ["page_id", "sha1", "n"], "left")
    total, count = known.agg(F.sum("n"), F.count("*")).first()
    per_file = max(1, min(1_000_000, int(file_bytes / (max(1, total or 0) / max(1, count) + 600))))
    named.select(record_text().alias("value")).write.mode("overwrite").option("lineSep", _END.decode()).option("maxRecordsPerFile", per_file).text(path)


#: Digests by name: the function, and how many digits they have in hexadecimal and letters in base32.
_DIGESTS = {"sha1": (hashlib.sha1, 40, 32), "sha256": (hashlib.sha256, 64, 52), "md5": (hashlib.md5, 32, 26)}


def _agrees(said: str, payload: bytes) -> bool:
    """Whether a digest as written is the payload's; one of an unknown form can't disagree."""
    name, colon, value = said.rpartition(":")
    function, digits, letters = _DIGESTS.get(name.strip().lower().replace("-", "") if colon else "sha1", (None, 0, 0))
    value = value.strip().rstrip("=")
    if function is None or len(value) not in (digits, letters):
        return not (function and colon)
    raw = function(payload).digest()
    return value.lower() == (raw.hex() if len(value) == digits else base64.b32encode(raw).decode().rstrip("=").lower())


def _parse_plain(data: bytes, at: int) -> tuple[dict, int] | str:
    """The record that begins at a place, and where the next begins; or why there is none."""
    if not _VERSION.match(data, at):
        return "version line"
    # Line by line, as the next version line has no colon: noise is scanned once, however many such lines it has.
    fields: dict[str, str] = {}
    here, last = data.find(b"\r\n", at) + 2, ""
    while (stop := data.find(b"\r\n", here)) > here:
        name, colon, value = data[here:stop].partition(b":")
        if last and data[here : here + 1] in (b" ", b"\t"):  # a folded line goes on with the one before
            fields[last] = f"{fields[last]} {data[here:stop].decode('utf-8', 'replace').strip()}".strip()
        elif not colon:
            return "headers"
        else:
            last = name.decode("latin-1").strip().lower()
            fields[last] = value.decode("utf-8", "replace").strip()
        here = stop + 2
    size = _length_of(fields.get("content-length", ""))
    if stop < 0 or size is None or not fields.get("warc-type"):
        return "headers"
    begin, end = here + 2, here + 2 + size
    if data[end : end + len(_END)] != _END:
        return "record end"
    block = data[begin:end]
    kind = fields["warc-type"]
    payload = block.partition(_END)[2] if fields.get("content-type", "").startswith("application/http") else block
    said = fields.get("warc-payload-digest", "")
    if kind == "revisit":
        n, digest, payload = _length_of(fields.get("warc-payload-length") or "0"), said.removeprefix("sha1:"), None
        if n is None:
            return "headers"
    elif not _agrees(said, payload):
        return "payload digest"
    else:
        n, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    record = {
        "record_type": kind,
        "record_id": fields.get("warc-record-id"),
        "page_id": _page_of(fields.get("warc-record-id")),
        "uri": fields.get("warc-target-uri"),
        "payload_bytes": n,
        "payload_digest": digest,
        "refers_to": _page_of(fields.get("warc-refers-to")),
        "payload": payload,
    }
    return record, end + len(_END)


def _unpack(data: bytes, at: int) -> tuple[bytes, int | None]:
    """What the gzip member at a place unpacks to, and where it ends; None if it breaks off or is damaged, after what unpacks before that."""
    z, parts, here = zlib.decompressobj(31), [], at
    for size in (65536, 256, 1):  # a piece that fails is tried again in smaller ones, as it gives nothing back
        while not z.eof and here < len(data):
            before = z.copy()
            try:
                parts.append(z.decompress(data[here : here + size]))
            except zlib.error:
                z = before
                break
            here = min(len(data), here + size)
        if z.eof:
            return b"".join(parts), here - len(z.unused_data)
        if here == len(data):
            parts.append(z.flush())
            break
    return b"".join(parts), None


def _inner(plain: bytes) -> Iterator[dict]:
    """Records and gaps of a member's unpacked bytes, in order."""
    at, gap, reason = 0, None, ""
    while at < len(plain):
        found = _parse_plain(plain, at)
        if isinstance(found, str):
            if gap is None:
                gap, reason = at, found
            later = _VERSION.search(plain, at + 1)
            at = later.start() if later else len(plain)
            continue
        if gap is not None:
            yield {"kind": "gap", "reason": reason, "inner_offset": gap, "inner_length": at - gap}
            gap = None
        yield {"kind": "record", **found[0], "inner_offset": at, "inner_length": found[1] - at}
        at = found[1]
    if gap is not None:
        yield {"kind": "gap", "reason": reason, "inner_offset": gap, "inner_length": len(plain) - gap}


def salvage(data: bytes) -> Iterator[dict]:
    """Records and gaps of an archive's bytes, in order; together their ranges cover all of it."""
    at, gap, reason, held = 0, None, "", []  # held: records of a damaged member, whose range ends where the gap does

    def closed(end: int) -> Iterator[dict]:
        for r in held:
            yield {"offset": gap, "length": end - gap, **r}
        yield {"kind": "gap", "offset": gap, "length": end - gap, "reason": reason} | ({"inner_offset": held[-1]["inner_offset"] + held[-1]["inner_length"]} if held else {})

    while at < len(data):
        rows, end, why = [], None, ""
        if data.startswith(b"\x1f\x8b", at):
            plain, end = _unpack(data, at)
            rows = list(_inner(plain))
            while end is None and rows and rows[-1]["kind"] == "gap":  # what the damage left of a record
                why = rows.pop()["reason"]
            why = "gzip member" if end is None else rows[0].get("reason", "") if rows else "empty member"
            good = any(r["kind"] == "record" for r in rows)
        else:
            found = _parse_plain(data, at)
            good = not isinstance(found, str)
            why, rows, end = (found, [], None) if isinstance(found, str) else ("", [{"kind": "record", **found[0]}], found[1])
        if good and end is not None:
            if gap is not None:
                yield from closed(at)
                gap, held = None, []
            for r in rows:
                yield {"offset": at, "length": end - at, **r}
            at = end
            continue
        if good and gap is not None:
            yield from closed(at)
            gap, held = None, []
        if gap is None:
            gap, reason, held = at, why, rows if good else []
        later = _START.search(data, at + 1)
        at = later.start() if later else len(data)
    if gap is not None:
        yield from closed(len(data))


def _read(with_payload: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                found = []
                held = 0
                for r in salvage(content):
                    found.append({**r, "file": path} | ({} if with_payload else {"payload": None}))
                    held += r["length"] if with_payload else 0
                    if len(found) >= 1000 or held >= 1 << 20:
                        yield _frame(found)
                        found, held = [], 0
                if found:
                    yield _frame(found)

    return run


def _frame(records: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(records, columns=_FIELDS)
    for c in ("page_id", "payload_bytes", "refers_to", "inner_offset", "inner_length"):
        out[c] = pd.array([None if v is None or pd.isna(v) else int(v) for v in (r.get(c) for r in records)], "Int64")
    return out.astype({c: object for c in ("reason", "record_type", "record_id", "uri", "payload_digest", "payload")})


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records (kind "record") and quarantined byte ranges (kind "gap") of the archives under path. An archive is one row on its way, so of 2 GB at most."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(lean(_read(payload)), RECORD)


def query(spark, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark, 'warc').path}/archives"
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_warc(spark, path, payload=False).filter("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_GROUPS = ", ".join(f"CAST('0x' || substr(h, {1 + 5 * k}, 5) AS BIGINT)" for k in range(8))
ORACLE = f"""
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS latest FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((g >> 15) & 31 AS INTEGER) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((g >> 10) & 31 AS INTEGER) + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((g >> 5) & 31 AS INTEGER) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(g & 31 AS INTEGER) + 1, 1) FOR g IN [{_GROUPS}]], '') AS payload_digest,
  CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id < latest THEN latest END AS refers_to
FROM m
"""
