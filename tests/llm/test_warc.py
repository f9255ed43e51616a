import base64
import gzip
import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrywork.llm import warc
from quarrywork.llm.scratch import Scratch

SCHEMA = "page_id bigint, url string, html string, payload string"
PAGES = [(1, "http://a/x y", "<p>one</p>", "?"), (2, None, "<p>one</p>", "?"), (3, "u\r\nv", "é\r\n\r\nWARC/1.1\r\nfake", "?"), (4, "", None, "?"), (5, "u", "", "?"), (None, "n", "<p>one</p>", "?"), (2, "u", "<p>one</p>", "?"), (6, "u", "x" * 100_000, "?")]


def _archive(spark, rows, name):
    path = f"{Scratch(spark, name).path}/a"
    warc.write_warc(spark.createDataFrame(rows, SCHEMA), path, file_bytes=2000)
    return path


def test_round_trip(spark):
    path = _archive(spark, PAGES, "warc1")
    rows = warc.read_warc(spark, path).collect()
    assert len(rows) == len(PAGES) and all(r.kind == "record" for r in rows)
    latest = {}
    for p, _, h, _ in PAGES:
        latest[h or ""] = max(latest.get(h or "", -1), -1 if p is None else p)
    for r in rows:
        html = next(h or "" for p, _, h, _ in PAGES if p == r.page_id)
        assert r.payload_bytes == len(html.encode())
        assert r.payload_digest == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        if r.page_id is not None and r.page_id < latest[html]:
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", latest[html], None)
        else:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, html.encode())


def _record(page, payload):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest())
    return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % (page, digest, len(block)) + block + b"\r\n\r\n"


def _covers(data, found):
    at = 0
    for r in sorted({(r["offset"], r["length"]) for r in found}):
        assert r[0] == at
        at += r[1]
    assert at == len(data)


def test_salvage_plain():
    good = [_record(k, b"payload %d" % k) for k in range(5)]
    cases = {
        "digest": good[0] + good[1].replace(b"payload 1", b"paxload 1") + good[2],
        "length": good[0] + good[1].replace(b"Content-Length: ", b"Content-Length: 9") + good[2],
        "garbage": good[0] + b"\x1f\x8b\x08 junk WARC/1.1 more" + good[2],
        "truncated": good[0] + good[1][:-20] + good[2],
    }
    for data in cases.values():
        found = list(warc.salvage(data))
        assert [r["page_id"] for r in found if r["kind"] == "record"] == [0, 2]
        assert sum(r["kind"] == "gap" for r in found) == 1
        _covers(data, found)
    tail = list(warc.salvage(good[0] + b"rest"))
    assert [(r["kind"], r["length"]) for r in tail] == [("record", len(good[0])), ("gap", 4)]
    assert list(warc.salvage(b"")) == []


def test_salvage_members():
    members = [gzip.compress(_record(k, b"m%d" % k * 50_000)) for k in range(4)]
    broken = members[1][:30] + b"\xff" * 20 + members[1][50:]
    data = members[0] + broken + members[2] + members[3][: len(members[3]) // 2]
    found = list(warc.salvage(data))
    assert [r["page_id"] for r in found if r["kind"] == "record"] == [0, 2]
    assert [r["kind"] for r in found] == ["record", "gap", "record", "gap"]
    _covers(data, found)


def test_no_pages(spark):
    assert warc.read_warc(spark, _archive(spark, [], "warc2")).count() == 0


def test_base32(spark):
    row = spark.range(1).select(warc.base32(F.sha1(F.lit("abc").cast("binary"))).alias("x")).first()
    assert row.x == base64.b32encode(hashlib.sha1(b"abc").digest()).decode()


def _revisit(page, length=b"12"):
    return b"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:page:%d>\r\nWARC-Payload-Length: %s\r\nContent-Length: 0\r\n\r\n\r\n\r\n" % (page, length)


def test_lengths_that_are_no_number_are_quarantined():
    good = [_record(k, b"payload %d" % k) for k in range(2)]
    odd = ["abc", "²", "9" * 5000, "-1", "1_0", "+3", "٣"]
    bad = [_revisit(7, x.encode()) for x in odd]
    bad += [good[1].replace(b"Content-Length: ", b"Content-Length: " + x.encode()) for x in odd]
    for record in bad:
        data = good[0] + record + good[1]
        found = list(warc.salvage(data))
        _covers(data, found)
        assert [r["page_id"] for r in found if r["kind"] == "record"] == [0, 1] and sum(r["kind"] == "gap" for r in found) == 1
    assert warc._page_of(f"<urn:page:{1 << 63}>") is None and warc._page_of(f"<urn:page:-{1 << 63}>") == -(1 << 63)
    assert warc._page_of("<urn:page:" + "9" * 5000 + ">") is None


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32), st.lists(st.tuples(st.integers(0, 400), st.binary(max_size=6)), min_size=1, max_size=4))
def test_random_damage_never_stops_the_reader(seed, damage):
    rng = random.Random(seed)
    records = [_record(k, b"payload %d" % k) if k % 2 else _revisit(k) for k in range(5)]
    hurt = bytearray(records[2])
    for at, put in damage:
        at %= len(hurt)
        hurt[at : at + rng.randint(0, 6)] = put
        hurt = hurt or bytearray(b"x")
    data = b"".join([*records[:2], bytes(hurt), *records[3:]])
    found = list(warc.salvage(data))
    _covers(data, found)
    pages = [r["page_id"] for r in found if r["kind"] == "record"]
    assert pages[:2] == [0, 1] and pages[-1:] == [4]


def test_many_version_lines_are_scanned_once():
    data = b"WARC/1.1\r\n" * 200_000 + _record(1, b"x")
    assert [r["kind"] for r in warc.salvage(data)] == ["gap", "record"]


def test_members_of_many_records_give_back_all_sound_ones():
    records = [_record(k, random.Random(k).randbytes(3000)) for k in range(50)]
    hurt = [*records[:20], records[20].replace(b"urn:page:20", b"urn:page:20", 1)[:-9] + b"X" * 5 + b"\r\n\r\n", *records[21:]]
    found = list(warc.salvage(gzip.compress(b"".join(hurt))))
    assert [r["page_id"] for r in found if r["kind"] == "record"] == [k for k in range(50) if k != 20]
    (gap,) = [r for r in found if r["kind"] == "gap"]
    assert gap["reason"] == "payload digest" and gap["inner_offset"] == sum(map(len, records[:20])) and gap["inner_length"] == len(records[20])
    whole = gzip.compress(b"".join(records))
    cut = whole[: len(whole) * 9 // 10] + gzip.compress(_record(99, b"next"))
    found = list(warc.salvage(cut))
    _covers(cut, found)
    pages = [r["page_id"] for r in found if r["kind"] == "record"]
    assert pages[-1] == 99 and pages[:-1] == list(range(len(pages) - 1)) and len(pages) >= 44
    assert [r["reason"] for r in found if r["kind"] == "gap"] == ["gzip member"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from("gggb"), min_size=1, max_size=5), min_size=1, max_size=4), st.integers(0, 2**32))
def test_every_sound_record_beside_damage_comes_back(members, seed):
    rng, data, want, k = random.Random(seed), b"", [], 0
    for member in members:
        plain = b""
        for kind in member:
            record = _record(k, rng.randbytes(rng.randint(0, 300)))
            if kind == "g":
                want.append(k)
            else:
                record = record.replace(b"WARC-Type", b"WARC Type" if rng.random() < 0.5 else b"Content-Length: x\r\nWARC-Type")[: -rng.randint(5, 30)] + b"\r\n\r\n"
            plain, k = plain + record, k + 1
        data += gzip.compress(plain) if rng.random() < 0.6 else plain
    found = list(warc.salvage(data))
    assert [r["page_id"] for r in found if r["kind"] == "record"] == want
    _covers(data, found)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**32))
def test_a_damaged_member_gives_what_stands_before_and_the_rest_goes_on(seed):
    rng = random.Random(seed)
    inside = [_record(k, rng.randbytes(2000)) for k in range(6)]
    member = bytearray(gzip.compress(b"".join(inside), 1))
    at = rng.randint(12, len(member) - 1)
    member[at] ^= rng.randint(1, 255)
    data = gzip.compress(_record(100, b"a")) + bytes(member) + gzip.compress(_record(101, b"b")) + _record(102, b"c")
    found = list(warc.salvage(data))
    _covers(data, found)
    pages = [r["page_id"] for r in found if r["kind"] == "record"]
    assert pages[0] == 100 and pages[-2:] == [101, 102]
    # Random bytes hardly shrink: what lies a record and a block header before the damage unpacks.
    whole = max(0, (at - 300) // len(inside[0]))
    assert pages[1 : 1 + whole] == list(range(whole))


def test_digests_of_any_form():
    payload = b"payload 1"
    sha1, sha256 = hashlib.sha1(payload), hashlib.sha256(payload)
    b32 = base64.b32encode(sha1.digest()).decode()
    good = [f"sha1:{b32.lower()}", f"SHA-1:{sha1.hexdigest()}", sha1.hexdigest().upper(), b32, f"sha256:{sha256.hexdigest()}", f"sha-256:{base64.b32encode(sha256.digest()).decode()}", f"md5:{hashlib.md5(payload).hexdigest()}", "blake3:abc", "?", ""]
    bad = [f"sha1:{b32[1:]}A", "sha1:short", f"sha256:{'0' * 64}", "0" * 40]
    record = _record(1, payload)
    for said, kind in [(x, "record") for x in good] + [(x, "gap") for x in bad]:
        data = record.replace(b"sha1:" + b32.encode(), said.encode())
        assert [(r["kind"], r.get("payload_digest")) for r in warc.salvage(data)] == [(kind, b32 if kind == "record" else None)], said


def test_folded_headers():
    data = _record(1, b"x").replace(b"WARC-Record-ID: ", b"WARC-Record-ID:\r\n\t ")
    assert [(r["kind"], r["page_id"]) for r in warc.salvage(data)] == [("record", 1)]
