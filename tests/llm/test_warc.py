import base64
import gzip
import hashlib
import random

import pytest

from probefleet.llm import warc as W
from probefleet.session import shared_folder


def brute(pages, least=0):
    data = [(p, (h or "").encode()) for p, h in pages]
    first = {}
    for p, d in data:
        if p is not None and (d not in first or p < first[d]):
            first[d] = p
    out = []
    for p, d in data:
        copies = sum(x == d for _, x in data)
        revisit = len(d) >= least and copies > 1 and d in first and p != first[d]
        sha = base64.b32encode(hashlib.sha1(d).digest()).decode()
        out.append((p, len(d), sha, "revisit" if revisit else "response", first[d] if revisit else None))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def frame(spark, pages):
    data = [(p, f"http://h/é {p}", h) for p, h in pages]
    return spark.createDataFrame(data, "page_id long, url string, html string").selectExpr("*", "1 as n", "'x' as sha", "2 as first")


def test_corpus_round_trip(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = brute([(r.page_id, r.html) for r in pages.select("page_id", "html").collect()])
    assert rows(W.archive_pages(pages)) == want


@pytest.mark.parametrize("least", [0, 3])
def test_copies_nulls_and_repeated_rows(spark, least):
    big = "".join(chr(97 + i * i % 26) for i in range(3_000_000))
    pages = [(5, "<p>a</p>"), (3, "<p>a</p>"), (9, "<p>a</p>"), (9, "<p>a</p>"), (1, None), (2, ""), (4, "é"), (6, "é"),
             (7, big), (8, big), (None, "<p>a</p>"), (None, "only"), (10, "\r\n\r\nWARC/1.1\r\n")]
    assert rows(W.archive_pages(frame(spark, pages), least)) == brute(pages, least)
    assert rows(W.archive_pages(frame(spark, pages).limit(0))) == []


def test_archives_hold_whole_payloads(spark):
    pages = [(i, f"<html>{i % 5} ü\n</html>") for i in range(20)]
    folder = shared_folder(spark, "warc-test")
    written = W.write_archives(W.with_revisits(frame(spark, pages)), folder, archive_bytes=600).collect()
    assert sum(r.records for r in written) == 20 and len(written) > 4
    back = W.read_archives(spark, folder).collect()
    assert len(back) == 20 and all(r.gap_from is None for r in back)
    assert {r.page_id: r.payload for r in back if r.record_type == "response"} == dict(pages[:5])
    assert all(r.refers_to == r.page_id % 5 and r.payload is None for r in back if r.record_type == "revisit")
    named = spark.createDataFrame(written[:1])
    assert W.read_archives(spark, folder, named).count() == written[0].records


def records(n):
    return [W.record(i, f"http://h/{i}", (f"page {i} " * 30).encode(), None, "2020-01-01T00:00:00Z") for i in range(n)]


def ids(found):
    return [x.page_id for x in found if isinstance(x, W.Record)]


def gaps(found):
    return [x[:2] for x in found if isinstance(x, tuple)]


@pytest.mark.parametrize("pack", [bytes, gzip.compress])
def test_salvage_damaged_records(pack):
    parts = [pack(r) for r in records(6)]
    clean = b"".join(parts)
    assert ids(W.salvage(clean)) == list(range(6)) and not gaps(W.salvage(clean))
    starts = [sum(map(len, parts[:i])) for i in range(7)]
    for damaged in range(6):
        data = bytearray(clean)
        middle = (starts[damaged] + starts[damaged + 1]) // 2
        data[middle : middle + 20] = bytes(b ^ 0x55 for b in data[middle : middle + 20])
        found = list(W.salvage(bytes(data)))
        assert ids(found) == [i for i in range(6) if i != damaged]
        assert gaps(found) == [(starts[damaged], starts[damaged + 1])]
    cut = list(W.salvage(clean[: starts[5] + 30]))
    assert ids(cut) == list(range(5)) and gaps(cut) == [(starts[5], starts[5] + 30)]
    junk = b"\x1f\x8b\x08junk WARC/1.1\r\nno"
    mixed = list(W.salvage(junk + parts[0] + junk + parts[1] + junk))
    assert ids(mixed) == [0, 1] and len(gaps(mixed)) == 3


def test_salvage_never_loses_bytes():
    rng = random.Random(4)
    clean = b"".join(gzip.compress(r) for r in records(8))
    for _ in range(40):
        data = bytearray(clean)
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(data))
            del data[at : at + rng.randint(0, 40)]
            data[at:at] = rng.randbytes(rng.randint(0, 40))
        found = list(W.salvage(bytes(data)))
        assert all(a < b for a, b in gaps(found)) and set(ids(found)) <= set(range(8)) and len(ids(found)) >= 3
    assert list(W.salvage(b"")) == []


def test_damaged_archive_in_a_folder(spark, tmp_path):
    parts = [gzip.compress(r) for r in records(3)]
    parts[1] = parts[1][:-6] + bytes(6)
    (tmp_path / "a.warc.gz").write_bytes(b"".join(parts))
    (tmp_path / "b.warc.gz").write_bytes(b"")
    found = W.read_archives(spark, str(tmp_path)).collect()
    assert sorted(r.page_id for r in found if r.gap_from is None) == [0, 2]
    (gap,) = (r for r in found if r.gap_from is not None)
    assert (gap.name, gap.gap_from, gap.gap_to) == ("a.warc.gz", len(parts[0]), len(parts[0]) + len(parts[1])) and gap.reason


def foreign(kind, block, record_id="urn:uuid:4f1c", **headers):
    lines = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": "2020-01-01T00:00:00Z", **headers}
    head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in lines.items())
    return f"WARC/1.0\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def foreign_archive():
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n<p>no length</p>"
    sha = hashlib.sha1(http).hexdigest()
    return [
        foreign("warcinfo", b"software: some crawler\r\n", Content_Type="application/warc-fields"),
        foreign("request", b"GET / HTTP/1.1\r\nHost: h\r\n\r\n", "urn:uuid:2", Content_Type="application/http; msgtype=request"),
        foreign("response", http, "urn:uuid:3", Content_Type="application/http;msgtype=response", WARC_Block_Digest=f"sha1:{sha}"),
        foreign("metadata", b"outlink: http://h/x", "urn:uuid:4", WARC_Block_Digest="blake3:unknown"),
        foreign("conversion", "ü text".encode(), "urn:uuid:5", WARC_Payload_Digest=f"sha1:{W.digest('ü text'.encode())}"),
    ]


KINDS = ["warcinfo", "request", "response", "metadata", "conversion"]


@pytest.mark.parametrize("pack", [lambda rs: b"".join(map(gzip.compress, rs)), lambda rs: gzip.compress(b"".join(rs)), b"".join])
def test_archives_of_other_writers(pack):
    """A member for each record, all in one member, or not compressed at all."""
    found = list(W.salvage(pack(foreign_archive())))
    assert [r.record_type for r in found] == KINDS and not gaps(found)
    assert [r.page_id for r in found] == [None] * 5 and found[2].record_id == "<urn:uuid:3>"
    assert found[2].payload == b"<p>no length</p>" and found[4].payload.decode() == "ü text"


def test_damage_inside_a_member_of_several_records():
    parts = foreign_archive()
    parts[2] = parts[2].replace(b"no length", b"no lengtx")
    data = gzip.compress(b"".join(parts))
    found = list(W.salvage(data))
    assert [r.record_type for r in found if isinstance(r, W.Record)] == [k for k in KINDS if k != "response"]
    assert gaps(found) == [(0, len(data))]


def test_folders_have_a_file_system(spark):
    assert W.qualified(spark, "/shared/x") == "file:///shared/x" and W.qualified(spark, "s3a://b/x") == "s3a://b/x"
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    try:
        conf.set("fs.defaultFS", "hdfs://name:8020")
        assert W.qualified(spark, "/shared/x") == "hdfs://name:8020/shared/x"
    finally:
        conf.set("fs.defaultFS", before)
