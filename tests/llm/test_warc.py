import gzip
import hashlib
import os
from collections import Counter

from claimloom.llm import warc as W

LONG = "é" * 60
ROWS = [
    (5, "http://a/?q=1 2\r\nX: y", LONG), (3, None, LONG), (9, "http://b/ü", LONG), (3, None, LONG), (None, "u", LONG),
    (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", "z" * 100), (8, "u", "z" * 99), (10, "u", "z" * 99), (11, "u", "\x1f\u008b\x08 WARC/1.0\r\n\r\n" * 20000), (12, "u", "z" * 100),
]


def brute(rows):
    out, least = [], {}
    for p, _, t in rows:
        if p is not None:
            b = (t or "").encode()
            least[b] = min(p, least.get(b, p))
    for p, _, t in rows:
        b = (t or "").encode()
        first = least.get(b) if len(b) >= 100 and p != least.get(b) else None
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "response" if first is None else "revisit", first))
    return Counter(out)


def test_round_trip_in_small_ranges(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as n")
    files = W.write(W.with_revisits(pages.repartition(2)), f"file://{tmp_path}/w", file_bytes=400)
    assert len(files) > 2 and all(os.path.getsize(f.removeprefix("file://")) == n for f, n in files)
    assert not [x for x in os.listdir(tmp_path / "w") if x.startswith(".") and not x.endswith(".crc")]
    for step in (7, 100, 1 << 20):
        got = W.read(spark, files, range_bytes=step).collect()
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == brute(ROWS)
    texts = {r.page_id: bytes(r.payload).decode() for r in got if r.record_type == "response" and r.page_id}
    assert texts[11] == ROWS[12][2] and texts[4] == ""
    assert {r.target_uri for r in got if r.page_id == 5} == {"http://a/?q=1%202%0D%0AX:%20y"}


def test_real_rows_and_empty(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    assert Counter(tuple(r)[:5] for r in W.report(pages).collect()) == brute(rows)
    assert W.report(pages.limit(0)).count() == 0


def test_damage_costs_only_its_records():
    parts = [W._member("response", i, "u", b"x%d" % i, 2, "d", None, "t") for i in range(4)]
    bad = bytearray(parts[1])
    bad[len(bad) // 2] ^= 0xFF
    data = b"junk\x1f\x8b\x08junk" + parts[0] + bytes(bad) + gzip.compress(b"not a record") + parts[2] + parts[3][:-9]
    got = [f["warc-record-id"] for _, f in W.members(data, len(data), lambda n: data)]
    assert got == ["<urn:page:0>", "<urn:page:2>"]
