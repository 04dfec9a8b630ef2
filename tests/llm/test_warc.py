import gzip
import random
import zlib
from pathlib import Path

import pytest

from riskloom.llm import warc as W


def pages(n):
    return [(i, f"http://h/{i}", f"<p>page {i} " + "x" * (i * 37 % 900) + "</p>") for i in range(n)]


def read(raw):
    out = list(W.salvage(raw))
    return [x for x in out if isinstance(x, W.Record)], [x for x in out if isinstance(x, W.Gap)]


def test_clean_archives_of_both_kinds():
    for gz in (True, False):
        raw = b"".join(W.member(*p, gzip=gz) for p in pages(20))
        records, gaps = read(raw)
        assert not gaps and [r.block.decode() for r in records] == [p[2] for p in pages(20)]
        assert records[0].start == 0 and records[-1].end == len(raw)


def test_each_damage_loses_one_record_and_its_bytes_are_a_gap():
    for gz in (True, False):
        for how in range(4):
            parts = [W.member(*p, gzip=gz) for p in pages(9)]
            parts[4] = W.damaged(parts[4], how)
            before = sum(map(len, parts[:4]))
            records, gaps = read(b"".join(parts))
            assert [r.headers["warc-record-id"] for r in records] == [f"<urn:page:{i}>" for i in range(9) if i != 4], (gz, how)
            assert [(g.start, g.end) for g in gaps] == [(before, before + len(parts[4]))] and gaps[0].reason


def test_records_and_gaps_cover_the_file_against_brute_force():
    parts, good = [], []
    for p in pages(120):
        raw = W.member(*p, gzip=p[0] % 3 > 0)
        if zlib.crc32(str(p[0]).encode()) % 5 == 0:
            raw = W.damaged(raw, p[0] % 4)
        else:
            good.append(p[0])
        parts.append(raw)
    raw = b"".join(parts)
    spans = []
    for x in W.salvage(raw):
        spans.append((x.start, x.end))
    assert spans[0][0] == 0 and spans[-1][1] == len(raw) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert [int(r.headers["warc-record-id"][10:-1]) for r in read(raw)[0]] == good


def test_version_line_inside_a_block_is_not_a_record_of_its_own():
    inner = W.member(7, "http://in", "inner", gzip=False).decode()
    records, gaps = read(W.member(1, "http://out", inner, gzip=False))
    assert len(records) == 1 and not gaps


def test_digest_and_length_are_checked():
    good = W.member(1, "u", "hello world", gzip=False)
    for bad in (good.replace(b"hello", b"jello"), good.replace(b"Content-Length: 11", b"Content-Length: 10"), good.replace(b"Content-Length: 11", b"Content-Length: x")):
        records, gaps = read(bad + good)
        assert len(records) == 1 and (gaps[0].start, gaps[0].end) == (0, len(bad))
    assert read(gzip.compress(b"not a record"))[1][0].reason


def test_long_headers_are_read_to_their_end():
    url = "data:text/plain," + "x" * 200_000
    for gz in (True, False):
        records, gaps = read(W.member(1, url, "a", gzip=gz) + W.member(2, "u", "b", gzip=gz))
        assert not gaps and [r.headers["warc-target-uri"] for r in records] == [url, "u"]


def test_valid_records_of_a_damaged_member_are_salvaged():
    plain = [W.member(i, f"u{i}", "".join(chr(97 + (i * 7 + k * k) % 26) for k in range(400)) + str(i), gzip=False) for i in range(60)]
    ids = lambda records: [int(r.headers["warc-record-id"][10:-1]) for r in records]
    last = W.member(99, "z", "last")
    # One record is bad in an intact member.
    bad = gzip.compress(b"".join([*plain[:5], plain[5].replace(b"Content-Length: 4", b"Content-Length: 9"), *plain[6:]]))
    records, gaps = read(bad + last)
    assert ids(records) == [i for i in range(60) if i != 5] + [99] and [(g.start, g.end) for g in gaps] == [(len(bad), len(bad))]
    # The stream breaks off, at the end of the file or before another member.
    whole = gzip.compress(b"".join(plain))
    for tail in (b"", last):
        cut = whole[: len(whole) // 2]
        records, gaps = read(cut + tail)
        got = ids(records)
        assert 5 < len(got) < 60 and got[: len(got) - bool(tail)] == list(range(len(got) - bool(tail))) and (not tail or got[-1] == 99)
        assert [(g.start, g.end) for g in gaps] == [(0, len(cut))]
    # A header altered under a wrong checksum can't be told from a good one.
    one = gzip.compress(plain[0].replace(b"u0", b"u1"), mtime=0)[:-8] + gzip.compress(plain[0], mtime=0)[-8:]
    records, gaps = read(one + last)
    assert ids(records) == [99] and [(g.start, g.end) for g in gaps] == [(0, len(one))]


def test_query_against_brute_force(spark):
    rows = pages(300)
    df = spark.createDataFrame([(*p, "clash") for p in rows], "page_id long, url string, html string, kind string").repartition(3)
    out = W.recovered_pages(W.salvage_archives(W.archive(df, 16, spoil_every=6))).collect()
    spoilt = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 6 == 0}
    assert sorted((r["page_id"], r["url"], r["html"]) for r in out if r["kind"] == "record") == [p for p in rows if p[0] not in spoilt]
    assert spoilt and sum(r["kind"] == "gap" for r in out) <= len(spoilt)


def test_edges(spark):
    df = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", ""), (2, None, "é" * 300_000)], "page_id long, url string, html string")
    out = W.recovered_pages(W.salvage_archives(W.archive(df))).collect()
    assert sorted((r["page_id"] or 0, r["url"] or "", len(r["html"])) for r in out) == [(0, "", 0), (1, "u", 0), (1, "u", 0), (2, "", 300_000)]
    files = spark.createDataFrame([("a", None), ("b", b""), ("c", b"garbage")], "path string, content binary")
    assert [(r["path"], r["kind"], r["length"]) for r in W.salvage_archives(files).collect()] == [("c", "gap", 7)]
    assert W.salvage_archives(files.limit(0)).count() == 0


def test_files_on_disk(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"".join(W.member(*p) for p in pages(3)) + b"tail")
    out = W.read_warc(spark, str(tmp_path)).collect()
    assert [r["kind"] for r in out] == ["record"] * 3 + ["gap"]


@pytest.mark.parametrize("span", [700, 3000, 10**6])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ranges_give_what_whole_files_give(spark, tmp_path, span, seed):
    r = random.Random(seed)
    for f in range(4):
        parts = []
        for i in range(40):
            html = "".join(r.choices("abcdef <p>", k=r.choice([5, 200, 2500])))
            if f == 3 and i % 9 == 4:  # an archive within a record
                html = b"".join(W.member(900 + j, "http://in", "x" * 300, gzip=False) for j in range(6)).decode()
            x = W.member(i, f"http://x/{i}", html, gzip=f == 1 or (f == 2 and i % 2 == 0))
            parts.append(W.damaged(x, r.randrange(4)) if r.random() < 0.2 else x)
            if r.random() < 0.1:
                parts.append(r.choice([b"garbage " * 200, b"WARC/1.0\r\nno end " * 9, b"\x1f\x8b\x08" * 300]))
        (tmp_path / f"a{f}.warc").write_bytes(b"".join(parts))
    (tmp_path / "empty.warc").write_bytes(b"")
    (tmp_path / "junk.warc").write_bytes(b"z" * 5000)
    got = sorted((Path(x["path"]).name, x["start"], x["length"], x["kind"], x["reason"], x["record_id"], bytes(x["block"] or b"")) for x in W.read_warc(spark, str(tmp_path), span, 64).collect())
    want = []
    for p in tmp_path.iterdir():
        for x in W.salvage(p.read_bytes()):
            want.append((p.name, x.start, x.end - x.start, "gap", x.reason, None, b"") if isinstance(x, W.Gap) else (p.name, x.start, x.end - x.start, "record", None, x.headers.get("warc-record-id"), x.block))
    key = lambda t: tuple(map(str, t))
    assert sorted(got, key=key) == sorted(want, key=key) and len(want) > 100
