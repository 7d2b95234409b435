import gzip
import zlib
from collections import Counter

import pytest

from quernel.llm import warc


def test_normaliser_round_trip():
    rs = [warc.record("response", i, f"http://h/{i}", p, warc.digest(p), None, len(p)) for i, p in enumerate([b"", b"a\r\n\r\nb" * 1000, b"WARC/1.1\r\nContent-Length: 3\r\n\r\n", bytes(range(256))])]
    whole = gzip.compress(b"".join(rs))
    members = list(warc.normalise(iter([whole[i : i + 7] for i in range(0, len(whole), 7)])))
    content = b"".join(m for m, *_ in members)
    assert gzip.decompress(content) == b"".join(rs)
    assert [gzip.decompress(content[o : o + n]) for _, o, n, _ in members] == rs
    # archives that already have a member a record come out alike
    assert [m for m, *_ in warc.normalise(iter([content]))] == [m for m, *_ in members]
    with pytest.raises(ValueError):
        list(warc.normalise(iter([gzip.compress(rs[1][:-9])])))


@pytest.mark.parametrize("least", [0, 3])
def test_pages(spark, least):
    rows = [(1, "u1", "aaa"), (2, "u2", "aaa"), (9, None, "aaa"), (3, "u\r\n3", "é"), (4, "u4", None), (5, "u5", ""), (6, "u6", "x" * 300_000), (None, "n", "aaa"), (7, "u7", "b"), (7, "u7", "b")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, body string")
    got = warc.round_trip(pages, least, archive_bytes=1000).collect()
    pay = [(r[2] or "").encode() for r in rows]
    want = Counter()
    for (i, *_), p in zip(rows, pay):
        same = [r[0] for r, q in zip(rows, pay) if q == p and r[0] is not None]
        revisit = len(p) >= least and i != max(same)
        want[(i, len(p), warc.digest(p), "revisit" if revisit else "response", max(same) if revisit else None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all(bytes(r.body) == (b"" if r.record_type == "revisit" else pay[[x[0] for x in rows].index(r.page_id)]) for r in got)


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_streams_that_end_early(tmp_path):
    rs = [warc.record("response", i, "u", b"x" * 50, warc.digest(b"x" * 50), None, 50) for i in range(3)]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    first = z.compress(rs[0]) + z.flush(zlib.Z_FULL_FLUSH)  # ends at a record's end, inside the member
    whole = first + z.compress(rs[1] + rs[2]) + z.flush()
    assert b"".join(warc.records(warc.inflate(iter([whole])))) == b"".join(rs)
    for cut in (first, whole[:-1], whole[:-9], whole + gzip.compress(rs[0])[:-4], gzip.compress(rs[0] + rs[1][:70])):
        with pytest.raises(ValueError):
            list(warc.records(warc.inflate(iter([cut]))))
    assert list(warc.records(warc.inflate(iter([])))) == []


def test_output_of_inflate_is_bounded():
    pieces = list(warc.inflate(iter([gzip.compress(bytes(50 << 20))])))
    assert sum(map(len, pieces)) == 50 << 20 and max(map(len, pieces)) <= warc.PIECE


def test_files(tmp_path):
    rs = [warc.record("response", i, "http://h/", b"y" * i * 1000, warc.digest(b"y" * i * 1000), None, i * 1000) for i in range(40)]
    assert len({warc.parse(r)[0]["WARC-Record-ID"] for r in rs}) == 40
    assert all({"WARC-Type", "WARC-Date", "WARC-Record-ID", "Content-Length"} <= warc.parse(r)[0].keys() for r in rs)
    source, target = f"{tmp_path}/a.warc.gz", f"file://{tmp_path}/b.warc.gz"
    with open(source, "wb") as f:
        f.write(gzip.compress(b"".join(rs)))
    assert warc.normalise_file(source, target) == 40
    content = (tmp_path / "b.warc.gz").read_bytes()
    index = list(warc.read_index(target))
    assert gzip.decompress(content) == b"".join(rs) and [gzip.decompress(content[o : o + n]) for o, n, _ in index] == rs
    assert [name for *_, name in index] == [warc.parse(r)[0]["WARC-Record-ID"] for r in rs]
