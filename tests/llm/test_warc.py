"""WARC archives against a reader by hand, with magics inside payloads and small splits."""

import glob
import hashlib

import pytest
from pyspark.sql import functions as F

from corpusgate.llm import warc

DDL = "page_id BIGINT, url STRING, html STRING, file STRING, at INT, type STRING, id INT, row INT"
FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def html_of():
    long = "<p>" + "x" * 1500 + "</p>"
    out = [None, "", "short", "short", long, long, long, "é" * 600, "é" * 600, "\r\n\r\n", "WARC/1.",
           "WARC/1.1\r\n", "a WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\nContent-Length: 9999999\r\n\r\n",
           FAKE, FAKE * 40, "x" * 3000 + FAKE * 3 + "y" * 3000, FAKE * 40, "WARC/1.1\r\nContent-Length: \r\n\r\n",
           "WARC/1.1\r\nContent-Length: 99999999999999999999\r\n\r\nz", "z" * 400000,
           "WARC/1.1\r\nContent-Length: 1500\r\n\r\n" + "WARC/1." * 900]
    return out + [f"<html>{i} {FAKE if i % 7 == 0 else ''}{'t' * (i * 37 % 900)}</html>" for i in range(60)]


def rows():
    out = [(i, f"http://a/{i}", h, None, None, None, None, None) for i, h in enumerate(html_of())]
    out += [out[4], out[6], (None, "u\r\nWARC-Type: x", html_of()[4], None, 1, "t", 5, 6),
            (None, None, "n" * 2000, None, *[None] * 4), (None, None, "n" * 2000, None, *[None] * 4)]
    return out


def by_hand(rows, least):
    top = {}
    for i, _, h, *_ in rows:
        if h is not None and i is not None:
            top[h] = max(top.get(h, -1), i)
    out = []
    for i, _, h, *_ in rows:
        body = (h or "").encode()
        keep = top.get(h) if len(body) >= least else None
        again = keep is not None and keep != i
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response",
                    keep if again else None))
    return sorted(out, key=str)


def chain(data):
    """Record offsets of an archive, read from its start."""
    at, found = 0, []
    while at < len(data):
        head = data[at:data.index(b"\r\n\r\n", at)]
        n = next(int(x[15:]) for x in head.split(b"\r\n") if x.startswith(b"Content-Length:"))
        found.append(at)
        at += len(head) + 4 + n + 4
    assert at == len(data)
    return found


@pytest.mark.parametrize("split,block", [(700, 2000), (64 << 20, 4 << 20)])
def test_round_trip(spark, split, block, tmp_path):
    pages = spark.createDataFrame(rows(), DDL).repartition(2)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        out = warc.round_trip(pages, block=block)
        assert sorted((tuple(r) for r in out.collect()), key=str) == by_hand(rows(), 1000)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_files_are_archives_and_payloads_come_back(spark, tmp_path):
    pages = spark.createDataFrame(rows(), DDL)
    path = str(tmp_path / "w")
    warc.write(pages.repartition(3), path, file_records=20)
    files = glob.glob(path + "/part-*")
    assert len(files) > 3
    want = sorted((f"file:{f}", at) for f in files for at in chain(open(f, "rb").read()))
    out = warc.read(spark, path, payloads=True, block=5000).collect()
    assert sorted((r["file"], r["at"]) for r in out) == want
    assert all(r["whole"] for r in out)
    texts = {str(i): (h or "").encode() for i, _, h, *_ in rows() if i is not None}
    for r in out:
        if r["type"] == "response" and r["id"] is not None:
            assert bytes(r["payload"]) == texts[r["id"]]
            assert r["uri"] == f"http://a/{r['id']}"
        if r["type"] == "revisit":
            assert r["payload"] is None and r["refers"] in texts
            assert hashlib.sha1(texts[r["refers"]]).hexdigest() == r["digest"]


def test_cut_and_broken_files(spark, tmp_path):
    pages = spark.createDataFrame(rows()[:30], DDL).coalesce(1)
    path = str(tmp_path / "w")
    warc.write(pages, path, min_bytes=1 << 30)
    name, = glob.glob(path + "/part-*")
    data = open(name, "rb").read()
    ends = chain(data)
    cut = tmp_path / "cut"
    cut.mkdir()
    (cut / "a.warc").write_bytes(data[:ends[20] + 300])
    (cut / "b.warc").write_bytes(data[:ends[10]] + b"rubbish" + data[ends[10]:])
    (cut / "c.warc").write_bytes(b"")
    (cut / "d.warc").write_bytes(b"no archive WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
    out = [(r["file"][-6:], r["at"], r["whole"]) for r in warc.read(spark, str(cut)).collect()]
    assert sorted(x[1] for x in out if x[0] == "a.warc") == ends[:21]
    assert [x[1] for x in out if not x[2]] == [ends[20]]
    assert sorted(x[1] for x in out if x[0] == "b.warc") == ends[:10]
    assert {x[0] for x in out} == {"a.warc", "b.warc"}


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], DDL)).count() == 0


def test_a_long_chain_takes_a_logarithm_of_rounds(spark):
    at = [0]
    for i in range(3000):
        at.append(at[-1] + 50 + i * 13 % 90)
    true = list(zip(at[:-1], at[1:]))
    false = [(a + 7, b) for a, b in true[::3]] + [(a + 9, a + 11) for a, _ in true[::5]]
    rows = [("f", a, b) for a, b in true + false]
    got = warc.reached(spark.createDataFrame(rows, "file STRING, at BIGINT, next BIGINT"), block=256)
    assert sorted(r["at"] for r in got.collect()) == at[:-1]
    assert got.where(F.col("block") != F.floor(F.col("at") / 256)).count() == 0
