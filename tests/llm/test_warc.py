import gzip
import io
import json
import random
import zlib
from pathlib import Path

import pytest

from py4j.protocol import Py4JJavaError

from brindle.errors import ConfigError
from brindle.llm import warc
from brindle.session import shared_folder

SCHEMA = "page_id bigint, url string, html string, payload string"


def monolith(pages):
    return gzip.compress(b"".join(warc.record(i, f"http://x/{i}", p, None, False) for i, p in pages))


def normalized(data, level=6):
    out = io.BytesIO()
    return warc.normalize(io.BytesIO(data).read, out.write, level), out.getvalue()


def test_normalizing_keeps_every_byte_and_indexes_members(monkeypatch):
    rng = random.Random(1)
    pages = [(i, bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 50, 3000]))) + b"\r\n\r\n" * (i % 3)) for i in range(60)]
    data = monolith(pages)
    for chunk in (7, 100, 1 << 20):
        monkeypatch.setattr(warc, "CHUNK", chunk)
        index, out = normalized(data)
        assert zlib.decompressobj(31).decompress(data) == b"".join(zlib.decompress(out[o : o + n], 31) for o, n, _, _ in index)
        assert [o for o, *_ in index] == [0, *[o + n for o, n, *_ in index[:-1]]] and index[-1][0] + index[-1][1] == len(out)
        for (i, p), (o, n, name, kind) in zip(pages, index, strict=True):
            got = warc.parse(zlib.decompress(out[o : o + n], 31))
            assert name == f"<urn:page:{i}>" and kind == "response"
            assert got == (i, f"http://x/{i}", len(p), warc.digest(p), "response", None, True)
        again, same = normalized(out)  # a file that has members already
        assert same == out and again == index


def test_broken_streams():
    data = monolith([(1, b"abc" * 5000), (2, b"d")])
    plain = gzip.decompress(data)
    for bad in (data[:-30], gzip.compress(plain[:-3]), gzip.compress(b"no record\r\n\r\n"), gzip.compress(b"x" * 200000), gzip.compress(plain.replace(b"Content-Length: 15", b"Content-Length: 16", 1))):
        with pytest.raises((ValueError, zlib.error)):
            normalized(bad)
    assert normalized(gzip.compress(b"")) == ([], b"")


def test_long_urls(monkeypatch):
    urls = ["http://x/" + "é" * n for n in (1, 33_000, 70_000, 400_000, 2)]
    data = gzip.compress(b"".join(warc.record(i, u, b"abc", None, False) for i, u in enumerate(urls)))
    for chunk in (5000, 1 << 20):
        monkeypatch.setattr(warc, "CHUNK", chunk)
        index, out = normalized(data)
        got = [warc.parse(zlib.decompress(out[o : o + n], 31)) for o, n, _, _ in index]
        assert [(g[0], len(g[1]), g[6]) for g in got] == [(i, 9 + 6 * (len(u) - 9), True) for i, u in enumerate(urls)]


def brute(rows, least):
    first = {}
    for i, _, h in rows:
        p = (h or "").encode()
        first.setdefault(p, []).append(i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        low = min((x for x in first[p] if x is not None), default=None)
        revisit = len(p) >= least and low is not None and i != low
        out.append((i, len(p), warc.digest(p), "revisit" if revisit else "response", low if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 5])
def test_pages_against_brute_force(spark, least):
    rng = random.Random(2)
    texts = ["", None, "abc", "<p>é", "<p>" + "long " * 40000] + [f"page {i}" for i in range(30)]
    rows = [(i, None if i % 7 == 0 else f"http://h/{i}?q=a b\r\nX: y", rng.choice(texts)) for i in range(150)] + [(3, "u", "same"), (3, "u", "same"), (None, "u", "same"), (None, "u", "no id")]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    assert sorted((tuple(r) for r in warc.archived(df, least).collect()), key=repr) == brute(rows, least)


def test_files_on_disk(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://h/{i}", f"text {i % 4}", "x") for i in range(20)], SCHEMA).repartition(2)
    folder = f"file://{tmp_path}/w"
    whole = warc.write_archives(warc.roles(df), folder, archive_bytes=30)
    assert all(len(zlib.decompressobj(31).decompress(Path(r["path"]).read_bytes()).split(b"WARC/1.1\r\n")) == r["records"] + 1 for r in whole.collect())
    single = warc.normalize_archives(whole, f"{folder}/n")
    assert sum(r["records"] for r in single.collect()) == 20
    for r in single.collect():
        assert len([json.loads(x) for x in Path(r["index"]).read_text().splitlines()]) == r["records"]
        assert gzip.decompress(Path(r["path"]).read_bytes()).count(b"WARC/1.1") == r["records"]
    assert warc.read_archives(single, folder).filter("sound").count() == 20


def test_where_archives_go(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://h/{i}", "", "x") for i in range(300)], SCHEMA).repartition(1)
    top = Path(shared_folder(spark).removeprefix("file://"))
    before = {p.name for p in top.iterdir()} if top.exists() else set()
    assert warc.archived(df).count() == 300
    assert [p.split("-")[0] for p in {p.name for p in top.iterdir()} - before] == ["records"]
    assert warc.archived(df, folder=f"{tmp_path}/kept").count() == 300
    assert list((tmp_path / "kept" / "records").glob("*.idx")) and not (tmp_path / "kept" / "streams").exists()
    many = warc.write_archives(warc.roles(df), f"file://{tmp_path}/small", archive_bytes=10_000)
    assert many.count() > 5  # empty payloads fill archives, too
    for wrong in ("viewfs://cluster/x", "nothing://x/y"):
        with pytest.raises((ConfigError, Py4JJavaError)):
            warc.archived(df, folder=wrong)


def test_empty(spark):
    assert warc.archived(spark.createDataFrame([], SCHEMA)).collect() == []
