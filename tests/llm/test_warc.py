import base64
import gzip
from hashlib import sha1

from tabulon.llm import warc
from tabulon.llm.files import open_store

ROWS = [(1, "http://www.a.org/x", "same"), (2, "http://b.a.org/", "same"), (3, None, None), (4, "http://a.org/x", ""),
        (5, "https://z.net:8443/p?q=1", "é" * 50000), (6, "not a url\r\n", "other"), (7, "http://a.org/x", "same"),
        (None, "http://n.org/", "nul")] + [(100 + i, f"http://h{i % 7}.org/p/{i}", f"page {i % 90}") for i in range(200)]


def expected(rows, least=0):
    top = {}
    for i, _, h in rows:
        h = h or ""
        top[h] = max(top.get(h, -1), -1 if i is None else i)
    out = set()
    for i, _, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= least and top[h or ""] != i and top[h or ""] >= 0
        out.add((i, len(raw), base64.b32encode(sha1(raw).digest()).decode(), "revisit" if again else "response", top[h or ""] if again else None))
    return out


def digest(df):
    return {tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()}


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def test_round_trip(spark):
    archive = warc.write(frame(spark, ROWS), block_lines=16)
    assert digest(warc.read(archive)) == expected(ROWS)
    got = {r.page_id: bytes(r.payload).decode() for r in warc.read(archive, payloads=True).where("record_type = 'response'").collect()}
    assert got == {i: (h or "") for i, _, h in ROWS if i in got}
    assert digest(warc.read(warc.write(frame(spark, ROWS), min_bytes=5))) == expected(ROWS, 5)


def test_search(spark):
    archive = warc.write(frame(spark, ROWS), block_lines=4)
    urls = spark.createDataFrame([("http://www.a.org:80/x",), ("http://h3.org/p/3",), ("http://none.org/",)], "u string")
    assert {r.page_id for r in warc.lookup(archive, urls, "u").collect()} == {1, 4, 7, 103}
    assert {r.page_id for r in warc.read(archive, "org,h3)", "org,h3)~").collect()} == {100 + i for i in range(200) if i % 7 == 3}
    assert archive.directory.count() > 20


def test_lookup_of_all_urls_is_the_whole_archive(spark, monkeypatch):
    # many captures of one URL, over several blocks and ranges, beside single ones
    rows = ROWS + [(1000 + i, f"http://hot.org/{i % 2}", f"hot {i}") for i in range(300)] + [(2000 + i, f"http://zz.org/{i:04d}", "z") for i in range(150)]
    for lines, block in ((50_000, 7), (20, 3), (10, 64)):
        monkeypatch.setattr(warc, "READ_LINES", lines)
        archive = warc.write(frame(spark, rows), block_lines=block)
        assert digest(warc.lookup(archive, frame(spark, rows), "url")) == expected(rows)
        some = [r for r in rows if r[1] in ("http://hot.org/1", "http://zz.org/0149", None)]
        got = [r.page_id for r in warc.lookup(archive, frame(spark, some), "url").collect()]
        assert sorted(got) == sorted(r[0] for r in some)


def test_repeated_page_ids_have_records_of_their_own(spark):
    rows = [(1, "http://a.org/", "x"), (1, "http://a.org/", "y"), (1, "http://b.org/", "x"), (2, "http://c.org/", "x")]
    got = sorted((r.page_id, r.key, r.record_type, r.refers_to) for r in warc.lookup(warc.write(frame(spark, rows)), frame(spark, rows), "url").collect())
    assert got == [(1, "org,a)/", "response", None), (1, "org,a)/", "revisit", 2), (1, "org,b)/", "revisit", 2), (2, "org,c)/", "response", None)]


def test_archives_are_plain_warc(spark):
    archive = warc.write(frame(spark, ROWS[:3]))
    store, path = open_store(archive.folder)
    from pyarrow.fs import FileSelector
    files = [f.path for f in store.get_file_info(FileSelector(path)) if f.path.endswith(".warc.gz")]
    text = b"".join(gzip.decompress(store.open_input_file(f).read()) for f in files)
    assert text.count(b"WARC/1.1\r\n") == 3 and b"WARC-Refers-To: <urn:page:2>" in text


def test_empty_and_extra_columns(spark):
    assert warc.read(warc.write(frame(spark, []))).count() == 0
    df = frame(spark, ROWS[:2]).selectExpr("*", "1 as digest", "2 as size", "3 as refers_to")
    assert digest(warc.read(warc.write(df))) == expected(ROWS[:2])


def test_url_keys():
    assert warc.url_key("http://www.Example.org:80/a?b=1") == "org,example)/a?b=1"
    assert warc.url_key(None) == ")/" and " " not in warc.url_key("http://a b/c d\n")
