import base64
import glob
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from metrolens.llm import warc
from metrolens.session import scratch_path

PAGES = [(3, "http://a/", "<p>x</p>\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nhi"), (1, "http://b/", "same"),
         (2, "http://c/", "same"), (5, None, "same"), (4, "http://d/", None), (6, "http://e/", ""),
         (7, "http://f/", "é中😀\n" * 3000), (8, "x\r\nInjected: 1", "line\rend\n\n"), (None, "http://g/", "same"),
         (2, "http://c/", "same"), (9, "http://h/", "x" * 300_000), (10, "u", "tail\r\n\r\n")]


def pages_df(spark):
    from pyspark.sql import functions as F
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("sha", F.lit("clash")) \
        .withColumn("value", F.lit("clash"))


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_round_trip(spark):
    rows = warc.with_origins(warc.round_trip(spark, pages_df(spark)), F.col("metadata.fields")["page-id"]).collect()
    assert len(rows) == len(PAGES)                               # a row per page, also for equal ones
    got = {}
    for r in rows:
        page = r["metadata"]["fields"].get("page-id")
        got.setdefault(None if page is None else int(page), []).append(r)
        assert r["request"]["record_id"] != r["response"]["record_id"]
    assert len({r["response"]["record_id"] for r in rows}) == len(rows)
    first = {}
    for page, _, html in sorted(PAGES, key=lambda p: (p[0] is None, p[0] or 0)):
        first.setdefault(html or "", page)
    for page, url, html in PAGES:
        source = first[html or ""]
        assert len(got[page]) == sum(p[0] == page for p in PAGES)
        main = [r["response"] for r in got[page] if r["response"]["kind"] == "response"]
        assert len(main) == (source == page)
        for r in got[page]:
            assert r["response"]["payload_digest"] == digest(html)
            assert int(r["metadata"]["fields"]["payload-length"]) == len((html or "").encode())
            if r["response"]["kind"] == "response":
                assert r["response"]["payload"] == (html or "").encode() and r["origin"] is None
            else:
                assert r["response"]["payload"] is None and r["origin"] == str(source)
                assert r["response"]["refers_to"] in {x["response"]["record_id"] for x in got[source] if x["response"]["kind"] == "response"}
            if url and "\r" not in url:
                assert r["request"]["target_uri"] == r["response"]["target_uri"] == url


def test_query_gives_every_equal_row_back(spark):
    """2 rows and 3 equal ones, as the SQL counts them; many copies of one row."""
    import uuid

    from metrolens.llm import queries
    from metrolens.session import checkpoint_dir
    folder = f"{checkpoint_dir(spark)}/pages-{uuid.uuid4().hex}"
    rows = [(1, "u", "same")] * 3 + [(2, "u", "same"), (3, "v", "other")] + [(9, "w", "many")] * 500 + [(None, None, None)] * 2
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4).write.parquet(f"{folder}/pages.parquet")
    got = sorted(queries.op6_warc_transactions(spark, folder).collect(), key=str)
    assert len(got) == len(rows)
    kinds = lambda page: sorted((r["record_type"], r["refers_to"]) for r in got if r["page_id"] == page)
    assert kinds(1) == [("response", None)] + [("revisit", 1)] * 2 and kinds(2) == [("revisit", 1)] and kinds(3) == [("response", None)]
    assert kinds(9) == [("response", None)] + [("revisit", 9)] * 499
    assert [r for r, _ in kinds(None)] == ["response", "revisit"]


def test_least_payload(spark):
    kinds = [r["response"]["kind"] for r in warc.round_trip(spark, pages_df(spark), least=100).collect()]
    assert set(kinds) == {"response"}


def test_archives_are_plain_records(spark):
    path = scratch_path(spark, "warc-test")
    warc.write_archives(spark, pages_df(spark), path)
    files = glob.glob(path.removeprefix("file:") + "/part-*.gz")
    raw = b"".join(gzip.open(f).read() for f in files)
    assert files and raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")


def test_broken_record_is_an_error():
    good = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 3\r\n\r\na:b\r\n\r\n"
    lines = lambda raw: [("f", x) for x in raw.split(b"\n")[:-1]]
    assert len(list(warc.records_of(lines(good + good), True))) == 2
    for bad in (good.replace(b"3", b"2"), good.replace(b"3", b"9"), good.replace(b"Content-Length: 3\r\n", b""), b"junk\r\n" + good):
        with pytest.raises(ValueError):
            list(warc.records_of(lines(bad), True))


def test_empty(spark):
    assert warc.round_trip(spark, pages_df(spark).limit(0)).count() == 0
