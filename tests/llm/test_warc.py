import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from haulframe.llm import warc
from haulframe.llm.storage import new_path

SCHEMA = "page_id bigint, url string, html string, digest string, header string"


def archive(spark, rows, **options):
    path = new_path(spark, "archive")
    warc.write_archive(spark.createDataFrame(rows, SCHEMA), path, **options)
    return warc.read_archive(spark, path), path


ROWS = [
    (3, "u3", "same"), (1, "u1", "same"), (2, "u2", "é\r\n\r\nWARC/1.1\r\n"), (2, "u2", "é\r\n\r\nWARC/1.1\r\n"),
    (4, None, None), (5, "u5", ""), (None, "u6", "same"), (7, "a\r\nWARC-Type: resource", "x" * 200_000), (None, None, "lonely"),
]


def test_payloads_are_stored_once_and_read_back_exactly(spark):
    records, path = archive(spark, [(*r, "d", "h") for r in ROWS])
    got = sorted(map(tuple, warc.record_report(records).collect()), key=repr)
    first = {"same": 1, "é\r\n\r\nWARC/1.1\r\n": 2, "": 4}
    want, seen = [], set()
    for i, u, html in ROWS:
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        owner = first.get(html or "", i)
        response = i == owner and (html or "") not in seen
        if response:
            seen.add(html or "")
        want.append((i, len(body), digest, "response" if response else "revisit", None if response else owner))
    assert got == sorted(want, key=repr)
    assert spark.read.parquet(f"{path}/payloads").count() == len({r[2] or "" for r in ROWS})


def test_records_are_well_formed(spark):
    records, _ = archive(spark, [(*r, "d", "h") for r in ROWS])
    for r in warc.warc_record(records).collect():
        head, _, block = bytes(r["record"]).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert int(fields["Content-Length"]) == len(block) - 4 and block.endswith(b"\r\n\r\n")
        assert fields["WARC-Type"] in ("response", "revisit")
        body = block[:-4].partition(b"\r\n\r\n")[2]
        assert body == (bytes(r["payload"]) if fields["WARC-Type"] == "response" else b"")


def test_small_payloads_are_always_responses(spark):
    records, _ = archive(spark, [(1, "a", "xy", "", ""), (2, "b", "xy", "", ""), (3, "c", "long", "", ""), (4, "d", "long", "", "")], min_bytes=3)
    got = {r["page_id"]: r["record_type"] for r in warc.record_report(records).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_empty_table(spark):
    records, _ = archive(spark, [])
    assert warc.record_report(records).collect() == []


def test_damaged_payload_is_noticed(spark):
    _, path = archive(spark, [(1, "a", "text", "", "")])
    rows = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"other"))
    other = new_path(spark, "broken")
    rows.write.parquet(f"{other}/payloads")
    spark.read.parquet(f"{path}/records").write.parquet(f"{other}/records")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_archive(spark, other).collect()


def test_urls_with_line_ends(spark, tmp_path):
    """A URL cannot end its header line, whatever counts as a line end."""
    fake = "WARC-Payload-Digest: sha1:AAAA"
    rows = [(i, f"http://a/{c}{fake}{c}WARC-Refers-To: <urn:haulframe:page:99:1>", f"body {i % 2}") for i, c in enumerate("\r\n\x0b\x0c\x1c\x85\u2028\u2029")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    path = str(tmp_path / "archive")
    warc.write_archive(pages, path)
    found = sorted(map(tuple, warc.record_report(warc.read_archive(spark, path)).collect()))
    assert [(r[0], r[3], r[4]) for r in found] == [(i, "response" if i < 2 else "revisit", None if i < 2 else i % 2) for i in range(len(rows))]
    urls = [r["u"] for r in warc.read_archive(spark, path).select(warc.header_field("WARC-Target-URI").alias("u")).collect()]
    assert all(u.startswith("http://a/%") and fake in u for u in urls) and "http://a/%E2%80%A8" in "".join(urls)


def test_text_ids(spark, tmp_path):
    pages = spark.createDataFrame([("a:1>", "u", "x"), ("b\u2028", "u", "x"), (None, "u", "y")], "page_id string, url string, html string")
    path = str(tmp_path / "archive")
    warc.write_archive(pages, path)
    found = {r["page_id"]: r["refers_to"] for r in warc.record_report(warc.read_archive(spark, path), "string").collect()}
    assert found == {"a:1>": None, "b%E2%80%A8": "a:1>", None: None}
