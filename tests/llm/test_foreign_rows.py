"""Foreign WARC records, and pipeline stages on columns named like the operators' own."""

import base64
import hashlib
import zlib

import corpus_pipeline as P
import pytest

from pathwarden.llm import toxicity, warc


def member(head, block):
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in head.items()), f"Content-Length: {len(block)}"]
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def sha1(b):
    return "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()


HTTP = {"Content-Type": "application/http; msgtype=response"}
BODY = b"<p>" + b"long " * 60_000


def archive():
    http = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(BODY) + BODY
    loose = b"HTTP/1.1 200 OK\r\n\r\n" + BODY
    get = b"GET / HTTP/1.1\r\nHost: a.example\r\n\r\n"
    return b"".join([
        member({"WARC-Type": "warcinfo", "WARC-Record-ID": "<urn:uuid:1>", "Content-Type": "application/warc-fields"}, b"software: x\r\n"),
        member({"WARC-Type": "request", "WARC-Record-ID": "<urn:uuid:2>", "Content-Type": "application/http; msgtype=request"}, get),
        member({"WARC-Type": "response", "WARC-Record-ID": "<urn:page:7>", "WARC-Target-URI": "http://a.example", "WARC-Payload-Digest": sha1(BODY), **HTTP}, http),
        member({"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:3>", "WARC-Payload-Digest": "sha1:" + hashlib.sha1(BODY).hexdigest(), **HTTP}, loose),
        member({"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:4>", **HTTP}, http),
        member({"WARC-Type": "metadata", "WARC-Record-ID": "<urn:uuid:5>", "WARC-Payload-Digest": sha1(b"other"), "Content-Type": "text/plain"}, b"via: http://b.example"),
        member({"WARC-Type": "resource", "WARC-Record-ID": "<urn:uuid:6>"}, b""),
        member({"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:8>", **HTTP}, b""),
    ])


def test_records_of_any_kind():
    got = list(warc.read_archive(archive()))
    assert [r["record_type"] for r in got] == ["warcinfo", "request", "response", "response", "response", "metadata", "resource", "response"]
    assert [r["verified"] for r in got] == [None, None, True, True, None, False, None, None]
    assert [r["payload"] for r in got] == [b"software: x\r\n", b"", BODY, BODY, BODY, b"via: http://b.example", b"", b""]
    assert [r["page_id"] for r in got] == [None, None, 7, None, None, None, None, None] and got[0]["record_id"] == "<urn:uuid:1>"
    assert [r["payload_bytes"] for r in got] == [len(r["payload"]) for r in got]


@pytest.mark.parametrize("block, head", [(b"HTTP/1.1 200 OK\r\nno end", HTTP), (b"x" * 3_000_000, HTTP)])
def test_heads_without_an_end(block, head):
    with pytest.raises(ValueError):
        list(warc.read_archive(member({"WARC-Type": "response", **head}, block)))


def test_other_damage():
    whole = archive()
    for broken in (whole[:-9], b"no gzip at all", zlib.compress(b"WARC/1.1\r\n", wbits=31), zlib.compress(b"WARC/1.1\r\nWARC-Type: x\r\n\r\n", wbits=31)):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.read_archive(broken))


def test_files(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(archive())
    got = warc.read_files(spark, str(tmp_path)).collect()
    assert len(got) == 8 and sum(r["verified"] or 0 for r in got) == 2


def test_stages_keep_columns_with_inner_names(spark):
    """Every name that a stage might use for itself, null ids and repeated rows included."""
    inner = ["_toxicity", "score", "_spans", "_at", "_alike", "_gone_id", "component", "line_no", "tok", "size", "place", "want", "tie", "sig", "text_", "Score"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    null = docs.limit(3).selectExpr("cast(null as bigint) as doc_id", "text", "lang", "source", "n_chars")
    docs = docs.unionByName(docs.limit(4)).unionByName(null).selectExpr("*", *(f"doc_id as `{n}`" for n in inner if n != "Score"), "lang as _row")
    for _, stage in P.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns
        docs = spark.createDataFrame(after.collect(), after.schema)
        assert all(r["score"] == r["doc_id"] for r in docs.collect())
    assert P.STAGES[-1][1](spark, docs, sf).count() == docs.count() > 0


def test_civil_texts_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, _toxicity int")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.keep_civil(none, labels).collect() == [] and toxicity.op8_toxicity(none, labels).collect() == []
    one = spark.createDataFrame([(None, None, 1), (2, "", 2), (2, "", 2)], "doc_id long, text string, _toxicity int")
    assert sorted(map(str, toxicity.keep_civil(one, labels).collect())) == sorted(map(str, one.collect()))
