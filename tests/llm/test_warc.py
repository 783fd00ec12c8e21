"""Derived records hold what the response held, and read back as they were written."""

import gzip

from rollcall.llm import warc


def test_round_trip(spark):
    html = "<html><head><title>A &amp; b</title></head><body><p>One\n two<p>é &lt;x&gt;<script>no</script><a href='/q'>q</a></body>"
    rows = [(1, "http://a/\r\nX: y", html, "z"), (2, None, None, "z"), (3, "http://b/", "", "z"), (3, "http://b/", "", "z"), (4, "http://c/", "w " * 200_000, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record string")
    made = warc.responses(pages)
    got = warc.derivatives(made).collect()
    assert sorted((r.page_id, r.record_type) for r in got) == sorted((p, k) for p, *_ in rows for k in ("conversion", "metadata"))
    source = {r.page_id: warc.parse(bytes(r.record)) for r in made.collect()}
    for r in got:
        headers, block = warc.parse(bytes(r.record))
        theirs, body = source[r.page_id]
        assert bytes(r.record).endswith(b"\r\n\r\n") and len(block) == r.content_length and warc.digest(block) == r.block_digest == warc.value(headers, "warc-block-digest")
        assert r.refers_to == warc.value(theirs, "warc-record-id") == warc.value(headers, "warc-refers-to")
        assert r.source_block_digest == warc.digest(body) and r.source_payload_digest == warc.value(theirs, "warc-payload-digest")
        assert warc.value(headers, "x") is None
    by = {(r.page_id, r.record_type): warc.parse(bytes(r.record))[1].decode() for r in got}
    assert by[1, "conversion"] == "One two\né <x>q" and by[2, "conversion"] == by[3, "conversion"] == ""
    fields = dict(x.split(": ", 1) for x in by[1, "metadata"].split("\r\n") if ": " in x)
    ids = {(r.page_id, r.record_type): r.record_id for r in got}
    assert fields["title"] == "A & b" and fields["outlink"] == "http://a/q" and fields["http-header-content-type"] == "text/html; charset=utf-8" and fields["http-status"] == "200 OK"
    assert fields["conversion"] == ids[1, "conversion"] and fields["source-warc-target-uri"] == "http://a/ X: y"


def test_bad_and_coded_records(spark):
    good = warc.response_record("u", "<p>x", "n", "2020-01-01T00:00:00Z")
    body = gzip.compress("<p>coded".encode("latin-1"))
    block = b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\nContent-Type: text/html;\r\n charset=latin-1\r\n\r\n" + b"%x\r\n" % len(body) + body + b"\r\n0\r\n\r\n"
    coded = warc.build([("WARC-Type", "response"), ("WARC-Record-ID", "<i>")], block)
    plain = warc.build([("WARC-Type", "response"), ("WARC-Record-ID", "<j>")], b"HTTP/1.1 404 Gone\r\nContent-Type: text/plain\r\n\r\n<as it is>")
    rows = [None, b"", b"junk", good[:-30], good.replace(b"<p>x", b"<p>y"), good.replace(b"WARC-Type: response", b"WARC-Type: request"), coded, plain]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id int, record binary")
    got = warc.derivatives(df).collect()
    assert [r.page_id for r in got if r.record_type == "invalid"] == [0, 1, 2, 3, 4, 5] and all(r.problem for r in got if r.record_type == "invalid")
    by = {r.page_id: warc.parse(bytes(r.record))[1] for r in got if r.record_type == "conversion"}
    assert by == {6: b"coded", 7: b"<as it is>"}
    assert warc.derivatives(df.limit(0)).count() == 0 and warc.responses(spark.createDataFrame([], "page_id int, url string, html string")).count() == 0
