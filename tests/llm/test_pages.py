"""Archives and HTML on unusual pages."""

import base64
import hashlib
import time

from ampliframe.llm import html_extract, warc

MAGIC = "WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_archives_read_back_when_the_second_reading_is_split_otherwise(spark, monkeypatch):
    html = [MAGIC * 3 + "x" * (50_000 * (i % 4)) + MAGIC + str(i) for i in range(20)]
    html += ["y" * 5_000_000 + MAGIC + "é" * 100, "z" * 3_000_000, MAGIC, "WARC/1.0\r\n", ""]
    df = spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string").repartition(2)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    real = warc.reachable

    def changed(found):
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300000b")
        return real(found)

    monkeypatch.setattr(warc, "reachable", changed)
    try:
        got = {r["page_id"]: r for r in warc.round_trip(df).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == len(html)
    for i, h in enumerate(html):
        assert (got[i]["payload_bytes"], got[i]["payload_digest"], got[i]["intact"]) == (len(h.encode()), digest(h), True)


def test_archives_keep_ids_that_are_no_numbers(spark):
    rows = [("a b>\r\n", "u", "same"), ("", "u", "same"), (None, "u", "same"), ("é/ü", None, "other"), ("é/ü", None, "other")]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect()), key=str)
    assert got == sorted([("", "response", None), ("a b>\r\n", "revisit", ""), (None, "revisit", ""), ("é/ü", "response", None), ("é/ü", "revisit", "é/ü")], key=str)


def test_layout_classes_do_not_erase_the_page():
    text = html_extract.main_text
    side = "<div class='sidebar'><p>Side, side, side.</p></div>"
    assert text(f"<div class='layout has-sidebar'><article><p>Text, one.</p></article>{side}</div>") == "Text, one."
    assert text(f"<div id='wrap' class='content right-sidebar'><p>Text, two, of some length.</p>{side}</div>") == "Text, two, of some length."
    assert text("<form><article><p>All, in a form.</p></article></form>") == "All, in a form."
    assert text("<div class='widget'><p>Nothing, but this.</p></div>") == "Nothing, but this."
    assert text("<article><p>Short, text.</p></article><div class='comments'><p>Much, much, much longer talk by readers.</p></div>") == "Short, text."


def test_unclosed_elements_do_not_swallow_the_page():
    for name in ("svg", "math", "object", "select", "iframe", "noscript", "template"):
        assert html_extract.main_text(f"<{name}><article><p>Behind, it.</p></article>") == "Behind, it."
    for name in ("script", "style", "textarea", "title"):
        assert html_extract.main_text(f"<article><p>Before, it.</p></article><{name}><p>Inside, it.</p>") == "Before, it."


def test_deep_pages_take_linear_time():
    began = time.time()
    html_extract.main_text("<div><a href=x>l</a>" * 100_000)
    html_extract.main_text("<foo>" * 100_000 + "<p>x, y" * 1000 + "</bar>" * 100_000)
    html_extract.main_text("<ul><li>" * 50_000 + "text, more" + "</ul>" * 50_000)
    assert time.time() - began < 20


def test_repeated_pages_and_clashing_columns(spark):
    page = "<article><p>One, text.</p></article>"
    df = spark.createDataFrame([(1, "u", page, "own", 3)] * 3, "page_id long, url string, html string, text string, n_chars int")
    assert sorted(map(tuple, html_extract.extract(df).collect())) == [(1, "u", "One, text.", 10)] * 3
