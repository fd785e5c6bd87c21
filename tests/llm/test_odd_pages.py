"""Odd markup and odd files: what is text and what is a page."""

import numpy as np
import pytest

from stepwright.llm import tiff, wrapper

from .conftest import prose

BODY = "body " * 20
PAGES = [
    ("<p>one <a href=/x title=it's>two</a> three</p><p>don't stop</p>", "one two three\ndon't stop"),
    ("<script src=/js/>var leak=1;</script>x", "x"),
    ("<script src='x.js'/>var leak=1;</script>y", "y"),
    ("<svg/>text", "text"),
    ("<svg width=1/>no</svg>text", "text"),
    ('<p title="abc>one two</p>', "one two"),
    ("<p a=b'c>r</p>s", "r\ns"),
    ("<p class=x/>t</p>", "t"),
    ("<input value='>'>q", "q"),
    ("<div class='widget content'><p>article text</p></div>", "article text"),
    ("<div class='main-content section-social'><p>article text</p></div>", "article text"),
    ("<p>a</p><div class='discussion'>c</div>", "a"),
    ("<p>a</p><div class=user-feedback>c</div>", "a"),
    ("<p>a</p><div class=cookieBar>c</div>", "a"),
    ("<p>a</p><div id=siteFooter>c</div>", "a"),
    ("<p>a</p><div class='content sidebar'>c</div>", "a"),
    (f"<h1>Title</h1><p>Lead</p><article><p>{BODY}</p></article>", f"Title\nLead\n{BODY.strip()}"),
    (f"<nav><p>menu</p></nav><article><p>{BODY}</p></article><p>after</p>", BODY.strip()),
]


@pytest.mark.parametrize("html,want", PAGES)
def test_text_of_odd_markup(html, want):
    assert wrapper.main_text(wrapper.parse(html), set()) == want


def test_pages_of_a_host_without_role_words_rest_on_the_template(spark):
    """Frames that carry no role words: only what varies over the host's pages is content."""
    frame = "<div><div><p>Example Times</p><p>World and Sport</p></div><div><h1>{0}</h1><p>{1}</p><p>{2}</p></div><div><p>All rights reserved here</p></div></div>"
    rows = [(i, f"http://plain.example/{i}", frame.format(f"Title {i}", prose(i, 40), prose(100 + i, 30))) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i}\n{prose(i, 40)}\n{prose(100 + i, 30)}" for i in range(12)}
    alone = wrapper.main_text(wrapper.parse(rows[0][2]), set())  # without the template the frame stays
    assert "Example Times" in alone and "All rights reserved" in alone


def claimed(height: int, width: int, compression: int) -> bytes:
    """A sound page whose directory says that it is larger."""
    data = bytearray(tiff.write_tiff([np.zeros((400, 500, 1), dtype=np.uint8)], compression=compression, strip_rows=400))
    for tag, value in ((tiff.WIDTH, width), (tiff.LENGTH, height), (tiff.ROWS_PER_STRIP, height)):
        at = data.rindex(tag.to_bytes(2, "little") + (4).to_bytes(2, "little") + (1).to_bytes(4, "little"))
        data[at + 8 : at + 12] = value.to_bytes(4, "little")
    return bytes(data)


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("size", [(401, 500), (2000, 2000), (60_000, 60_000)])
def test_pages_are_not_allocated_on_a_claim(spark, compression, size):
    df = spark.createDataFrame([(1, bytearray(claimed(*size, compression)))], "k int, media binary")
    (row,) = tiff.explode_pages(df, carry=("k",)).collect()
    assert row["page"] == -1 and row["error"]


def test_a_page_that_memory_cannot_hold_is_a_fault(spark, monkeypatch):
    data = tiff.write_tiff([np.zeros((4, 4, 1), dtype=np.uint8)])

    def no_memory(_):
        raise MemoryError
        yield

    monkeypatch.setattr(tiff, "read_pages", no_memory)
    df = spark.createDataFrame([(1, bytearray(data))], "k int, media binary")
    assert tiff.explode_pages(df, carry=("k",)).count() == 1
