"""Broken and hostile markup is read in time that grows with the page."""

import time

import pytest

from ledgerline.llm import pages


@pytest.mark.parametrize("unit", ["<script ", '<a "x', "<a b ", "<a", "<b> ", "<!", "<i><div>", "</b><b>", "<a b='", "<a b=\" '", "<hr>x<i>", "</script ", "<li><i>"])
def test_a_megabyte_of_broken_markup(unit):
    for tail in ("", ">", "\" >", "</x>" * 20_000, "<hr>x" * 20_000):
        page = unit * ((1 << 20) // len(unit)) + tail
        begun = time.perf_counter()
        pages.blocks(page)
        assert time.perf_counter() - begun < 20


def test_what_is_no_tag_is_text():
    def texts(page):
        return [b.text for b in pages.blocks(page)]

    assert texts("<p>1 < 2 and 3<4</p>") == ["1 < 2 and 3<4"]
    assert texts('<p>a <b class="x>y">b</b> c') == ["a b c"]
    assert texts("<p>a<!-- never closed <p>b") == ["a"]
    assert texts("<p>a<script>x < y</script>b<script/>c<style>gone") == ["abc"]
    assert texts('<p>open <a href="x and no end') == ['open <a href="x and no end']
    assert texts("<div><b>x<p>y</b>z</p></div><p>w") == ["x", "yz", "w"]
