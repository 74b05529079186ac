"""Elements of pages that are rare, but whose text must not be lost."""

from __future__ import annotations

import pytest

from ordinate.llm import html


@pytest.mark.parametrize("page, want", [
    ("<p>a <math><mi>x</mi><mo>=</mo><mn>1</mn></math> b</p><p>c</p>", "a x=1 b c"),
    ("<p>a <svg><text>label</text><style>.k{}</style></svg> b</p>", "a label b"),
    ("<p>a</p><svg><path d='M0'><p>b</p>", "a b"),
    ("<p>a</p><math><p>b</p>", "a b"),
    ("<p>a</p><xmp>1 <b>2</b> &amp;</xmp><p>c</p>", "a 1 <b>2</b> &amp; c"),
    ("<p>a</p><xmp>b<p>c</p>", "a b c"),
    ("<p>a</p><script>no</script><textarea>no</textarea><iframe>no</iframe><p>b</p>", "a b"),
])
def test_rare_elements_are_text(page, want):
    blocks = sorted(b for node in html.parse(page) for b in node.blocks)
    assert " ".join(t for _, t in blocks) == want
