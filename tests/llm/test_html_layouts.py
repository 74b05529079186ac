"""Layouts that training never saw, pages that are long or broken, and the parser against the standard library's."""

from __future__ import annotations

import random
import re
import time
from html.parser import HTMLParser

import pytest

from ordinate.llm import html


@pytest.fixture(scope="module")
def pages(spark):
    return [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]


@pytest.fixture(scope="module")
def model(pages):
    return html.train(pages[:150])


def truth(article):
    plain = [" ".join(html.entities.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", article)]
    return "\n".join(filter(None, plain))


@pytest.mark.parametrize("box", ['<div class="c-9f2">|</div>', "<section>|</section>", "<div>|</div>", "<table><tr><td>|</td></tr></table>", '<div id="x7"><div class="qq">|</div></div>', '<main class="zeta">|</main>'])
def test_unknown_containers(pages, model, box):
    good = held = 0
    for page in pages[150:]:
        if m := re.search("<article>(.*?)</article>", page, re.S):
            held += 1
            good += html.main_text(page[: m.start()] + box.replace("|", m[1]) + page[m.end() :], model) == truth(m[1])
    assert held >= 90 and good >= 0.95 * held


@pytest.mark.parametrize("junk", ['<div class="promo-strip">Buy the new thing now, and save</div>', '<div class="AdSlot_1">Buy now</div>', '<section id="user-comments"><p>Nice post, thank you</p></section>', '<ul class="share-links"><li><a href="#">tweet</a></li></ul>', "<aside>See also this thing</aside>", '<form><label>Mail</label><button>Send</button></form>'])
def test_noise_inside_the_article(pages, model, junk):
    good = held = 0
    for page in pages[150:]:
        if m := re.search("<article>(.*?)</article>", page, re.S):
            held += 1
            at = m.start(1) + m[1].find("</p><p>") + 4 if "</p><p>" in m[1] else m.end(1)
            good += html.main_text(page[:at] + junk + page[at:], model) == truth(m[1])
    assert good >= 0.9 * held


@pytest.mark.parametrize("unit", ["<a ", "<div>", "<div><p>", '<a b="x>" ', "<xmp>", "<ul><div><li>", "<", '<a "', "<!-", "<p><button><label>", "</p><div>", "<table><tr><td>"])
def test_time_follows_length(model, unit):
    took = []
    for size in (100_000, 400_000):
        page = unit * (size // len(unit))
        began = time.perf_counter()
        html.main_texts([page], model)
        took.append(time.perf_counter() - began)
    assert took[1] < 10 and took[1] < 10 * max(took[0], 0.05)


class Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.quiet = [], 0

    def handle_starttag(self, tag, attrs):
        self.quiet += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.quiet -= tag in ("script", "style")

    def handle_data(self, data):
        if not self.quiet:
            self.text.append(data)


def test_no_text_is_lost_or_added():
    rng = random.Random(7)
    parts = ["<div>", "</div>", "<p>", "</p>", "<b>", "</b>", "<li>", "<ul>", "</ul>", "<td>", "<table>", "</table>", "alpha ", "beta&amp;", " 1 &lt; 2 ", "<a href='x>y'>", "</a>", '<p title="a > b" id=c>', "<!-- gone > -->", "<script>no</script>", "<br>", "<span class=it's>", "<button>", "<dt>", "<dd>"]
    for _ in range(400):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(1, 40)))
        plain = Plain()
        plain.feed(page)
        plain.close()
        ours = sorted(b for node in html.parse(page) for b in node.blocks)
        assert "".join("".join(t for _, t in ours).split()) == "".join("".join(plain.text).split()), page
