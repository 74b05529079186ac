"""What the skip-chain field adds: other forms of what a pattern finds in the same document, and little else."""

from __future__ import annotations

import random

import pytest

from ordinate.llm import pii


def card(rng):
    d = [rng.randint(1, 9) for _ in range(15)]
    total = sum(x if i % 2 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(reversed(d)))
    return "".join(map(str, d)) + str(-total % 10)


@pytest.fixture(scope="module")
def field():
    rng = random.Random(1)
    words = "the and of report number page total in year see item about".split()
    out = []
    for i in range(900):
        w = [rng.choice(words) for _ in range(30)] + [str(rng.randint(1, 3000)) for _ in range(4)] + [f"v{rng.randint(1, 9)}.{rng.randint(0, 9)}"]
        rng.shuffle(w)
        if i % 3 == 0:
            w.insert(5, rng.choice([f"pay {card(rng)}", f"mail user{i}@mail{i % 7}.example.org", f"host 10.{i % 255}.3.4", f"call +49 151 {rng.randint(1000000, 9999999)}"]))
        out.append(" ".join(w))
    return pii.train(out)


def test_other_forms_of_what_was_found(field):
    rng = random.Random(2)
    planted = found = wrong = 0
    for i in range(120):
        c = card(rng)
        dotted = "/".join(c[j : j + 4] for j in range(0, 16, 4))
        name = f"person{i}"
        text = f"pay {c} by mail {name}@mail.example.org in year 2020 then {dotted} or {name}[at]mail[dot]example[dot]org see item 12 page 345 of v2.1"
        base, more = pii.find([text], field)[0]
        assert [k for _, k, _ in base] == [2, 0]
        want = {(text.index(dotted), 2, text.index(dotted) + 19), (text.index(f"{name}[at]"), 0, text.index(" see item"))}
        planted += len(want)
        found += len(want & set(more))
        wrong += len(set(more) - want)
    print(f"planted {planted}, found {found}, wrong {wrong}")
    assert found >= 0.9 * planted and wrong <= 0.05 * max(1, found)


def test_clean_texts_get_nothing(field):
    texts = [f"see item {i} page {i * 7} of v2.{i % 9} in year {1900 + i}" for i in range(200)]
    assert sum(len(b) + len(m) for b, m in pii.find(texts, field)) <= 2


@pytest.mark.parametrize("between", [".", "/"])
def test_repeats_have_one_label(field, between):
    rng = random.Random(3)
    c = card(rng)
    other = between.join(c[j : j + 4] for j in range(0, 16, 4))
    base, more = pii.find([f"pay {c} " + f"and the report of the year about {other} " * 30], field)[0]
    assert len(base) == 1 and len(more) in (0, 30) and len({k for _, k, _ in more}) <= 1
