"""Wider shapes are searched for from what they need; the plain search finds the same spans."""

import random
import re

from docmarket.llm import pii

LOCAL_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{2,4}\)?[\x20./-][0-9]{2,4}[\x20./-][0-9]{2,5}(?:[\x20./-][0-9]{2,5})?(?![0-9])")


def test_searches_from_a_sign_find_what_a_plain_search_finds():
    rng = random.Random(9)
    parts = (" at ", "(at)", "[at]", " at at ", ".", " dot ", "(dot)", "a", "bob", "x" * 64, "y" * 70, "co", " ", "-", "_", "12", "555", "0199", "(", ")", "+", "/", "ab:", "1f:", ":", "\n", "é", "com")
    found = [0] * 4
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 16)))
        text += rng.choice(("", "fe80:0:0:0:1:2:3:4", " mail me at home. Then", "(12) 345 6789"))
        for kind, pattern in enumerate(pii._WIDE):
            plain = LOCAL_PHONE if kind == 3 else pattern
            want = [m.span() for m in plain.finditer(text)]
            assert [m.span() for m in pii.wide_matches(kind, text)] == want, (kind, text)
            found[kind] += len(want)
    assert min(found) > 100


def test_addresses_start_where_digits_start():
    rng = random.Random(2)
    plain = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
    texts = ["".join(rng.choice("0129....x ") for _ in range(rng.randrange(24))) for _ in range(20_000)]
    spans = lambda p: [[m.span() for m in p.finditer(t)] for t in texts]
    assert spans(pii._IP) == spans(plain) and sum(map(len, spans(plain))) > 100
