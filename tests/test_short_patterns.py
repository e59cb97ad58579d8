"""Patterns shortened for tests match exactly where their originals do."""

import random
import re

from sparkloom.functions import code


def test_short_patterns_match_alike():
    assert set(code._SHORT) <= {*code.INDICATORS, *code.BAD} and len(code._SHORT) == 5
    rng = random.Random(1)
    parts = ["a", "b1", " ", "\n", "(", ")", "=", ".", "<span>", "<span a='1'>", "x" * 199, "x" * 200, "é"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        for long, short in code._SHORT.items():
            assert bool(re.search(long, text, re.A)) == bool(re.search(short, text, re.A)), (long, text)
