"""Inputs of the tests: the smallest tables, and hand-made rows."""

import random

FOLDER = "/root/testdata/sf0.001"


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["th", "on", "er", "in", "at", "ou", "es"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def cases():
    base = prose(300, 1)
    texts = [
        None, "", " \t\n ", "a", "One two", "ONE TWO", base, base, base.upper(), base.replace("th", "on", 1), prose(40_000, 2),
        "x" * 5000, "ab " * 900, "é" * 300, "#$% " * 50, "İstanbul \U0001F600 \x00 nul", prose(300, 3) + " " + base, "\n".join(["the same line here"] * 40),
        "mail a.b@c-d.org +1 (988) 555-2485 10.0.0.256 1.2.3.4.5.6.7.8 4041894974608795", "+1 2 @ 1.2.3 a@b 00000000000000000000 IBAN password is",
    ]
    out = [(i if i % 7 else None, t, ["en", None, "xx"][i % 3], ["s", None, "a.fr"][i % 3], "clash", i, None, "y") for i, t in enumerate(texts)]
    return [*out, out[6], out[6], out[1]]
