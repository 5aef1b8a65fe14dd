"""Small documents with the cases that operators must bear: nulls, empty texts, ties, repeats, odd characters, long texts."""

from __future__ import annotations

import random

WORDS = "alpha beta gamma delta épsilon zeta eta theta iota kappa lambda mu ñandú xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(n))


def documents(spark, extra: bool = True):
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base), (2, base), (3, " ".join(near)), (4, prose(2, 80)), (5, None), (6, ""), (7, " \n\t"), (8, "one two three"), (9, "One  two THREE"),
        (10, prose(3, 60) + "\n" + base[:200] + "\n" + prose(4, 60)), (11, prose(5, 30) + "\n" + base[:200]), (12, "日本語 😀 é\u0000x " * 9),
        (13, "a" * 5000), (14, prose(6, 4000)), (15, "mail a.b@c-d.example.org, ip 10.0.0.255 or 300.1.1.1, card 4111 1111 1111 1111, tel +1 (212) 555-0100; x@y"),
        (16, base + " tail"), (16, base + " tail"), (17, "a" * 300 + "b"),
    ]
    if extra:
        return spark.createDataFrame([(i, t, "en", "s", 0 if t is None else len(t), "node", 7) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, node string, n int")
    return spark.createDataFrame(rows, "doc_id long, text string")
