"""Texts with very many spans or open tags take time in proportion; nulls beside other items; names."""

import random
import time

import numpy as np

from provena.llm import decontam, html_extract, pii


def test_null_items_share_windows(spark):
    text = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, "so " + text), (2, "nothing here")], "doc_id long, text string")
    items = spark.createDataFrame([(None, text), ("b", text), ("a", text), (None, "so w0 w1 w2 w3 w4 w5 w6 w7 w8"), (None, None)], "item_id string, text string")
    for part_bytes in (decontam.PART_BYTES, 300):
        got = {x.doc_id: x for x in decontam.report(docs, items, part_bytes=part_bytes).collect()}
        import hashlib

        assert (got[1].n_hit, got[1].n_items, got[1].items_sha256) == (31, 3, hashlib.sha256(b"a,b").hexdigest())
        assert (got[2].n_hit, got[2].n_items, got[2].contaminated) == (0, 0, False)


def test_twenty_thousand_spans_in_one_text(spark):
    n = 20_000
    text = " ".join(f"mail a{i}@b{i}.org or Dear Mr. John Smith," for i in range(n))
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    began = time.time()
    got = {x.doc_id: x for x in pii.report(docs).collect()}
    assert got[1].n_email == n and got[1].spans.count("name:") == n and got[2].spans == ""
    spans = [x.split(":") for x in got[1].spans.split(",")]
    assert all(text[int(s) : int(e)].startswith("Mr. John Smith" if k == "name" else f"a{i}@") for i, (k, s, e) in ((i % n, x) for i, x in enumerate(spans)))
    assert time.time() - began < 120
    left = pii.redact(docs).where("doc_id = 1").first().text
    assert left == " ".join(["mail <EMAIL> or Dear <NAME>,"] * n)


def test_names_of_people(spark):
    r = random.Random(4)
    given, family = ["John", "Sophie", "Ivo", "Hans", "Priya", "Zoë"], ["Smith", "Müller", "Okafor", "García", "Ng", "Laurent"]
    titles, before = ["Mr.", "Mrs", "Dr.", "Prof.", "Frau", "Señora", "Mme"], ["Dear ", "signed ", "We met ", "and then ", "Her name is "]
    lures = ["the Dr. Strange Street hotel", "Mr Right", "Prof. at noon", "MrBean", "Dr. of law", "Madame tussauds"]
    rows, want = [], {}
    for k in range(200):
        text = "Some words first. "
        for _ in range(r.randint(0, 3)):
            text += r.choice(before)
            name = f"{r.choice(titles)} {r.choice(given)} {r.choice(family)}"
            want.setdefault(k, set()).add((len(text), len(text) + len(name)))
            text += name + r.choice([", ", ". ", " "])
        rows.append((k, text + r.choice(lures) + "."))
    got = {x.doc_id: {(c.s, c.e) for c in x.spans if c.kind == pii.KINDS.index("name")} for x in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    right = sum(len(want.get(k, set()) & got[k]) for k in got)
    assert right >= 0.9 * sum(map(len, want.values())) and right >= 0.9 * sum(map(len, got.values()))


def test_a_kind_unseen_at_fit_is_still_found(spark):
    none = pii.fit(spark.createDataFrame([(1, "no such thing")], "doc_id long, text string"))
    got = pii.find(spark.createDataFrame([(1, "Dear Mr. John Smith, hello")], "doc_id long, text string"), none).first()
    assert [(c.s, c.e) for c in got.spans] == [(5, 19)]


def test_fifty_thousand_open_tags():
    field = html_extract.Field(np.random.default_rng(0).normal(size=1 << html_extract.BITS), np.zeros((2, 2)))
    for page, n in (("<div>x " * 50_000, 50_000), ("<font>y " * 50_000 + "<h1>z</h1>" * 20_000, 20_001), ("<div>" * 50_000 + "</b>a<h2>b</h2>" * 20_000, 40_000)):
        began = time.time()
        found = html_extract.blocks(page)
        assert len(found) == n and len(field.labels(found)) == n and html_extract.own_labels(page)[1] is None
        assert time.time() - began < 60


def test_linked_paths_are_the_tags_around():
    found = html_extract.blocks('<main class="a b"><p>one<p>two <b>x</b></main><ul><li>three<li>four<table><tr><td>five</table>')
    assert [(b.text, set(b.path)) for b in found] == [
        ("one", {"main", ".a", ".b", "class?", "p"}), ("two x", {"main", ".a", ".b", "class?", "p"}), ("three", {"ul", "li"}), ("four", {"ul", "li"}), ("five", {"ul", "li", "table", "tr", "td"}),
    ]
    field = html_extract.Field(np.random.default_rng(1).normal(size=1 << html_extract.BITS), np.zeros((2, 2)))
    for b in found:
        plain = sum(field.weights[html_extract._number(f)] for f in html_extract.path_features(b.path))
        assert abs(field.stands_in(b.path) - plain) < 1e-9
