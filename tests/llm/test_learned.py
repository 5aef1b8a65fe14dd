"""Learned operators, the embedding join, components and the pipeline."""

import re

import numpy as np
import pytest

import corpus_pipeline
from provena.llm import embed_dedup, html_extract, jaccard_join, langid
from provena.llm.common import components
from tests.llm.fixtures import documents, prose

SYLLABLES = {"aa": "ka lo mi ta no ri", "bb": "sch ung ver ein zu ich", "cc": "ção nha lho que est ira"}


def spoken(lang: str, seed: int, n: int) -> str:
    r = np.random.default_rng(seed)
    s = SYLLABLES[lang].split()
    return " ".join("".join(r.choice(s, r.integers(1, 4))) for _ in range(n))


def test_language_id(spark):
    rows = [(i, spoken(lang, i, 3 + i % 40), lang) for i, lang in enumerate(list(SYLLABLES) * 80)]
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 !? 3", "cc"), (1003, spoken("aa", 9, 5), None), (None, spoken("bb", 3, 9), "bb"), (1004, spoken("cc", 5, 30000), "cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.report(docs).collect()}
    assert len(got) == len(rows)
    right = [got[i].lang_pred == lang for i, _, lang in rows[:240] if got[i].held_out]
    assert sum(right) / len(right) > 0.95 and len(right) > 20
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    assert got[1003].lang_pred == "aa" and got[None].held_out is False and got[1004].lang_pred == "cc"
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    assert [r.lang_pred for r in langid.report(docs.withColumn("lang", docs.lang.substr(9, 1)).where("lang is null")).collect()] in ([], ["und"])


def test_language_id_never_reads_what_is_held_out(spark):
    rows = [(i, spoken(lang, i, 20), lang) for i, lang in enumerate(list(SYLLABLES) * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = docs.select("doc_id", langid.held_out(docs.doc_id).alias("h")).where("h").toPandas().doc_id.tolist()
    other = spark.createDataFrame([(i, t, "zz" if i in out else lang) for i, t, lang in rows], "doc_id long, text string, lang string")
    assert "zz" not in langid.train(other).languages


def test_leader_finds_sparse_weights():
    rows = [(i % 2, np.array([i % 2, 5]), np.array([1.0, 1.0])) for i in range(60)]
    w = langid.fit_leader(rows, 2)
    assert w[0, 0] > 0 > w[0, 1] and w[1, 1] > 0 > w[1, 0] and (w[100:] == 0).all()


def test_main_text_of_known_markup(spark):
    page = '<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy now, it is cheap.</div><article><h1>Head &amp; line</h1><p>First par<b>agr</b>aph,\n with  more.<p>Second &eacute; &#x41; <br>line<!-- no --><script>var x="</p>"</script></article><footer>&copy; all</footer></body></html>'
    more = "".join(f"<p>{prose(i, 40)}.</p>" for i in range(6))
    rows = [(i, f"u{i}", page.replace("<p>First", f"<p>{prose(50 + i, 30)}.</p>{more}<p>First")) for i in range(40)]
    rows += [(100, "n", None), (101, "e", ""), (102, "c", "<div class=menu>a</div>"), (103, None, rows[0][2][:300]), (104, "x", page)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.extract(pages).collect()}
    assert got[0].text == f"Head & line {prose(50, 30)}. " + " ".join(prose(i, 40) + "." for i in range(6)) + " First paragraph, with more. Second é A line"
    assert got[0].n_chars == len(got[0].text)
    assert got[100].text == "" and got[101].n_chars == 0
    assert got[104].text == "Head & line First paragraph, with more. Second é A line"


def foreign(opening: str, seed: int) -> tuple[str, list[str], list[str]]:
    """(page, article's texts, others): a page whose article stands in `opening`."""
    r = np.random.default_rng(seed)
    article = [prose(seed, 7), *(prose(seed * 50 + i, int(r.integers(15, 60))) + "." for i in range(int(r.integers(3, 9))))]
    other = [f"{prose(seed * 77 + i, 2)}" for i in range(6)]
    inner = f"<h1>{article[0]}</h1>" + "".join(f"<p>{t}</p>" for t in article[1:])
    end = "".join(f"</{t}>" for t in reversed(re.findall(r"<([A-Za-z]+)", opening)))
    page = f'<html><body><nav><ul>{"".join(f"<li><a href=/>{t}</a></li>" for t in other[:4])}</ul></nav><div class="ad">{other[4]}.</div>{opening}{inner}{end}<footer>&copy; {other[5]}</footer></body></html>'
    return page, article, [*other[:4], other[4] + ".", "© " + other[5]]


@pytest.mark.parametrize("opening", ["<main>", "<ARTICLE>", "<div>", '<div class="post-content">', '<Section id="story">', "<table><tr><td>"])
def test_tables_without_the_article_tag(spark, opening):
    made = [(i, *foreign(opening, i + 1)) for i in range(60)]
    pages = spark.createDataFrame([(i, "u", page) for i, page, _, _ in made], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    hit = sum(t in got[i] for i, _, article, _ in made for t in article)
    wrong = sum(t in got[i] for i, _, _, other in made for t in other)
    total = sum(len(article) for _, _, article, _ in made)
    assert 2 * hit / (total + hit + wrong) > 0.95


def test_extraction_without_pages_or_signals(spark):
    kind = "page_id long, url string, html string"
    assert html_extract.extract(spark.createDataFrame([], kind)).count() == 0
    rows = html_extract.extract(spark.createDataFrame([(None, None, "plain"), (1, "u", "<p></p>"), (1, "u", "<p></p>")], kind)).collect()
    assert sorted(r.page_id or 0 for r in rows) == [0, 1, 1] and all(r.n_chars == len(r.text) for r in rows)
    one = spark.createDataFrame([(1, "u", foreign("<div>", 9)[0])], kind)
    assert html_extract.extract(one).first().text == " ".join(foreign("<div>", 9)[1])


def test_adverts_in_an_article_are_not_of_it():
    page = '<article><h1>Head</h1><p>Text.</p><div class="ad">Buy</div><aside>More</aside><div class="comment"><p>Hm.</p></div></article>'
    found, ys = html_extract.own_labels(page)
    assert [b.text for b, y in zip(found, ys, strict=True) if y] == ["Head", "Text."]


def test_field_on_markup_it_has_not_seen():
    rng = np.random.default_rng(5)
    texts = lambda k: [prose(1000 * k + i, 20 + i) + "." for i in range(8)]
    other = ["Home", "About us", "Log in", "© 2020 all rights", "Buy this"]
    train = [html_extract.labelled(html_extract.set_anew(texts(k), other, rng)) for k in range(250)]
    field = html_extract.train_field(train)
    right = total = 0
    for k in range(60):
        blocks, labels = html_extract.labelled(html_extract.set_anew(texts(500 + k), other, rng))
        right += sum(a == b for a, b in zip(field.labels(blocks), labels, strict=True))
        total += len(labels)
    assert right / total > 0.95


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    blocks = [html_extract.Block(f"w{i} " * int(rng.integers(1, 9)), ("p",)) for i in range(8)]
    f = html_extract.Field(rng.normal(size=1 << html_extract.BITS), rng.normal(size=(2, 2)))
    e = [f.score(("a", i), html_extract.path_features(b.path)) + sum(f.score(x, (x,)) for x in html_extract.text_features(b, i, 8)) for i, b in enumerate(blocks)]

    def worth(y):
        return sum(x for x, k in zip(e, y, strict=True) if k) + sum(f.steps[a, b] for a, b in zip(y[:-1], y[1:], strict=True))

    best = max(([bool(k >> i & 1) for i in range(8)] for k in range(256)), key=lambda y: worth([int(v) for v in y]))
    assert f.labels(blocks) == best


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    rows, centre = [], rng.normal(size=(3, 8))
    for i in range(300):
        v = centre[i % 3] + rng.normal(size=8) * (0.02, 0.15, 0.6)[i % 3]
        rows.append((i, [float(x) for x in v.astype(np.float32)], (1, 2, 1)[i % 3]))
    rows += [(400, rows[0][1], 1), (401, rows[0][1], 1), (402, rows[0][1], 2), (403, None, 1), (404, [0.0] * 8, 1), (405, [float("nan")] * 8, 1), (406, [1.0, None] + [0.0] * 6, 1), (407, rows[0][1], None), (408, rows[0][1][:7], 1), (409, [float("inf")] * 8, 2), (410, [], 1), (411, [x * 3 for x in rows[0][1]], 1)]
    vectors = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, kept string")
    good = [(i, np.array(v, np.float64), k) for i, v, k in rows if v and k is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    parent, n = {i: i for i, _, _ in rows}, {i: 0 for i, _, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, u, k) in enumerate(good):
        for j, v, m in good[:a]:
            if k == m and len(u) == len(v) and u @ v / np.sqrt(u @ u) / np.sqrt(v @ v) >= 0.98:
                n[i] += 1
                n[j] += 1
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    got = embed_dedup.near_duplicates(vectors).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (n[i], find(i), find(i) == i) for i, _, _ in rows}
    assert embed_dedup.near_duplicates(vectors.limit(0)).count() == 0


@pytest.mark.parametrize("few", [0, 1 << 16])
def test_components(spark, few):
    pairs = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 200)] + [(7, 7), (500, 400), (400, 500)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long"), few=few).collect()}
    assert got == {i: 0 for i in range(31)} | {100 + i: 100 for i in range(200)} | {500: 400, 400: 400}
    assert components(spark.createDataFrame([], "a long, b long"), few=few).count() == 0


def test_pipeline(spark, tmp_path):
    """Against brute force: letters, links of shingle sets, benchmark windows, base spans; then ids by the rank library."""
    from tests.llm.test_text_operators import base_spans, linked, tik

    docs = documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    item = prose(2, 80)[:90]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "benchmark", "personal_data", "token_ids"]
    texts = {r.doc_id: r.text for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)}
    texts = {i: texts[i] for i, (_, low) in linked(list(texts.items())).items() if low == i}
    words = item.split()
    windows = [" ".join(words[i : i + 10]) for i in range(len(words) - 9)]

    def clean(text: str) -> str:
        own = [(m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)]
        hit = [False] * len(own)
        for i in range(len(own) - 9):
            if " ".join(text[a:b] for a, b in own[i : i + 10]) in windows:
                hit[i : i + 10] = [True] * 10
        left, at = [], 0
        for i, (a, b) in enumerate(own):
            if hit[i] and not (i and hit[i - 1]):
                left.append(text[at:a])
            if hit[i]:
                at = b
        pieces = [p for p in [*left, text[at:]] if p.strip(" ")]
        text = "\n".join(pieces) if any(hit) else text
        for kind, a, b in sorted(base_spans(text), key=lambda x: -x[1]):
            text = f"{text[:a]}<{kind.upper()}>{text[b:]}"
        return text

    want = {i: clean(t) for i, t in texts.items()}
    assert {i: r.text for i, r in out.items()} == {i: t for i, t in want.items() if t.strip(" ")}
    enc, _ = tik()
    assert all(bytes(r.ids) == np.array(enc.encode_ordinary(r.text), "<u4").tobytes() and r.n_tokens * 4 == len(r.ids) for r in out.values())


def test_pipeline_without_documents(spark, tmp_path):
    docs = documents(spark).limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_operators_bear_nulls_repeats_and_names_of_any_kind(spark):
    """Null ids, repeated rows, and columns named like an operator's own."""
    from provena.llm import bpe, decontam, lm_score, pii, suffix_dedup, token_output
    from provena.llm.queries import vocabulary

    names = "score lang_pred base spans runs row found _text _spans _items _n_words _doc cover ids n_tokens who node".split()
    text = prose(3, 30)
    rows = [(i, t, "en", *["mine"] * len(names)) for i, t in [(None, text), (None, text), (1, text), (1, text), (2, None), (3, ""), (4, text + " a@b.org"), (None, None)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"{n} string" for n in names))
    bench = spark.createDataFrame([(None, text), (1, None)], "item_id long, text string")
    for out in (langid.keep_known(docs), decontam.decontaminate(docs, bench), pii.redact(docs), suffix_dedup.remove_repeats(docs.drop("spans")).drop("spans", "kept"), bpe.encode(docs, *vocabulary(), ids_col="own").drop("own"), jaccard_join.one_of_each(docs)):
        found = out.collect()
        assert all(r[n] == "mine" for r in found for n in names if n in out.columns) and set(out.columns) >= {"doc_id", "text", "lang"}
    assert langid.report(docs).count() == decontam.report(docs, bench).count() == pii.report(docs).count() == bpe.round_trip(docs, *vocabulary()).count() == jaccard_join.groups(docs).count() == suffix_dedup.report(docs).count() == len(rows)
    groups = jaccard_join.groups(docs).collect()
    assert {r.component_id for r in groups if r.n_shingles and r.doc_id in (None, 1)} == {1}
    scored = lm_score.report(docs, spark.createDataFrame([(1, 1), (None, 1)], "doc_id long, quality int")).collect()
    assert len(scored) == len(rows)
    assert token_output.shards(docs, *vocabulary()).selectExpr("sum(n)").first()[0] == 5
    vectors = spark.createDataFrame([(None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(r.n_links for r in embed_dedup.near_duplicates(vectors).collect()) == [2, 2, 2]
