"""Operators on texts against brute force."""

import base64
import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from provena.llm import bpe, decontam, jaccard_join, lm_score, pii, suffix_dedup, token_output
from provena.llm.queries import vocabulary
from tests.llm.fixtures import documents, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def tik():
    import tiktoken

    path, pattern = vocabulary()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), ranks


def test_bpe_round_trip(spark):
    docs, (enc, _) = documents(spark), tik()
    got = bpe.round_trip(docs, *vocabulary()).collect()
    assert len(got) == docs.count()
    want = Counter()
    for r in docs.collect():
        ids = enc.encode_ordinary(r.text or "")
        want[r.doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((r.text or "").encode())] += 1
    assert Counter(map(tuple, got)) == want
    assert bpe.round_trip(docs.limit(0), *vocabulary()).count() == 0


def test_bpe_offsets(spark):
    d = spark.createDataFrame([(1, "né 😀x"), (2, None)], "doc_id long, text string")
    one, none = bpe.encode(d, *vocabulary(), offsets=True).orderBy("doc_id").collect()
    text = "né 😀x"
    assert one.char_starts[0] == 0 and one.char_ends[-1] == len(text)
    assert set().union(*(range(a, b) for a, b in zip(one.char_starts, one.char_ends, strict=True))) == set(range(len(text)))
    assert bytes(none.ids) == b"" and none.char_starts == []


def test_bpe_ties_between_pairs():
    path, pattern = vocabulary()
    with open(path, "rb") as f:
        own = bpe.Codec(f.read(), pattern)
    enc, _ = tik()
    for s in ("anananan", "hahahah", "aaaaaaa", "\x1c  x", "ééé", bpe.BETWEEN + "a", "it's 12345 !!!\r\n\r\n  "):
        assert own.encode([s])[0] == np.array(enc.encode_ordinary(s), "<u4").tobytes()


def test_decontamination(spark):
    docs = documents(spark)
    items = [(1, prose(1, 120)[:90]), (2, "ONE two, three"), (3, None), (4, "..."), (5, "one two three"), (6, prose(9, 12))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    want = Counter()
    for r in docs.collect():
        w, hit, found = words(r.text), set(), set()
        for i, t in items:
            x = words(t)
            n = min(10, len(x))
            for g in {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if n else ():
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) == g:
                        hit |= set(range(k, k + n))
                        found.add(str(i))
        want[r.doc_id, len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit)] += 1
    for part in (decontam.PART_BYTES, 60):
        assert Counter(map(tuple, decontam.report(docs, bench, part_bytes=part).collect())) == want
    out = {r.doc_id: r for r in decontam.decontaminate(docs, bench).collect()}
    assert out[8].text == "" and out[8].n_chars == 0 and out[4].text == prose(2, 80) and out[5].text is None
    assert decontam.decontaminate(docs, bench, "documents").where("doc_id in (8, 9, 1)").count() == 0
    assert decontam.decontaminate(docs, bench).columns == docs.columns
    assert decontam.report(docs, bench.limit(0)).where("contaminated").count() == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def linked(rows):
    low = {}
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    for i, s in sets:
        low[i] = (len(s), find(i))
    return low


def test_jaccard_join(spark):
    base = prose(20, 60).split()
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    for k in range(40):  # a chain and a group of near copies, more than FEW
        w = list(base)
        for j in range(k % 7):
            w[(11 * j + k) % 60] = f"new{k}x{j}"
        rows.append((100 + k, " ".join(w)))
    for k in range(30):  # texts that share a long passage and little else
        rows.append((200 + k, prose(40, 25) + " " + prose(300 + k, 30)))
    for k in range(12):
        rows.append((300 + k, " ".join(prose(60, 9).split()[: 3 + k % 7])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.groups(docs).collect()}
    assert got == linked(rows)
    kept = jaccard_join.one_of_each(documents(spark))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6, 7, 8, 10, 11, 12, 13, 14, 15, 17]
    assert kept.columns == documents(spark).columns
    assert jaccard_join.groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", range(1, 90))
def test_leads_lose_no_link(n):
    for m in range(n, 4 * n // 3 + 1):
        assert n - jaccard_join.need(n, m) + 1 <= jaccard_join.lead_up(n)
        assert m - jaccard_join.need(n, m) + 1 <= jaccard_join.lead(m) or 100 * n < 75 * m


def removed(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            first[w] = min(first.get(w, i), i)
    out = Counter()
    for i, t in rows:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                cover[p : p + 50] = b"\x01" * 50
        runs = sum(1 for k in range(len(b)) if cover[k] and not (k and cover[k - 1]))
        out[i, len(b), sum(cover), runs, sha(bytes(x for x, c in zip(b, cover, strict=True) if not c))] += 1
    return out


def test_suffix_dedup(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    line = prose(70, 8)
    rows += [(400 + k, prose(500 + k, 12) + " " + line[: 50 + k % 9] + " " + prose(600 + k, 12)) for k in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, suffix_dedup.report(docs).collect())) == removed(rows)
    assert suffix_dedup.report(docs.limit(0)).count() == 0


@pytest.mark.parametrize("most_bits", [suffix_dedup.MAP_BITS, 64])
def test_suffix_dedup_of_hot_anchors(spark, most_bits):
    line, rows = prose(72, 9), [(1, "over and over. " * 300), (2, prose(74, 5) + "over and over. " * 90), (None, "over and over. " * 9)]
    rows += [(3 + k, prose(900 + k, 9) + " " + line[k % 3 : 60 + k % 9] + "\n" + prose(1200 + k, 9)) for k in range(220)]
    docs = spark.createDataFrame([(*r, "clash", "x") for r in rows], "doc_id long, text string, _doc string, cover string").repartition(2)
    got = Counter(tuple(r) for r in suffix_dedup.report(docs, most_bits).collect() if r.doc_id is not None)
    assert got == removed([r for r in rows if r[0] is not None])
    out = suffix_dedup.remove_repeats(docs, most_bits)
    assert out.columns == ["doc_id", "text", "_doc", "cover", "spans", "kept"] and {r["_doc"] for r in out.collect()} == {"clash"}


def test_suffix_comparison_of_large_runs():
    """Runs handed on as hashes cover the same bytes as sorted ones."""
    line = (prose(71, 12) + " ")[:70]
    texts = [prose(700 + k, 10) + line + prose(800 + k, 10) for k in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), pa.array(texts)], ["doc_id", "text"])

    class All:
        value = np.full(1024, 255, np.uint8)

    near = pa.Table.from_batches(list(suffix_dedup._wanted(All)([batch]))).sort_by([("key", "ascending"), ("ctx", "ascending"), ("doc", "ascending")])

    def covered(**how):
        cover, least, hashed = set(), {}, []
        for b in suffix_dedup._compared(near.to_batches(max_chunksize=37), **how):
            for r in b.to_pylist():
                if r["h1"] is None:
                    cover |= {(r["doc"], x) for x in range(r["lo"], r["hi"])}
                else:
                    hashed.append(r)
                    least[r["h1"], r["h2"]] = min(least.get((r["h1"], r["h2"]), 1 << 60), r["doc"])
        for r in hashed:
            if r["doc"] > least[r["h1"], r["h2"]]:
                cover |= {(r["doc"], x) for x in range(r["lo"], r["hi"])}
        return cover, len(hashed)

    plain, none = covered()
    split, some = covered(most=20, together=10)
    assert plain and plain == split and not none and some


def test_deep_shallow_sorts():
    rng = np.random.default_rng(1)
    rows = rng.integers(97, 99, (400, 50)).astype(np.uint8)
    rows[100:300, :48] = rows[0, :48]
    rows[300:350] = rows[7]
    order, group = suffix_dedup.deep_shallow(rows, np.zeros(400, np.int64))
    strings = [rows[i].tobytes() for i in order]
    assert strings == sorted(strings)
    assert all((strings[i] == strings[i - 1]) == (group[i] == group[i - 1]) for i in range(1, 400))
    by, common = suffix_dedup.blind_trie(rows[:120])
    strings = [rows[i].tobytes() for i in by]
    assert strings == sorted(strings)
    for i in range(1, 120):
        differ = [k for k in range(50) if strings[i][k] != strings[i - 1][k]]
        assert common[i] == (differ[0] if differ else 50)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def good(kind, m):
        d = re.sub(r"[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            worth = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
            return 13 <= len(d) <= 19 and sum(x - 9 if x > 9 else x for x in worth) % 10 == 0
        return kind != "phone" or 9 <= len(d) <= 15

    return [(k, m.start(), m.end()) for k in PATTERNS for m in re.finditer(PATTERNS[k], text or "") if good(k, m.group())]


def test_pii(spark):
    odd = ["a@b.c_x@d.e", "x@y.z.", "..@a-.b", "1.2.3.4.5.6.7.8", "1.2.3.256 001.002.003.0004", "4111-1111-1111-1111 4111 1111 1111 1112", "+1 23 +49 (0)30 123456-7", "+1 2", "é😀 q@w.er 10.0.0.1", "7" * 40, " ".join(f"u{i}@h.io" for i in range(300)), 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" then me [at] home (dot) org', "a" * 20000 + "@", "1" * 20000]
    rows = [(i, t) for i, t in enumerate(odd)] + [(100 + r.doc_id, r.text) for r in documents(spark).collect()]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    want = Counter()
    for i, t in rows:
        s = base_spans(t)
        want[(i, *(sum(x[0] == k for x in s) for k in PATTERNS), sha(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()))] += 1
    got = pii.report(docs).collect()
    assert Counter(tuple(r)[:6] for r in got) == want
    by = {r.doc_id: r.spans for r in got}
    assert "secret:9:49" in by[11].split(",")
    for i, t in rows:
        assert {f"{k}:{a}:{b}" for k, a, b in base_spans(t)} <= set(by[i].split(","))
    out = {r.doc_id: r.text for r in pii.redact(docs, {}).collect()}
    assert out[8] == "é😀 <EMAIL> <IP>" and out[105] is None
    assert pii.report(docs.limit(0)).count() == 0


def test_pii_takes_the_whole_of_a_long_secret(spark):
    run = "Ab3-dE5_gH7/jK9+" * 300
    rows = [(i, f'{k} = "{run[:n]}" then more') for i, (k, n) in enumerate([("token", 60), ("secret", 201), ("api_key", 4800)])] + [(9, "nothing here")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    by = {r.doc_id: r.spans.split(",") for r in pii.report(docs).collect()}
    assert "secret:9:69" in by[0] and "secret:10:211" in by[1] and "secret:11:4811" in by[2]
    for r in pii.redact(docs).collect():
        assert "Ab3" not in r.text and "jK9" not in r.text


LURES = {
    "secret": ["see /usr/local/lib/python3/site-packages/numpy for it", "slug: the-quick-brown-fox-jumps-over-13-dogs", "A" * 20 + "1", "import provena_operators_suite_module2", "on 2024-01-01-monday-morning-meeting-notes", "id 12345678901234567890123"],
    "phone": ["part no. 555-123-4567 fits", "order 555 123 4567 came", "serial (555) 123-4567"],
    "ip": ["version 1:2:3:4:5:6:7:8 of it"],
}


def _planted(seed: int) -> tuple[str, str, str]:
    """(before, personal data of an added kind, kind)."""
    r = np.random.default_rng(seed)
    hexes = lambda n: "".join(r.choice(list("0123456789abcdef"), n))
    base64_ = lambda n: "".join(r.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), n))
    digits = lambda n: "".join(map(str, r.integers(0, 10, n)))
    return [
        ('token = "', base64_(32), "secret"), ("api_key: ", hexes(40), "secret"), ("password=", base64_(24) + "9a8", "secret"),
        ("write to mail ", f"joe{digits(2)} [at] host{digits(1)} [dot] org", "email"), ("call me: ", f"({digits(3)}) 555-{digits(4)}", "phone"),
        ("host addr ", ":".join(hexes(4) for _ in range(8)), "ip"),
    ][seed % 6]


@pytest.mark.parametrize("with_lures", [True, False])
def test_pii_finds_what_is_added_and_leaves_lures(spark, with_lures):
    rows, want = [], {}
    for i in range(180):
        before, data, kind = _planted(i)
        start = f"{prose(i, 5)} {before}"
        rows.append((i, f"{start}{data} {prose(i + 500, 4)}"))
        want[i] = f"{kind}:{len(start)}:{len(start) + len(data)}"
    lures = [(1000 + i, f"{prose(i, 5)} {t} {prose(i, 4)}") for i, t in enumerate([x for v in LURES.values() for x in v] * 6)]
    docs = spark.createDataFrame(rows + (lures if with_lures else []), "doc_id long, text string")
    weights = pii.fit(docs)
    of = lambda d: {r.doc_id: [f"{pii.KINDS[x.kind]}:{x.s}:{x.e}" for x in r.spans] for r in pii.find(d, weights).collect()}
    found = of(docs)
    right = sum(want[i] in found[i] for i in want)
    said = sum(len(found[i]) for i in found)
    assert right / len(want) >= 0.9 and right / said >= 0.9
    # Lures are left alone by a model that saw none as well.
    assert sum(map(len, of(spark.createDataFrame(lures, "doc_id long, text string")).values())) <= len(lures) // 10


def test_pii_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "mail a@b.org", "x", 3, "y", "z")], "doc_id long, text string, base string, runs int, row string, spans string")
    out = pii.redact(docs).first()
    assert out.asDict() == {"doc_id": 1, "text": "mail <EMAIL>", "base": "x", "runs": 3, "row": "y", "spans": "z"}


def test_pii_reliabilities():
    votes = np.array([[1, 1, 1], [1, 1, 0], [-1, -1, -1], [1, -1, 0], [-1, -1, 1]])
    p, shares = pii.estimate(votes, np.array([50, 20, 60, 3, 4]))
    assert p[0] > 0.95 and p[1] > 0.9 and p[2] < 0.05
    w = pii.classifier(votes, np.array([50, 20, 60, 3, 4]), p)
    assert w[2] > w[0] and np.allclose(shares.sum(axis=2), 1)


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000, 4097])
def test_feistel_is_a_permutation(n):
    a, b = (token_output.feistel(np.arange(n), n, key) for key in (1, 2))
    assert sorted(a) == list(range(n))
    assert n < 64 or (a != b).any()


def test_token_output(spark):
    docs, (enc, ranks) = documents(spark), tik()
    path, pattern = vocabulary()
    made = token_output.shards(docs, path, pattern, length=16, shard=32)
    want = Counter()
    for r in docs.collect():
        if r.text:
            ids = [*enc.encode_ordinary(r.text), len(ranks)]
            for k in range(0, len(ids), 16):
                x = ids[k : k + 16]
                want[r.doc_id, k // 16, len(x), np.array(x + [len(ranks)] * (16 - len(x)), "<u2").tobytes()] += 1
    rows = token_output.read_on(made, 0, 32).collect()
    assert Counter((r.doc_id, r.place, r.tokens, bytes(r.data)) for r in rows) == want
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert token_output.read_on(made, 40, 32).count() == len(rows) - 40
    assert token_output.shards(docs.limit(0), path, pattern).count() == 0


def test_lm_score(spark):
    docs = documents(spark).dropDuplicates(["doc_id"])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    target = {1, 4, 14}
    labels = spark.createDataFrame([(i, int(i in target)) for i, _ in rows], "doc_id long, quality int")
    words = {i: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER)) for i, t in rows}
    single, pair, begins = [Counter(), Counter()], [Counter(), Counter()], [0, 0]
    for i, x in words.items():
        for m in ((0, 1) if i in target else (1,)):
            single[m].update(x)
            pair[m].update(zip(["<"] + x, x, strict=False))
            begins[m] += bool(x)
    size = len(single[1]) + 1
    total = [sum(c.values()) for c in single]
    for m in (0, 1):
        single[m]["<"] = begins[m]
    after = [Counter(), Counter()]
    for m in (0, 1):
        for (v, _), n in pair[m].items():
            after[m][v] += n
    got = {r.doc_id: r for r in lm_score.report(docs, labels).collect()}
    for i, x in words.items():
        if not x:
            assert got[i].n_words == 0 and got[i].score is None
            continue
        own, own_pair, own_after = Counter(x), Counter(zip(["<"] + x, x, strict=False)), Counter((["<"] + x)[: len(x)])
        for m, name in ((0, "loss_target"), (1, "loss_background")):
            less, loss = int(m == 1 or i in target), 0.0
            for v, w in zip(["<"] + x, x, strict=False):
                seen = single[m][v] - less * own[v] - (less if v == "<" else 0)
                p = (pair[m][v, w] - less * own_pair[v, w]) / seen if seen > 0 else 0
                share = (after[m][v] - less * own_after[v]) / seen if seen > 0 else 0
                loss -= math.log(0.6 * p + (0.35 + 0.6 * (1 - share)) * (single[m][w] - less * own[w]) / (total[m] - less * len(x)) + 0.05 / size)
            assert got[i][name] == pytest.approx(loss / len(x), abs=1e-9)
    assert lm_score.report(docs.limit(0), labels).count() == 0


def test_lm_score_keeps_every_word(spark):
    rows = [(i, " ".join(f"w{i}x{k} of w{(i * 7 + k) % 500}" for k in range(1800))) for i in range(40)]
    rows += [(40, "w0x1 of w1 w39x1799 of"), (41, None), (42, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    texts = {i: (t or "").split() for i, t in rows}
    pairs = lambda x: list(zip(["<"] + x, x, strict=False))
    marked = lm_score.chosen(docs, labels.where("quality = 1"))
    got = {r.doc_id: r for r in lm_score.score(marked, chunk_bytes=200_000).collect()}
    assert len({w for x in texts.values() for w in x}) > 1 << 16 and sorted(got) == sorted(texts)
    assert got[41].n_words == got[42].n_words == 0 and got[41].score is None
    for i in (0, 1, 39, 40):
        for name, ids in (("loss_target", [j for j in texts if j % 2]), ("loss_background", list(texts))):
            single, pair, after, loss = Counter(), Counter(), Counter(), 0.0
            for j in ids:
                if j != i and texts[j]:
                    single.update(["<"] + texts[j])
                    pair.update(pairs(texts[j]))
                    after.update(v for v, _ in pairs(texts[j]))
            total, even = sum(single.values()) - single["<"], 1 / (1 + len({w for x in texts.values() for w in x}))
            for v, w in pairs(texts[i]):
                p, share = (pair[v, w] / single[v], after[v] / single[v]) if single[v] else (0, 0)
                loss -= math.log(0.6 * p + (0.35 + 0.6 * (1 - share)) * single[w] / total + 0.05 * even)
            assert got[i][name] == pytest.approx(loss / len(texts[i]), abs=1e-9)
