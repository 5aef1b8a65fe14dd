"""Personal data by weak supervision, in DataFrame functions only.

Base patterns give spans that always stay. Wider patterns give candidates besides. Labelers vote on all
matches, those that fail their base check too: strict forms, gazetteers, words before a span, checksums
and what touches it. Expectation-maximisation over the counts of vote patterns estimates how reliable
each labeler is; the posteriors train a logistic classifier on the same features, which decides on the
candidates. Its weights start from, and without evidence stay at, labelers that are right four times of
five. Only counts of patterns reach the driver: there are at most 3 ** LABELERS of them a kind.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.llm.common import kept_table, packed, unpacked

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "name")
LABELERS = 5
#: Probability from which a candidate becomes a span.
ACCEPTED = 0.8
#: Characters before and after a span that labelers see.
AROUND = 32
#: What is taken of labelers before any evidence: how often they are right, and the share of candidates that are personal data.
RIGHT, SHARE = 0.8, 0.3

# The base patterns. Each takes a whole run at once and starts at a run's beginning or where a match ended, so that no text costs more than linear time; the matches are those of the plain patterns.
_LOCAL = "A-Za-z0-9._%+-"
_PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# Words of the labelers.
_KEYS = "token|passwd|password|passwort|secret|api[_-]?key|access[_-]?key|private[_-]?key|bearer|contraseña|clave|mot de passe"
_TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Señor|Señora"
_GIVEN = "John|Mary|James|Anna|Peter|Paul|Maria|José|Juan|Carlos|Hans|Klaus|Jürgen|Sophie|Pierre|Jean|Marie|Michael|David|Sarah|Laura|Thomas|Robert|Linda|Emma|Lucas|Julia|Martin|Ana|Luis"
_NO_NAMES = "Street|Avenue|Road|Square|Hotel|Museum|School|Hospital|Straße|Platz|Rue|Calle|Right|Wrong|President|Chairman|Speaker"
_ENDINGS = "com|org|net|edu|gov|io|de|fr|es|uk|eu|info|biz|ch|at|us"
_CONTEXT = {
    "email": r"(?:e-?mail|mail|contact|write|escrib|schreib|écri|correo)",
    "ip": r"(?:\bip\b|host|server|addr|serveur|servidor|rechner)",
    "card": r"(?:card|visa|master|credit|karte|carte|tarjeta|pay)",
    "phone": r"(?:phone|tel|call|mobile|fax|anruf|rufen|appel|llam|móvil)",
    "secret": rf"(?:{_KEYS})",
    "name": r"(?:name is|i am|called|heiß|m'appelle|me llamo|signed|dear)",
}
_AGAINST = {
    "email": r"(?:handle|import|package)",
    "ip": r"(?:version|release|section|chapter|\bv\.? ?)",
    "card": r"(?:order|tracking|isbn|serial|invoice|account no)",
    "phone": r"(?:part|order|item|serial|ref|invoice|sku|isbn|case|ticket|model|number of|\bno\.|\bnr\.|#)",
    "secret": r"(?:path|file|https?:|www\.|import|include|isbn|doi|slug|href|src)",
    "name": r"(?:street|avenue|st\.|hotel|museum)",
}
_WIDER = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}+ ?[\[({{]\s?(?i:at)\s?[\])}}] ?[A-Za-z0-9-]++(?:(?:\.| ?[\[({{]\s?(?i:dot)\s?[\])}}] ?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+:){7}[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9+)(-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+",
    "name": rf"(?<!\p{{L}})(?:{_TITLES})\.? \p{{Lu}}\p{{Ll}}++(?: \p{{Lu}}\p{{Ll}}++)?(?! (?:{_NO_NAMES})\b)(?<! (?:{_NO_NAMES}))",
}
# What a text with a match surely has.
_HINT = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){12}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
_WIDER_HINT = {
    "email": lambda t: t.rlike(r"(?i)[\[({]\s?at\s?[\])}]"),
    "ip": lambda t: t.rlike(r"(?:[0-9A-Fa-f]{1,4}:){2}"),
    "phone": lambda t: t.rlike(r"[0-9]{3}[-. ][0-9]{4}"),
    "secret": lambda t: t.rlike(r"[0-9]"),
    "name": lambda t: t.rlike(rf"(?:{_TITLES})\.? \p{{Lu}}"),
}
_CHUNK = 128
_SPAN = "array<struct<kind:int,s:int,e:int,m:string>>"


def _let(f, *values: Column) -> Column:
    """f of the values, each of which is computed once a row however often f's own lambdas ask for it."""
    bound = F.array(F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)]))
    return F.element_at(F.transform(bound, lambda z: f(*[z[f"v{i}"] for i in range(len(values))])), 1)


def _wide(text: Column) -> Column:
    """The text with four bytes for each character, so that any of them is found without going through those before."""
    return F.encode(text, "UTF-32")


def _part(wide: Column, start: Column, n: Column) -> Column:
    """n characters of a _wide() text after the first `start`."""
    return F.decode(F.substring(wide, start * 4 + 1, n * 4), "UTF-32")


def _covered(spans: Column) -> Column:
    """A byte 1 for each character that spans, in order and apart from one another, have; 0 for others up to the last span's end."""

    def step(own: Column) -> Column:
        part = lambda c, i: F.concat(F.repeat(F.lit("0"), c["s"] - F.coalesce(F.get(own, i - 1)["e"], F.lit(0))), F.repeat(F.lit("1"), c["e"] - c["s"]))
        return F.encode(F.array_join(F.transform(own, part), ""), "UTF-8")

    return _let(step, spans)


def _touches(c: Column, covered: list[Column]) -> Column:
    """Whether a span has a character that one of these has."""
    return reduce(lambda a, b: a | b, [F.contains(F.substring(m, c["s"] + 1, c["e"] - c["s"]), F.encode(F.lit("1"), "UTF-8")) for m in covered], F.lit(False))


def _apart(spans: Column, covered: list[Column]) -> Column:
    return F.filter(spans, lambda c: ~_touches(c, covered))


def _found(text: Column, pattern: str, kind: int, hint: Column) -> Column:
    """All matches, as (kind, start, end, match). Starts are running sums of what lies between and within matches, by chunks."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)

    def placed(matches: Column, gaps: Column) -> Column:
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.length(g) + F.length(m))
        return _let(chunks, matches, steps)

    def chunks(matches: Column, steps: Column) -> Column:
        def chunk(c: Column) -> Column:
            return _let(spans, total(F.slice(steps, F.lit(1), c * _CHUNK)), F.slice(steps, c * _CHUNK + 1, F.lit(_CHUNK)), F.slice(matches, c * _CHUNK + 1, F.lit(_CHUNK)))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / _CHUNK).cast("int")), chunk))

    def spans(before: Column, steps: Column, matches: Column) -> Column:
        def span(m: Column, i: Column) -> Column:
            return _let(lambda end: F.struct(F.lit(kind).alias("kind"), (end - F.length(m)).alias("s"), end.alias("e"), m.alias("m")), before + total(F.slice(steps, F.lit(1), i + 1)))

        return F.transform(matches, span)

    found = lambda matches: F.when(F.size(matches) > 0, _let(placed, matches, F.split(text, pattern, -1)))
    return F.when(hint, _let(found, F.regexp_extract_all(text, F.lit(pattern), 0)))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    d = _digits(m)

    def worth(i: Column) -> Column:
        x = F.substring(d, F.length(d) - i, F.lit(1)).cast("int") * (1 + i % 2)
        return F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(d) - 1), worth), F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return ~F.exists(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) > 3) | (F.right(p, F.lit(3)).cast("int") > 255))
    if kind == "card":
        return F.length(_digits(m)).between(13, 19) & luhn(m)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _holds(kind: str):
    return lambda c: _valid(kind, c["m"])


def _is(kind: int):
    return lambda c: c["kind"] == kind


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(left: Column, after: Column, c: Column, kind: str) -> list[Column]:
    """One of -1, 0, 1 by each labeler: strict form, gazetteer, context, checksum, what touches the span. left: what stands before it, in small letters; after: the character after it."""
    m, before = c["m"], F.right(left, F.lit(1))
    context = F.when(left.rlike(_CONTEXT[kind]), 1).when(left.rlike(_AGAINST[kind]), -1).otherwise(0)
    touched = before.rlike(r"[\p{L}0-9]") | after.rlike(r"[\p{L}0-9]")
    touch = _vote(~touched & ((before == "") | before.isin('"', "'", "(", "<", ":", "=")), touched)
    never = F.lit(False)
    if kind == "email":
        own = [_vote(m.rlike(rf"^[A-Za-z0-9][{_LOCAL}]*(?:@| ?[\[({{])"), m.rlike(r"^[._%+-]")), _vote(m.rlike(rf"(?i)(?:{_ENDINGS})$"), m.rlike(r"[0-9]$")), _vote(F.length(m).between(6, 80), F.length(m) > 200)]
    elif kind == "ip":
        v4 = F.contains(m, F.lit("."))
        own = [_vote(m.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$") | (~v4 & m.rlike("[0-9A-Fa-f]{3}")), m.rlike(r"[0-9]{4}") & v4), _vote(m.rlike(r"^(?:10|127|169|172|192)\.") | m.rlike(r"^(?i:[0-9a-f]*:)*(?i:[0-9]*[a-f])"), m.rlike(r"^0") | (~v4 & ~m.rlike("[0-9A-Fa-f]{2}"))), _vote(_valid("ip", m), v4 & ~_valid("ip", m))]
    elif kind == "card":
        n = F.length(_digits(m))
        own = [_vote((n == 16) | (n == 15), n == 13), _vote(m.rlike(r"^(?:4|5[1-5]|3[47]|6)"), m.rlike(r"^[0179]")), _vote(luhn(m), ~luhn(m))]
    elif kind == "phone":
        n = F.length(_digits(m))
        own = [_vote(m.rlike(r"^\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]|^\([0-9]{3}\)"), m.rlike(r"[ ().-]{3}")), _vote(m.rlike(r"^\+(?:1|33|34|44|49|41|43)"), m.rlike(r"^\+0")), _vote(n.between(9, 15) & m.rlike(r"^\+"), (n < 9) | (n > 15))]
    elif kind == "secret":
        # Paths, slugs and names in code are words and short numbers; random strings change between letters, capitals and digits all the time.
        words = m.rlike(r"^(?:[/_+-]|[A-Z]?[a-z]{2,}+|[A-Z]{2,}+(?![a-z])|[0-9]{1,4}+(?![0-9]))*+$")
        changes = F.regexp_count(m, F.lit(r"(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]|(?<=[a-z])[A-Z]"))
        own = [_vote(~words & m.rlike(r"[0-9].*[0-9].*[0-9]") & m.rlike("[A-Za-z]"), words | ~m.rlike("[A-Za-z]")), _vote(left.rlike(rf"(?:{_KEYS})[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?$"), ~left.rlike(r"[:=]\s{0,3}[\"']?$")), _vote(changes * 6 >= F.length(m), (changes * 12 < F.length(m)) & ~m.rlike("^[0-9a-f]{32,}$"))]
    else:
        own = [_vote(m.rlike(rf"^(?:{_TITLES})\.? "), never), _vote(m.rlike(rf" (?:{_GIVEN})\b"), never), _vote(F.length(m) < 40, F.length(m) > 60)]
    return [own[0], own[1], context, own[2], touch]


def _judged(wide: Column, spans: Column, kind: str) -> Column:
    """The spans with their votes, as a string of 0, 1, 2 for -1, 0, 1."""

    def judge(c: Column) -> Column:
        left = F.lower(_part(wide, F.greatest(c["s"] - AROUND, F.lit(0)), F.least(c["s"], F.lit(AROUND))))
        votes = _let(lambda left, after: F.concat(*[(v + 1).cast("string") for v in _votes(left, after, c, kind)]), left, _part(wide, c["e"], F.lit(1)))
        return F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e"), votes.alias("v"))

    return F.transform(spans, judge)


def _none(kind: str) -> Column:
    return F.expr(f"cast(array() as {kind})")


def _or_none(a: Column, kind: str) -> Column:
    return F.coalesce(a, _none(kind))


_VOTED = "array<struct<kind:int,s:int,e:int,v:string>>"


def _spotted(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(row: docs' columns `keep`, base: spans of the base patterns that hold, wider: voted candidates that touch none of them, seen: votes on all matches of the base patterns)."""
    out = docs.select(packed(docs, keep), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    t = F.col("t")
    out = out.withColumns({f"b{i}": _found(t, _PATTERNS[k], i, _HINT[k](t)) for i, k in enumerate(BASE)} | {f"w{KINDS.index(k)}": _found(t, p, KINDS.index(k), _WIDER_HINT[k](t)) for k, p in _WIDER.items()})
    some = reduce(lambda x, y: x | y, [F.col(f"b{i}").isNotNull() for i in range(len(BASE))] + [F.col(f"w{KINDS.index(k)}").isNotNull() for k in _WIDER])

    def told(wide: Column, *found: Column) -> Column:
        by_kind, wider = found[: len(BASE)], dict(zip(_WIDER, found[len(BASE) :], strict=True))
        held = [F.filter(_or_none(c, _SPAN), _holds(k)) for c, k in zip(by_kind, BASE, strict=True)]

        def judged(*held: Column) -> Column:
            apart = [_let(lambda *v: _apart(v[0], list(v[1:])), _or_none(spans, _SPAN), *map(_covered, held)) for spans in wider.values()]
            votes = [F.when(F.size(spans) > 0, _judged(wide, apart_k, k)) for (k, spans), apart_k in zip(wider.items(), apart, strict=True)]
            seen = [F.when(F.size(c) > 0, _judged(wide, c, k)) for c, k in zip(by_kind, BASE, strict=True)]
            join = lambda parts: F.concat(*[_or_none(x, _VOTED) for x in parts])
            return F.struct(F.concat(*held).alias("base"), join(votes).alias("wider"), join(seen).alias("seen"))

        return _let(judged, *held)

    each = [F.col(f"b{i}") for i in range(len(BASE))] + [F.col(f"w{KINDS.index(k)}") for k in _WIDER]
    nothing = F.struct(_none(_SPAN).alias("base"), _none(_VOTED).alias("wider"), _none(_VOTED).alias("seen"))
    out = out.withColumn("told", F.when(some, _let(told, _wide(t), *each)).otherwise(nothing)).select("row", "told.*")
    plain = F.transform("base", lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e")))
    return out.select("row", F.array_sort(plain).alias("base"), "wider", F.transform("seen", lambda c: F.struct(c["kind"].alias("kind"), c["v"].alias("v"))).alias("seen"))


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns: (posterior of each pattern, share of each vote by labeler and truth)."""
    weight = counts.astype(float)
    p = 1 / (1 + np.exp(-votes.sum(axis=1).astype(float)))
    for _ in range(rounds):
        shares = np.zeros((votes.shape[1], 2, 3))
        prior = (weight @ p + 1) / (weight.sum() + 2)
        logit = np.full(len(votes), np.log(prior / (1 - prior)))
        for j in range(votes.shape[1]):
            for y, q in ((0, 1 - p), (1, p)):
                n = np.array([(weight * q)[votes[:, j] == v].sum() for v in (-1, 0, 1)])
                # A labeler is taken to be right more often than wrong, as so many votes before the first.
                n += np.array([1.0, 1.0, 4.0]) if y else np.array([4.0, 1.0, 1.0])
                shares[j, y] = n / n.sum()
            logit += np.log(shares[j, 1, votes[:, j] + 1] / shares[j, 0, votes[:, j] + 1])
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - p).max() < 1e-6:
            p = new
            break
        p = new
    return p, shares


def untrained(labelers: int = LABELERS) -> np.ndarray:
    """Weights before any evidence."""
    sure = np.log(RIGHT / (1 - RIGHT))
    return np.concatenate([np.tile([-sure, 0.0, sure], labelers), [np.log(SHARE / (1 - SHARE))]])


def classifier(votes: np.ndarray, counts: np.ndarray, p: np.ndarray, rounds: int = 400, rate: float = 0.5, ridge: float = 0.002) -> np.ndarray:
    """Weights of a logistic classifier on the votes (three indicators a labeler, then the constant), fitted to the posteriors; a ridge holds them at what is taken of labelers, so votes never seen keep that."""
    x = np.concatenate([(votes[:, :, None] == np.array([-1, 0, 1])).reshape(len(votes), -1), np.ones((len(votes), 1))], axis=1).astype(float)
    share, taken = counts / counts.sum(), untrained(votes.shape[1])
    w = taken.copy()
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= rate * (x.T @ (share * (q - p)) + ridge * (w - taken))
    return w


def _fitted(found: DataFrame) -> dict[str, np.ndarray]:
    votes_of = lambda a: F.transform(a, lambda c: F.struct(c["kind"].alias("kind"), c["v"].alias("v")))
    counts = found.select(F.explode(F.concat(votes_of("wider"), votes_of("seen"))).alias("c")).groupBy("c.kind", "c.v").count().collect()
    out = {}
    for i, k in enumerate(KINDS):
        own = [r for r in counts if r["kind"] == i]
        if own:
            votes, n = np.array([[int(x) - 1 for x in r["v"]] for r in own]), np.array([r["count"] for r in own])
            out[k] = classifier(votes, n, estimate(votes, n)[0])
    return out


def fit(docs: DataFrame) -> dict[str, np.ndarray]:
    """Weights by kind, from the candidates and base matches of all documents. Kinds without any are absent; untrained() holds for them."""
    return _fitted(_spotted(docs, ["text"]))


def _decided(docs: DataFrame, weights: dict[str, np.ndarray] | None, keep: list[str]) -> DataFrame:
    """(row, base, spans). Without weights, what one scan spots is kept, the weights are fitted to it, and it is decided."""
    found = _spotted(docs, keep)
    if weights is None:
        found = kept_table(found, "personal-data")
        weights = _fitted(found)
    plain = lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e"))
    weights = {k: weights.get(k, untrained()) for k in KINDS}
    # One flat list: a kind's LABELERS times three weights and its constant.
    table, width = F.array(*[F.lit(float(x)) for k in KINDS for x in weights[k]]), 3 * LABELERS + 1

    def accepted(c: Column, table: Column) -> Column:
        parts = [F.get(table, c["kind"] * width + j * 3 + F.substring(c["v"], j + 1, 1).cast("int")) for j in range(LABELERS)]
        return reduce(lambda a, b: a + b, parts, F.get(table, c["kind"] * width + width - 1)) >= float(np.log(ACCEPTED / (1 - ACCEPTED)))

    def sole(extra: Column) -> Column:
        """Candidates of different kinds may name one place: the earlier kind has it."""
        own = [F.filter(extra, _is(KINDS.index(k))) for k in _WIDER]

        def apart(*own: Column) -> Column:
            def among(*covered: Column) -> Column:
                return F.concat(*[_apart(spans, list(covered[:i])) if i else spans for i, spans in enumerate(own)])

            return _let(among, *map(_covered, own))

        return F.when(F.size(extra) > 1, _let(apart, *own)).otherwise(extra)

    extra = F.when(F.size("wider") > 0, _let(lambda wider, table: F.transform(F.filter(wider, lambda c: accepted(c, table)), plain), F.col("wider"), table)).otherwise(_none("array<struct<kind:int,s:int,e:int>>"))
    out = found.select("row", "base", _let(sole, extra).alias("extra"))
    return out.select("row", "base", F.array_sort(F.concat("base", "extra")).alias("spans"))


def find(docs: DataFrame, weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """docs with `base` and `spans`: arrays of (kind, s, e), by kind as in KINDS, then start; s and e count characters.

    A null text is as an empty one: no spans. base spans stay in spans. Rows that repeat a doc_id are
    looked at each. Columns named like the new ones are replaced, others stay whatever their names.
    """
    kept = [c for c in docs.columns if c not in ("base", "spans")]
    return _decided(docs, weights, kept).select(*unpacked(kept), "base", "spans")


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.element_at(names, c["kind"] + 1), c["s"].cast("string"), c["e"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per document: base spans by kind, a digest of them, and all spans."""
    out = _decided(docs, None, ["doc_id"])
    n = [F.size(F.filter("base", _is(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return out.select(*unpacked(["doc_id"]), *n, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """docs with each span, or run of spans that overlap, replaced by its kind in angle brackets.

    Texts without spans stay as they are, null too; n_chars, if present, follows a changed text. No other
    column is changed, whatever its name.
    """
    found = _decided(docs, weights, docs.columns)
    by_start = F.array_sort(F.transform("spans", lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["kind"].alias("kind"))))

    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    text = F.col("row").getField("text")

    def cleaned(spans: Column, wide: Column, names: Column) -> Column:
        ends = F.transform(spans, lambda c: c["e"])
        tops = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / _CHUNK).cast("int")), lambda k: F.array_max(F.slice(ends, k * _CHUNK + 1, _CHUNK)))

        def joined(ends: Column, tops: Column) -> Column:
            def piece(c: Column, i: Column) -> Column:
                # Where the spans before this one end: by whole chunks, then within its own.
                k = F.floor(i / _CHUNK).cast("int")
                before = F.greatest(F.lit(0), F.array_max(F.slice(tops, F.lit(1), k)), F.array_max(F.slice(ends, k * _CHUNK + 1, i - k * _CHUNK)))
                return _let(lambda b: F.when(c["s"] >= b, F.concat(_part(wide, b, c["s"] - b), F.get(names, c["kind"]))).otherwise(""), before)

            return F.concat(F.array_join(F.transform(spans, piece), ""), _part(wide, F.array_max(tops), F.length(text)))

        return _let(joined, ends, tops)

    hit = F.size("spans") > 0
    out = found.withColumn("text", F.when(hit, _let(cleaned, by_start, _wide(text), names)).otherwise(text))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(hit, F.length("text")).otherwise(F.col("row").getField("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[changed[c].alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in docs.columns])
