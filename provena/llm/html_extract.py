"""Main text of web pages: a linear-chain conditional random field over a page's leaf blocks.

A block is the text between two block-level tags. Its features are the tags, classes, ids and roles of
what it stands in, and how its text looks. The field is trained on labelled pages: of a bounded sample
those that mark their article as such, pages set anew from the sample's own blocks in other markup, and
pages set of drawn words, where it is known which blocks are article. So no table leaves the field
untrained, whatever its markup. Viterbi's path labels the blocks of every page.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.llm.common import modest_batches, text_slices

#: Labelled pages are made from at most so many pages.
SAMPLE_PAGES = 240
#: Pages set anew for each sampled one, and pages set of drawn words.
ANEW, DRAWN = 5, 200
#: A page set anew has at most so many blocks of article, drawn from all of the page's.
MOST_BLOCKS = 24
BITS = 14
#: A sampled page whose blocks stand in so many open tags, all told, is set anew but not trained on itself.
MOST_STEPS = 200_000

# Fixed values of the markup language.
_BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html iframe label legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea xmp iframe noembed noframes template svg math".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
_SCOPES = frozenset("ul ol dl table select body html article section div".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.DOTALL)
_NAMES = re.compile(r"(?:^|\s)(class|id|role|itemprop)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))", re.IGNORECASE)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Path:
    """What a block stands in: an open tag with those of its features that nothing around it has, and the tag around it."""

    __slots__ = ("parent", "tag", "new", "depth", "known")

    def __init__(self, parent: Path | None, tag: str, new: tuple[str, ...]):
        self.parent, self.tag, self.new = parent, tag, new
        self.depth: int = parent.depth + 1 if parent else 1
        self.known: dict[object, object] = {}

    def __iter__(self):
        at: Path | None = self
        while at:
            yield from at.new
            at = at.parent

    def __len__(self) -> int:
        return self.depth

    def gathered(self, key, start, add):
        """start, to which add(sum, new features) has added each tag's from the outermost on. Sums are kept, so that a path costs no more than what no path before it had."""
        todo, at = [], self
        while at and key not in at.known:
            todo.append(at)
            at = at.parent
        total = at.known[key] if at else start
        for node in reversed(todo):
            total = node.known[key] = add(total, node.new)
        return total


@dataclass
class Block:
    text: str
    path: Path | tuple[str, ...]
    linked: int = 0


def blocks(page: str) -> list[Block]:
    """The page's blocks in order: decoded text, white space as one space; nothing of scripts, styles, comments and the like.

    The time is in proportion to the page, however many tags are open: a block refers to its innermost open
    tag, and where a name was opened last is known.
    """
    out: list[Block] = []
    stack: list[Path] = []
    places: dict[str, list[int]] = {}  # of each name's open tags
    around: dict[str, int] = {}  # features of open tags
    held: list[str] = []
    linked, links, at = 0, 0, 0

    def close():
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append(Block(text, stack[-1] if stack else (), min(linked, len(text))))
            held.clear()
        linked = 0

    def pop(k: int):
        nonlocal links
        for node in stack[k:]:
            links -= node.tag == "a"
            places[node.tag].pop()
            for x in node.new:
                del around[x]
        del stack[k:]

    def last(names) -> int:
        return max((p[-1] for x in names if (p := places.get(x))), default=-1)

    for m in _TAG.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            held.append(page[at : m.start()])
            linked += (m.start() - at) * (links > 0)
        at = m.end()
        end, tag, attributes = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
        if not tag:
            continue
        tag = tag.lower()
        if tag in _BLOCK or tag in _RAW:
            close()
        if end:
            k = last((tag,))
            if k >= 0:
                pop(k)
            continue
        if tag in _VOID:
            continue
        if tag in _RAW:
            if not attributes.endswith("/") or tag not in ("svg", "math"):
                e = re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.IGNORECASE).search(page, at)
                at = e.end() if e else len(page)
            continue
        if tag in _CLOSES or tag in _BLOCK:
            k = last(_CLOSES.get(tag, ("p",)))
            if k > last(_SCOPES):
                pop(k)
        own = [tag]
        for name, *values in _NAMES.findall(attributes):
            own += [f".{x.lower()}" for x in _PARTS.findall(" ".join(values))]
            own.append(f"{name.lower()}?")
        links += tag == "a"
        new = tuple(x for x in dict.fromkeys(own) if x not in around)
        around.update(dict.fromkeys(new, 1))
        places.setdefault(tag, []).append(len(stack))
        stack.append(Path(stack[-1] if stack else None, tag, new))
    if at < len(page):
        held.append(page[at:])
        linked += (len(page) - at) * (links > 0)
    close()
    return out


def _number(feature: str) -> int:
    return zlib.crc32(feature.encode()) & ((1 << BITS) - 1)


def _leaf_features(path: Path | tuple[str, ...]) -> tuple[str, str]:
    if isinstance(path, Path):
        tags = [path.parent.tag, path.tag] if path.parent else [path.tag]
    else:
        tags = [x for x in path if x[0] != "." and x[-1] != "?"]
    return f"leaf {tags[-1] if tags else ''}", f"leaf {' '.join(tags[-2:])}"


def path_features(path: Path | tuple[str, ...]) -> list[str]:
    return [*{f"in {x}" for x in path}, *_leaf_features(path)]


def text_features(b: Block, i: int, n: int) -> list[str]:
    t, words = b.text, b.text.count(" ") + 1
    share = b.linked / len(t)
    marks = sum(t.count(c) for c in ",.;:!?")
    out = [f"words {int(math.log2(words) * 1.5)}", f"linked {int(share * 4.99)}", f"marks {min(6, int(20 * marks / len(t) ** 0.9))}", f"ends {t[-1] if t[-1] in '.!?…:»“”)' else ''}"]
    if "©" in t or "(c)" in t.lower():
        out.append("rights")
    if i == 0:
        out.append("first")
    if i == n - 1:
        out.append("last")
    if t[:1].islower():
        out.append("lower")
    return out


class Field:
    """Weights of features for `article` against `not`, and of pairs of neighbours' labels."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray):
        self.weights, self.steps = weights, steps
        self.known: dict[object, float] = {}

    def score(self, key, features) -> float:
        if key not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[key] = float(sum(self.weights[_number(f)] for f in (features() if callable(features) else features)))
        return self.known[key]

    def stands_in(self, path: Path | tuple[str, ...]) -> float:
        """The score of path_features(): of what is around a block, sums from the outermost tag on."""
        if not isinstance(path, Path):
            return self.score(path, lambda: path_features(path))
        inside = path.gathered(self, 0.0, lambda total, new: total + sum(self.score(f, (f,)) for f in [f"in {x}" for x in new]))
        return inside + sum(self.score(f, (f,)) for f in _leaf_features(path))

    def labels(self, page: list[Block]) -> list[bool]:
        """Viterbi's path."""
        (s00, s01), (s10, s11) = self.steps.tolist()
        a, b, back, n = 0.0, 0.0, [], len(page)
        for i, x in enumerate(page):
            e = self.stands_in(x.path) + sum(self.score(f, (f,)) for f in text_features(x, i, n))
            if i == 0:
                a, b = 0.0, e
                continue
            back.append((b + s10 > a + s00, b + s11 > a + s01))
            a, b = max(a + s00, b + s10), max(a + s01, b + s11) + e
        out = [b > a] if n else []
        for p in reversed(back):
            out.append(p[out[-1]])
        return out[::-1]


def train_field(pages: list[tuple[list[Block], list[bool]]], epochs: int = 5, rate: float = 0.3, ridge: float = 1e-5, seed: int = 11) -> Field:
    """Ascends the pages' conditional log-likelihood, a page at a time, with a step of its own for each weight."""
    made = [([np.array([_number(f) for f in path_features(b.path) + text_features(b, i, len(bs))]) for i, b in enumerate(bs)], np.array(ys, int)) for bs, ys in pages if bs]
    w, seen = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6)
    s, s_seen = np.zeros((2, 2)), np.full((2, 2), 1e-6)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(made)):
            xs, y = made[k]
            n, e = len(xs), np.array([w[x].sum() for x in xs])
            emit = np.stack([np.zeros(n), e], axis=1)
            fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
            fwd[0] = emit[0]
            for t in range(1, n):
                fwd[t] = np.logaddexp(fwd[t - 1, 0] + s[0], fwd[t - 1, 1] + s[1]) + emit[t]
            for t in range(n - 2, -1, -1):
                v = bwd[t + 1] + emit[t + 1]
                bwd[t] = np.logaddexp(s[:, 0] + v[0], s[:, 1] + v[1])
            z = np.logaddexp(*fwd[-1])
            p1 = np.exp(fwd[:, 1] + bwd[:, 1] - z)
            at, d = np.concatenate(xs), np.repeat(y - p1, [len(x) for x in xs])
            g = np.bincount(at, weights=d, minlength=1 << BITS)
            used = np.unique(at)
            g[used] -= ridge * w[used] * n
            seen[used] += g[used] ** 2
            w[used] += rate * g[used] / np.sqrt(seen[used])
            if n > 1:
                pair = fwd[:-1, :, None] + s + (emit[1:] + bwd[1:])[:, None, :] - z
                gs = -np.exp(pair).sum(axis=0)
                np.add.at(gs, (y[:-1], y[1:]), 1)
                s_seen += gs**2
                s += rate * gs / np.sqrt(s_seen)
    return Field(w, s)


# How pages are marked up. Each is an opening; what closes it follows from its tags.
_MAIN = ("<article>", "<main>", '<div id="content">', '<div class="post-content">', '<div class="entry-content">', '<section class="story-body">', '<div class="article-body">', '<div role="main">', '<div class="main-content"><div class="text">', '<article class="post"><div itemprop="articleBody">', '<main id="main"><article class="entry">', "<div>", "<div><div>", '<table><tr><td class="content">', '<div id="page"><div class="body">', '<div class="container"><div class="row">', "<section>")
_ASIDE = (
    "<nav><ul>", '<div class="menu"><ul>', '<ul class="nav navbar">', '<div id="navigation">', "<header>", '<div class="header">', '<div id="masthead">', '<div class="top-bar">', "<footer>", '<div class="footer">', '<div id="footer"><p>', '<div class="site-info copyright">', "<aside>", '<div class="sidebar">', '<div id="side-column">', '<div class="widget">', '<div class="ad">', '<div class="advert">', '<div class="ads banner">', '<ins class="adsbygoogle">', '<div class="sponsored promo">', '<div class="cookie-notice">', '<div id="cookie-banner" role="dialog">', '<div class="notice">', '<div class="alert warning">', '<div class="popup modal overlay">', '<div class="consent gdpr privacy">', '<div class="newsletter subscribe">', "<form>", '<form class="login"><label>', '<form class="search"><button>', '<form><select><option>', '<div class="share social">', '<div class="related posts">', '<div class="recommended more">', '<div class="breadcrumbs">', '<div class="pagination pager">', '<section class="comments">', '<div id="comments"><div class="comment">', '<ol class="comment-list"><li class="comment"><p>', '<div id="disqus_thread" class="discussion">', '<article class="comment"><p>', '<div class="replies reply">', '<div class="reviews user">', '<div class="tags meta">', '<div class="skip-link">', "<noscript>", "<dialog>", '<div role="navigation">', '<div role="complementary">', '<div role="banner">', '<div role="contentinfo">', '<div class="toolbar">', '<aside class="related"><ul>',
)
_INSIDE = ("<p>", "<p>", "<p>", "<p>", "<h1>", "<h2>", "<h3>", "<ul><li>", "<ol><li>", "<blockquote>", "<blockquote><p>", "<pre>", "<table><tr><td>", "<figure><figcaption>", "<div>", "<dl><dd>", "<section><p>")


def _closed(opening: str, inner: str) -> str:
    return opening + inner + "".join(f"</{t}>" for t in reversed(re.findall(r"<([a-z0-9]+)", opening)))


def set_anew(article: list[str], other: list[str], draw: np.random.Generator) -> str:
    """A page of these texts in drawn markup: an article marked as one of _MAIN, before, in and after it blocks marked as of _ASIDE."""
    pick = lambda seq: seq[int(draw.integers(len(seq)))]
    link = lambda t: f'<a href="#">{t}</a>'

    def aside() -> str:
        opening = pick(_ASIDE)
        # Reader comments and notices may read like an article, and menus are mostly links.
        texts = [pick(article if draw.random() < 0.45 else other) for _ in range(int(draw.integers(1, 5)))]
        texts = [t if draw.random() < 0.6 else t[:40] for t in texts]
        if opening.endswith("<ul>"):
            inner = "".join(f"<li>{link(html.escape(t[:30]))}</li>" for t in texts)
        else:
            inner = "".join(_closed(pick(("<p>", "<div>", "<span>", "<li>")), link(html.escape(t)) if draw.random() < 0.3 else html.escape(t)) for t in texts)
        return _closed(opening, inner)

    parts, nested = [], draw.random() < 0.3
    for t in article:
        parts.append(_closed(pick(_INSIDE), html.escape(t)))
        if nested and draw.random() < 0.15:
            parts.append(f"<!--0-->{aside()}<!--1-->")
    main = _closed(pick(_MAIN), "<!--1-->" + "".join(parts) + "<!--0-->")
    before, after = ("".join(aside() for _ in range(int(draw.integers(1, 6)))) for _ in range(2))
    wrap = pick(("", "", "<div>", '<div id="wrapper">', '<div class="container">'))
    return "<body>" + _closed(wrap, before + main + after) if wrap else "<body>" + before + main + after


def labelled(page: str) -> tuple[list[Block], list[bool]]:
    """Blocks of a page of set_anew() with the labels that its comments give."""
    out, ys, label = [], [], False
    marked = re.sub(r"<!--([01])-->", lambda m: f"<br>\x02{m[1]}<br>", page)
    for b in blocks(marked):
        if b.text in ("\x020", "\x021"):
            label = b.text[1] == "1"
        else:
            out.append(b)
            ys.append(label)
    return out, ys


# What marks an article, and what stands in one without belonging to it.
_MARKS = frozenset("article main".split())
_NEVER = frozenset("nav aside footer form dialog noscript .comment .comments .reply .replies .ad .ads .advert .adsbygoogle .banner .sponsored .promo .related .share .social .newsletter .subscribe .sidebar .widget .menu .cookie .notice .popup .breadcrumbs .pagination .tags".split())


def own_labels(page: str) -> tuple[list[Block], list[bool] | None]:
    """Blocks, with labels where the page marks its article: what stands in the mark and in nothing that never belongs to it."""
    found = blocks(page)
    seen = lambda told, new: (told[0] or not _MARKS.isdisjoint(new), told[1] or not _NEVER.isdisjoint(new))
    ys = [b.path.gathered("marks", (False, False), seen) == (True, False) if b.path else False for b in found]
    return found, ys if any(ys) else None


def _like_article(b: Block) -> bool:
    """Whether a block of an unmarked page may serve as text of an article set anew: long, in sentences, hardly linked."""
    return len(b.text) >= 80 and b.linked < 0.3 * len(b.text) and b.text[-1] in ".!?…»”)"


def _drawn(draw: np.random.Generator) -> tuple[list[str], list[str]]:
    """Texts of an article and of what stands around it, of drawn syllables."""
    syllable = lambda: "".join(chr(97 + int(draw.integers(26))) for _ in range(int(draw.integers(1, 4))))
    words = lambda n: " ".join("".join(syllable() for _ in range(int(draw.integers(1, 4)))) for _ in range(n)).capitalize()
    article = [words(int(draw.integers(3, 12)))]
    article += [". ".join(words(int(draw.integers(4, 20))) for _ in range(int(draw.integers(1, 7)))) + "." for _ in range(int(draw.integers(2, 10)))]
    return article, [words(int(draw.integers(1, 9))) + ("", ".")[int(draw.integers(2))] for _ in range(12)] + ["© " + words(3)]


def train(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Field:
    """The field after the sampled pages, the first by a hash of page_id, in one bounded task; without pages, after pages of drawn words alone."""
    draw = F.xxhash64("page_id", F.lit("sample"))
    sample = pages.where("html is not null").select("page_id", "html").orderBy(draw, "page_id", "html").limit(sample_pages).select("html")

    def learn(batches):
        own = [t for batch in batches for t in batch.column("html").to_pylist()]
        rng, made = np.random.default_rng(3), []

        def anew(article, other, times):
            for _ in range(times):
                few = article if len(article) <= MOST_BLOCKS else [article[i] for i in np.sort(rng.permutation(len(article))[:MOST_BLOCKS])]
                made.append(labelled(set_anew(few, other, rng)))

        for page in sorted(own):
            bs, ys = own_labels(page)
            if ys is not None and sum(len(b.path) for b in bs) <= MOST_STEPS:
                made.append((bs, ys))
            of = [_like_article(b) for b in bs] if ys is None else ys
            article, other = [b.text for b, y in zip(bs, of, strict=True) if y], [b.text for b, y in zip(bs, of, strict=True) if not y]
            if article and other:
                anew(article, other, ANEW)
        for _ in range(DRAWN):
            anew(*_drawn(rng), 1)
        f = train_field(made)
        yield pa.RecordBatch.from_arrays([pa.array([f.weights.tobytes()], pa.binary()), pa.array([f.steps.tobytes()], pa.binary())], ["w", "s"])

    row = sample.coalesce(1).mapInArrow(learn, "w binary, s binary").first()
    return Field(np.frombuffer(bytes(row["w"])), np.frombuffer(bytes(row["s"])).reshape(2, 2))


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page or "")
    return " ".join(b.text for b, y in zip(found, field.labels(found), strict=True) if y)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of each page: its article's blocks in order, joined by one space.

    A page that is null, empty or without an article has an empty text. Whole pages are read. No tag is
    asked for: pages that mark no article are labelled by the field like all others. Rows that repeat a
    page_id are extracted each; columns besides page_id, url and html are left out.
    """
    modest_batches(pages.sparkSession)
    shipped = pages.sparkSession.sparkContext.broadcast(train(pages) if field is None else field)

    def run(batches):
        own = shipped.value
        for rows, _, _ in text_slices(batches, "html"):
            texts = [main_text(p, own) for p in rows.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
