"""Main text of HTML pages by a linear-chain conditional random field over the leaf blocks of the DOM.

A page is cut into the blocks that hold its text, in order. Each is described by the tags, classes and
ids of its ancestors and by a few properties of its text and links; the field scores each block as main
text or not, and each pair of neighbours; Viterbi's path is the answer. The field is trained on labelled
pages: ``labelled_pages`` writes them, with their labels, in many layouts from a seed.

Defined results: a null or empty html has no text; what is cut off at the end counts as far as it goes;
pages without main text give the empty text; rows that repeat are alike; an empty table gives an empty
result; other columns pass through ``extract``, a former ``text`` or ``n_chars`` is replaced.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopyql.llm.flat import pieces
from canopyql.session import table

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag in the first set ends an open element of the same set.
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: What follows a tag's name: a quote opens a value only directly after a =.
_ATTRIBUTES = r"(?:=\s*(?:\"[^\"]*\"|'[^']*'|)|[^>=])*"
#: Comments; elements whose content is no text of the page (form fields among them); tags; declarations.
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|object|textarea|select)\b{_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Block:
    """A leaf block: its text, the share of it in links, and its ancestors' features."""

    __slots__ = ("text", "linked", "path", "tag")

    def __init__(self, text: str, linked: float, path: frozenset, tag: str):
        self.text, self.linked, self.path, self.tag = text, linked, path, tag


@lru_cache(maxsize=20_000)
def _own_features(tag: str, attributes: str) -> frozenset:
    found = {f"<{tag}>"}
    if attributes:
        for _, a, b, c in _NAMES.findall(attributes):
            found.update("." + p.lower() for p in _PART.findall(a or b or c))
    return frozenset(found)


@lru_cache(maxsize=50_000)
def _joined(path: frozenset, own: frozenset) -> frozenset:
    return path | own


def blocks(html: str) -> list[Block]:
    """The leaf blocks of a page that hold text."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset]] = []
    empty: frozenset = frozenset()
    parts: list[tuple[str, bool]] = []
    links = 0

    def end_block() -> None:
        if parts:
            whole = " ".join("".join([p for p, _ in parts]).split())
            if whole:
                linked = sum(len(p) for p, a in parts if a)
                out.append(Block(whole, linked / max(1, sum(len(p) for p, _ in parts)), stack[-1][1] if stack else empty, next((t for t, _ in reversed(stack) if t not in INLINE), "")))
            parts.clear()

    def pop_to(i: int) -> None:
        nonlocal links
        links -= sum(t == "a" for t, _ in stack[i:])
        del stack[i:]

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            raw = html[at : m.start()]
            parts.append((entities.unescape(raw) if "&" in raw else raw, links > 0))
        at = m.end()
        name = m[3]
        if not name:
            continue
        tag = name.lower()
        if tag == "br":
            parts.append((" ", False))
            continue
        if m[2]:
            if tag not in INLINE:
                end_block()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop_to(i)
                    break
                if tag in INLINE and stack[i][0] not in INLINE:
                    break
            continue
        if tag not in INLINE:
            end_block()
            closes = _CLOSES.get(tag) or ({"p"} if tag in _ENDS_P else None)
            if closes:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in closes:
                        pop_to(i)
                        break
                    if stack[i][0] not in INLINE and stack[i][0] != "p":
                        break
        if tag not in VOID and not m[4].endswith("/"):
            stack.append((tag, _joined(stack[-1][1] if stack else empty, _own_features(tag, m[4]))))
            links += tag == "a"
    if at < len(html):
        raw = html[at:]
        parts.append((entities.unescape(raw) if "&" in raw else raw, links > 0))
    end_block()
    return out


def _bin(x: float, *edges: float) -> int:
    return sum(x >= e for e in edges)


def text_features(b: Block, place: float) -> tuple[str, ...]:
    """Features of a block besides its ancestors."""
    t = b.text
    return (
        f"own={b.tag}",
        f"len={_bin(len(t), 15, 40, 90, 200, 500)}",
        f"link={_bin(b.linked, 0.05, 0.3, 0.7)}",
        f"end={t[-1] if t[-1] in '.!?:,;…' else 'x'}",
        f"commas={_bin(t.count(','), 1, 3)}",
        f"mark={'©' in t or '|' in t or '»' in t}",
        f"place={_bin(place, 0.1, 0.3, 0.7, 0.9)}",
        "bias",
    )


class Field:
    """The trained field: one weight a feature (for main text) and four for pairs of neighbours."""

    def __init__(self, weights: dict[str, float], pairs: list[list[float]]):
        self.weights, self.pairs = weights, pairs
        self.of_path: dict[frozenset, float] = {}

    def _emission(self, b: Block, place: float) -> float:
        got = self.of_path.get(b.path)
        if got is None:
            if len(self.of_path) > 50_000:
                self.of_path.clear()
            got = self.of_path[b.path] = sum(self.weights.get(f, 0.0) for f in b.path)
        w = self.weights
        return got + sum([w.get(f, 0.0) for f in text_features(b, place)])

    def labels(self, found: list[Block]) -> list[bool]:
        """Viterbi's path."""
        if not found:
            return []
        (p00, p01), (p10, p11) = self.pairs
        n = len(found)
        a, b, back = 0.0, self._emission(found[0], 0.0), []
        for i in range(1, n):
            e = self._emission(found[i], i / n)
            from0, from1 = a + p00 >= b + p10, a + p01 > b + p11
            back.append((from0, from1))
            a, b = (a + p00 if from0 else b + p10), (a + p01 if from1 else b + p11) + e
        path = [b > a]
        for from0, from1 in reversed(back):
            path.append(not (from1 if path[-1] else from0))
        return path[::-1]


def expectations(e: np.ndarray, pairs: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By forward and backward sums: ln Z of each sequence, P(main text) of each block, and how often each pair of labels is expected.

    e: scores by sequence, block and label; real: which blocks there are, the sequences being as long as the longest.
    """
    longest = e.shape[1]
    forward, backward = np.zeros_like(e), np.zeros_like(e)
    forward[:, 0] = e[:, 0]
    for t in range(1, longest):
        s = forward[:, t - 1, :, None] + pairs
        forward[:, t] = np.where(real[:, t, None], np.logaddexp(s[:, 0], s[:, 1]) + e[:, t], forward[:, t - 1])
    for t in range(longest - 2, -1, -1):
        s = pairs + (e[:, t + 1] + backward[:, t + 1])[:, None, :]
        backward[:, t] = np.where(real[:, t + 1, None], np.logaddexp(s[:, :, 0], s[:, :, 1]), 0)
    z = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
    p = np.exp(forward + backward - z[:, None, None])[:, :, 1] * real
    joint = np.exp(forward[:, :-1, :, None] + pairs + (e + backward)[:, 1:, None, :] - z[:, None, None, None])
    return z, p, (joint * real[:, 1:, None, None]).sum(axis=(0, 1))


def train(pages: list[tuple[str, list[bool]]], rounds: int = 150, ridge: float = 0.02) -> tuple[dict[str, float], list[list[float]]]:
    """Maximum likelihood by gradient steps over all pages at once; pages: (html, label of each block)."""
    sequences = []
    for html, labels in pages:
        found = blocks(html)
        if len(found) != len(labels):
            raise ValueError("a labelled page has other blocks than labels")
        sequences.append(([sorted(b.path) + list(text_features(b, i / len(found))) for i, b in enumerate(found)], labels))
    names = sorted({f for rows, _ in sequences for row in rows for f in row})
    ids = {f: i for i, f in enumerate(names)}
    n, longest = len(sequences), max(len(y) for _, y in sequences)
    owner, feature = [], []
    y, real = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, (rows, labels) in enumerate(sequences):
        y[i, : len(labels)], real[i, : len(labels)] = labels, True
        for j, row in enumerate(rows):
            owner += [i * longest + j] * len(row)
            feature += [ids[f] for f in row]
    owner, feature = np.array(owner), np.array(feature)
    w, pairs = np.zeros(len(names)), np.zeros((2, 2))
    momentum = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(pairs), np.zeros_like(pairs)]
    gold_pairs = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & real[:, 1:]).sum() for b in (0, 1)] for a in (0, 1)], float)
    for step in range(1, rounds + 1):
        e = np.zeros((n, longest, 2))
        e[:, :, 1] = np.bincount(owner, weights=w[feature], minlength=n * longest).reshape(n, longest)
        _, p, expected = expectations(e, pairs, real)
        grad_w = np.bincount(feature, weights=((y - p) * real).reshape(-1)[owner], minlength=len(names)) - ridge * w * n / 10
        grads = (grad_w / n, (gold_pairs - expected) / n - ridge * pairs)
        for k, (x, g) in enumerate(zip((w, pairs), grads, strict=True)):
            momentum[2 * k] = 0.9 * momentum[2 * k] + 0.1 * g
            momentum[2 * k + 1] = 0.99 * momentum[2 * k + 1] + 0.01 * g * g
            x += 0.15 * (momentum[2 * k] / (1 - 0.9**step)) / (np.sqrt(momentum[2 * k + 1] / (1 - 0.99**step)) + 1e-8)
    return dict(zip(names, w.tolist(), strict=True)), pairs.tolist()


_SYLLABLES = "an ba ce de er fi go hu in jo ka le mi no or pe qu ra si to un ve wa xi yo za ch sch tion ment é ü ñ ó ß".split()


def labelled_pages(n: int = 500, seed: int = 7) -> list[tuple[str, list[bool]]]:
    """Pages in many layouts with the label of each block (True: main text)."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))

    def words(a: int, b: int) -> str:
        return " ".join(word() for _ in range(r.randint(a, b))).capitalize()

    def sentence() -> str:
        return ", ".join(words(2, 9) if i == 0 else words(2, 9).lower() for i in range(r.randint(1, 3))) + r.choice([".", ".", ".", "!", "?"])

    def paragraph() -> str:
        return " ".join(sentence() for _ in range(r.choice([1, 1, 2, 3, 5, 8])))

    def attribute(*names: str) -> str:
        name = r.choice(names)
        return f' {r.choice(["class", "class", "id"])}="{r.choice(["", "", "", "box ", "js-", "col-2 "])}{name}"' if name else ""

    link = lambda: f'<a href="/{word()}">{words(1, 4)}</a>'

    def make() -> tuple[str, list[bool]]:
        out: list[str] = []
        labels: list[bool] = []

        def block(markup: str, label: bool) -> None:
            out.append(markup)
            labels.append(label)

        def around(tag: str, attributes: str, inner) -> None:
            out.append(f"<{tag}{attributes}>")
            inner()
            out.append(f"</{tag}>")

        def link_list(least: int = 3) -> None:
            out.append("<ul>" if (listed := r.random() < 0.8) else "<div>")
            for _ in range(r.randint(least, 8)):
                block(f"<li>{link()}</li>" if listed else f"<div>{link()}</div>", False)
            out.append("</ul>" if listed else "</div>")

        def few() -> None:
            for _ in range(r.randint(1, 3)):
                tag, inner = r.choice(["p", "div", "h3", "h4"]), r.choice([paragraph, sentence, lambda: words(1, 5), link])
                block(f"<{tag}>{inner()}</{tag}>", False)

        def bare() -> None:
            block(r.choice([sentence, paragraph, lambda: words(2, 6)])(), False)

        def advert() -> None:
            around(r.choice(["div", "div", "aside", "section"]), attribute("ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo", "ad-slot", "ad_box"), r.choice([few, bare]))

        def notice() -> None:
            around("div", attribute("cookie", "cookie-notice", "notice", "consent", "gdpr-banner", "alert", "newsletter", "subscribe", "popup", "modal", "paywall", "announcement"), r.choice([few, bare]))

        def form() -> None:
            def inner() -> None:
                block(f"<label>{words(1, 3)}</label><input name='x'>", False)
                if r.random() < 0.5:
                    block(f"<p>{sentence()}</p>", False)
                block(f"<button>{words(1, 2)}</button>", False)

            around("form", attribute("", "search", "signup", "login"), inner)

        def sidebar() -> None:
            tag, a = ("aside", attribute("", "sidebar", "related")) if r.random() < 0.5 else ("div", attribute("sidebar", "related", "widget", "rail", "recommended", "trending", "most-read"))
            around(tag, a, r.choice([link_list, few]))

        def share() -> None:
            around("div", attribute("share", "social", "tags", "breadcrumbs", "byline", "pagination", "toolbar"), r.choice([few, lambda: link_list(2)]))

        def comments() -> None:
            def inner() -> None:
                if r.random() < 0.6:
                    block(f"<h3>{words(1, 3)}</h3>", False)
                for _ in range(r.randint(1, 5)):
                    t = r.choice(["div", "li", "article", "p"])
                    a = attribute("comment", "comment-body", "reply", "comment-text", "user-comment", "")
                    block(f"<{t}{a}><p>{paragraph()}</p></{t}>" if t != "p" else f"<p{a}>{paragraph()}</p>", False)

            around(r.choice(["section", "div", "ol", "aside"]), attribute("comments", "comment-list", "responses", "discussion", "disqus", "replies"), inner)

        def header() -> None:
            tag, a = ("header", "") if r.random() < 0.6 else ("div", attribute("header", "masthead", "topbar", "site-header", "branding"))
            name = r.choice(["div", "h1", "h2", "p"])
            around(tag, a, lambda: (block(f"<{name}>{words(1, 5)}</{name}>", False), navigation() if r.random() < 0.3 else None))

        def navigation() -> None:
            tag, a = ("nav", "") if r.random() < 0.7 else ("div", attribute("nav", "menu", "navigation", "navbar"))
            around(tag, a, link_list)

        def footer() -> None:
            tag, a = ("footer", "") if r.random() < 0.7 else ("div", attribute("footer", "site-footer", "copyright", "legal", "colophon"))
            inner = r.choice([lambda: block(f"&copy; {word()}.example &middot; {sentence()}", False), few, link_list, lambda: block(f"<p>© {words(1, 4)} | {link()}</p>", False)])
            around(tag, a, inner)

        def body() -> None:
            if r.random() < 0.8:
                title = f"<h1>{words(2, 9)}</h1>"
                if r.random() < 0.15:
                    title = f"<header>{title}</header>"
                block(title, True)
            for _ in range(r.randint(1, 12)):
                kind = r.random()
                if kind < 0.66:
                    block(f"<p>{paragraph()}</p>", True)
                elif kind < 0.72:
                    block(f"<p><b>{paragraph()}<br>", True)
                elif kind < 0.78:
                    level = r.choice(["h2", "h3", "h4"])
                    block(f"<{level}>{words(1, 7)}</{level}>", True)
                elif kind < 0.83:
                    listed = r.choice(["ul", "ol"])
                    out.append(f"<{listed}>")
                    for _ in range(r.randint(1, 5)):
                        block(f"<li>{r.choice([sentence, lambda: words(1, 6)])()}</li>", True)
                    out.append(f"</{listed}>")
                elif kind < 0.86:
                    block(f"<blockquote><p>{paragraph()}</p></blockquote>", True)
                elif kind < 0.88:
                    block(f"<pre>{paragraph()}</pre>", True)
                elif kind < 0.90:
                    out.append("<table>")
                    for _ in range(r.randint(1, 3)):
                        out.append("<tr>")
                        block(f"<td>{words(1, 4)}</td>", True)
                        block(f"<td>{words(1, 6)}</td>", True)
                        out.append("</tr>")
                    out.append("</table>")
                elif kind < 0.92:
                    block(f"<p>{sentence()} {link()} {sentence().lower()}</p>", True)
                else:
                    r.choice([advert, notice, form, sidebar, share])()

        around("head", "", lambda: block(f"<title>{words(2, 9)}</title>", False))
        out.append("<body>")
        before = [header, navigation, advert, notice, form, share, sidebar]
        for part in r.sample(before, r.randint(1, 4)):
            part()
        tag, a = r.choice([("article", attribute("", "", "post", "story")), ("article", ""), ("main", attribute("", "content")), ("div", attribute("content", "article", "post", "entry-content", "article-body", "story", "main", "main-content", "text", "body-copy")), ("section", attribute("article", "content", "story"))])
        wrapped = r.random() < 0.25
        out.append("<main><div>" if wrapped else "")
        inside = r.random() < 0.15
        around(tag, a, lambda: (body(), comments() if inside else None))
        out.append("</div></main>" if wrapped else "")
        if r.random() < 0.4 and not inside:
            comments()
        for part in r.sample([sidebar, advert, notice, form, share, link_list, footer], r.randint(0, 3)):
            part()
        if r.random() < 0.8:
            footer()
        out.append("</body></html>")
        return "<!DOCTYPE html><html>" + "".join(out), labels

    made = []
    while len(made) < n:
        html, labels = make()
        if len(blocks(html)) == len(labels):
            made.append((html, labels))
    return made


@lru_cache(maxsize=2)
def trained(n: int = 500, seed: int = 7) -> tuple[dict[str, float], list[list[float]]]:
    return train(labelled_pages(n, seed))


def main_text(field: Field, html: str | None) -> str:
    if not html:
        return ""
    found = blocks(html)
    return "\n".join([b.text for b, keep in zip(found, field.labels(found), strict=True) if keep])


def extract(pages: DataFrame, model: tuple | None = None, column: str = "html") -> DataFrame:
    """pages with text and n_chars in place of the html column."""
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())
    kept = [c for c in pages.columns if c not in ("text", "n_chars", column)]
    rows = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(column).alias("_html"))
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != "_html"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(*shared.value)
        for batch in batches:
            html = batch.column(batch.num_columns - 1)
            for at, size in pieces(html, 8 << 20):
                texts = [main_text(field, h) for h in html.slice(at, size).to_pylist()]
                columns = [*batch.slice(at, size).columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def op6_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
