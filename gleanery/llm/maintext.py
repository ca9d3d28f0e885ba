"""Main text of web pages: the maximum-scoring run of words and tags.

Words score positive and tags negative. The weights are fitted on pages that label
their own content with one ``<article>`` or ``<main>`` element; a linear scan over the
running sum then finds the best contiguous region of any page, labelled or not.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gleanery.llm.common import bounded_batches, table

SAMPLE_PAGES = 2000      # labelled pages the weights are fitted on, those of smallest hash
STEPS = 400              # of the fit
PRIOR = 1e-3             # pull towards the weights below, per token
LEAST = 0.05             # words outside furniture gain, and tags cost, this much at least
WORD_PRIOR, FURNITURE_PRIOR, LINK_PRIOR, TAG_PRIOR = 1.0, -3.0, -1.0, -0.5

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)"                                                                          # comment
    r"|<(?P<raw>script|style|noscript|template|title|textarea|iframe|svg|math|object|select|canvas|audio|video)\b"
    r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\b[^>]*>|\Z)"                              # content is no text
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"            # tag
    r"|</?[a-z][^>]*(?:>|\Z)"                                                                     # tag with a stray quote
    r"|<[!?/][^>]*(?:>|\Z)",                                                                      # declaration
    re.I | re.S,
)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?(?=[\s/]|$)", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp"
    " small span strike strong sub sup time tt u var wbr".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = set("head nav header footer aside form dialog menu button fieldset".split())
CONTENT_WORDS = set("article content main post entry story body text page".split())
FURNITURE_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu"
    " breadcrumb breadcrumbs sidebar aside rail header masthead footer cookie cookies consent gdpr notice notices alert"
    " popup modal overlay newsletter subscribe subscription signup login related recommended share sharing social widget"
    " pagination pager toolbar search comment comments discussion disqus replies respond contentinfo complementary".split()
)
REMARKS = set("comment comments discussion disqus replies respond".split())
ADVERTS = set("ad ads advert adverts advertisement advertising sponsor sponsored promo".split())
ROLES = set("navigation banner contentinfo complementary search form alert dialog menu menubar".split())


def _furniture_name(value: str, in_content: bool) -> bool:
    """Whether a class or id names page furniture, by its first or last part."""
    for name in value.split():
        parts = [p.lower() for p in NAME_PART.findall(name)]
        if not parts or parts[0] in ("has", "with", "no"):
            continue
        hits = {parts[0], parts[-1]} & FURNITURE_WORDS
        if hits & (REMARKS | ADVERTS):
            return True
        if hits - {"header", "banner"} and not parts[-1] in CONTENT_WORDS:
            return True
        if hits and not in_content and not CONTENT_WORDS & set(parts):
            return True
    return False


def _content_name(value: str) -> bool:
    return any({p.lower() for p in NAME_PART.findall(n)} & CONTENT_WORDS for n in value.split())


def furniture(name: str, rest: str, in_content: bool) -> bool:
    """Whether an element is a menu, header, footer, sidebar, notice, advert, form or comment area."""
    if name in ("html", "body", "main"):
        return False
    if name in FURNITURE and not (name == "header" and in_content):
        return True
    for key, value in ATTRIBUTE.findall(rest):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
        if key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if key == "role" and value.lower() in ROLES - ({"banner"} if in_content else set()):
            return True
        if key in ("class", "id") and _furniture_name(value, in_content):
            return True
    return False


@dataclass
class Tokens:
    """A page as scored events: runs of words and tags, in page order.

    ``kinds``: a tag's name, or ``#word`` with ``+link`` and ``+furniture``;
    ``counts``: words of a run, 1 for a tag; ``texts``: the decoded run or None;
    ``blocks``: number of the block an event lies in; ``labelled``: inside the
    page's own content element; ``frames``: element that encloses the event.
    """

    kinds: list[str] = field(default_factory=list)
    counts: list[int] = field(default_factory=list)
    texts: list[str | None] = field(default_factory=list)
    blocks: list[int] = field(default_factory=list)
    labelled: list[bool] = field(default_factory=list)
    elements: int = 0           # content elements, nested ones not counted


def tokens(html: str, forms: bool = False) -> Tokens:
    """Events of a page; ``forms``: a form is a plain container."""
    out = Tokens()
    stack: list[tuple[str, bool, bool]] = []       # open block elements: (name, furniture, content element)
    link, block, at = 0, 0, 0
    outside = inside = 0                           # open furniture, open content elements

    def words(piece: str) -> None:
        text = unescape(piece)
        count = len(text.split())
        kind = "#word" + ("+link" if link else "") + ("+furniture" if outside else "")
        out.kinds.append(kind)
        out.counts.append(count)
        out.texts.append(text)
        out.blocks.append(block)
        out.labelled.append(bool(inside) and not outside)

    def close(place: int) -> None:
        nonlocal outside, inside
        for _, other, content in stack[place:]:
            outside -= other
            inside -= content
        del stack[place:]

    for match in TOKEN.finditer(html):
        if match.start() > at:
            words(html[at:match.start()])
        at = match.end()
        name = match["name"]
        if not name:
            continue
        name, end = name.lower(), bool(match["end"])
        if name == "br":
            words(" ")
            continue
        if name not in INLINE:
            block += 1
        elif name == "a":
            link = 0 if end else 1
        if name not in INLINE and name not in VOID and name != "p":
            if end:
                place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
                if place is not None:
                    close(place)
            else:
                if name in ("main", "article", "body"):     # an unclosed head, menu or form ends here
                    place = next((i for i, e in enumerate(stack) if e[0] in ("head", "nav", "form") and e[1]), None)
                    if place is not None:
                        close(place)
                link = 0
                other = furniture(name, match["rest"], inside > 0) and not (forms and name == "form")
                content = name in ("article", "main") and not other
                out.elements += content and not inside and not outside
                stack.append((name, other, content))
                outside += other
                inside += content
        out.kinds.append(name)
        out.counts.append(1)
        out.texts.append(None)
        out.blocks.append(block)
        out.labelled.append(bool(inside) and not outside)
    if at < len(html):
        words(html[at:])
    return out


class Weights:
    """Score of an event: words by base, link and furniture; tags by name, unknown ones by the prior."""

    def __init__(self, found: dict[str, float] | None = None):
        self.found = {"#word": WORD_PRIOR, "+link": LINK_PRIOR, "+furniture": FURNITURE_PRIOR, **(found or {})}

    def of(self, kind: str) -> float:
        if not kind.startswith("#word"):
            return self.found.get(kind, TAG_PRIOR)
        score = sum(self.found[part] for part in features(kind))
        return score if "+furniture" in kind else max(LEAST, score)


def features(kind: str) -> list[str]:
    """``#word`` and its marks, or the tag itself."""
    head, *marks = kind.split("+")
    return [head, *["+" + m for m in marks]]


def fit(counts: list[tuple[str, bool, int]]) -> Weights:
    """Logistic weights of the features from (kind, inside the content, events).

    Words outside furniture keep a positive weight, tags and furniture a negative
    one; without labelled pages the priors stay.
    """
    if not counts:
        return Weights()
    names = sorted({f for kind, _, _ in counts for f in features(kind)} | {"#word", "+link", "+furniture"})
    place = {n: i for i, n in enumerate(names)}
    design = np.zeros((len(counts), len(names)))
    for row, (kind, _, _) in enumerate(counts):
        design[row, [place[f] for f in features(kind)]] = 1
    target = np.array([float(inside) for _, inside, _ in counts])
    share = np.array([n for *_, n in counts], float)
    share /= share.sum()
    given = {"#word": WORD_PRIOR, "+link": LINK_PRIOR, "+furniture": FURNITURE_PRIOR}
    prior = np.array([given.get(n, TAG_PRIOR) for n in names])
    low = np.array([LEAST if n == "#word" else -np.inf for n in names])
    high = np.array([np.inf if n == "#word" else -LEAST for n in names])
    weight = prior.copy()
    curve = design.T @ (share[:, None] * design) / 4          # bound of the curvature
    step = np.linalg.inv(np.diag(curve.sum(axis=1) + PRIOR))
    for _ in range(STEPS):
        slope = design.T @ (share * (target - 1 / (1 + np.exp(-(design @ weight))))) - PRIOR * (weight - prior)
        weight = np.clip(weight + step @ slope, low, high)
    return Weights(dict(zip(names, weight.tolist(), strict=True)))


def best_region(scores: np.ndarray) -> tuple[int, int] | None:
    """[start, end) of the greatest sum; of equal ones the earliest end, then the longest. None: nothing is positive."""
    if not len(scores):
        return None
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    lowest = np.minimum.accumulate(sums)
    gain = sums[1:] - lowest[:-1]
    end = int(np.argmax(gain))
    if gain[end] <= 0:
        return None
    return int(np.argmax(sums[: end + 1] == lowest[end])), end + 1


def main_text(html: str | None, weights: Weights) -> str:
    """Blocks of the best region, one a line, without furniture."""
    page = tokens(html or "")
    region = _region(page, weights)
    if region is None and any("+furniture" in k for k in page.kinds):
        page = tokens(html or "", forms=True)       # pages that lie inside one form
        region = _region(page, weights)
    if region is None:
        return ""
    first, last = page.blocks[region[0]], page.blocks[region[1] - 1]
    lines: dict[int, list[str]] = {}
    for kind, text, block in zip(page.kinds, page.texts, page.blocks, strict=True):
        if text is not None and first <= block <= last and "+furniture" not in kind:
            lines.setdefault(block, []).append(text)
    joined = (" ".join("".join(parts).split()) for parts in lines.values())
    return "\n".join(line for line in joined if line)


def _region(page: Tokens, weights: Weights) -> tuple[int, int] | None:
    known = {kind: weights.of(kind) for kind in set(page.kinds)}
    return best_region(np.array([known[k] * n for k, n in zip(page.kinds, page.counts, strict=True)]))


def label_counts(pages: DataFrame) -> DataFrame:
    """(kind, inside, n): events of pages with exactly one content element, inside it and outside."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for html in batch.column(0):
                page = tokens(html.as_py() or "")
                if page.elements == 1:
                    for kind, inside, n in zip(page.kinds, page.labelled, page.counts, strict=True):
                        if n and (kind[0] == "#" or len(kind) <= 20):       # longer names are no HTML
                            seen[kind, inside] += n
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k for k, _ in seen], pa.string()),
                pa.array([i for _, i in seen], pa.bool_()),
                pa.array(list(seen.values()), pa.int64()),
            ],
            names=["kind", "inside", "n"],
        )

    return pages.select("html").mapInArrow(count, "kind string, inside boolean, n long").groupBy("kind", "inside").agg(
        F.sum("n").alias("n")
    )


def train(pages: DataFrame, sample: int = SAMPLE_PAGES) -> Weights:
    """Weights from ``sample`` pages of smallest hash; the driver gets counts of the commonest 500 kinds only."""
    mark = F.xxhash64("page_id", "url", F.length("html"))
    hashes = pages.where("html is not null").select(mark.alias("h")).distinct()
    last = hashes.orderBy("h").limit(sample).agg(F.max("h").alias("h")).first()["h"]
    if last is None:
        return Weights()
    bounded_batches(pages.sparkSession)
    rows = label_counts(pages.where(mark <= last)).orderBy(F.desc("n"), "kind", "inside").limit(500).collect()
    return fit([(r["kind"], r["inside"], r["n"]) for r in rows])


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    A null or empty html gives an empty text, and so does a page without words
    outside menus, headers, footers, sidebars, notices, adverts, forms and comments.
    Character references are decoded once. White space inside a block, ``<br>``
    included, becomes one space; blocks are trimmed, empty ones dropped, and joined
    by a line feed. Whole pages of any length are read; repeated rows give a row each;
    other columns, whatever their names, are ignored. Without ``weights`` they are
    fitted on the pages themselves.
    """
    bounded_batches(pages.sparkSession)
    known = train(pages) if weights is None else weights

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                texts = [main_text(html.as_py(), known) for html in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    chosen = pages.select("page_id", "url", "html")
    kinds = {f.name: f.dataType.simpleString() for f in chosen.schema}
    return chosen.mapInArrow(read, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def report(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
