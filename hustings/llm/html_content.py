"""Main text of web pages: the contiguous region in which words score highest against tags."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import pieces, query, table

# Elements of HTML by how they are rendered, and names that pages give to what isn't the article.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math".split())
OUTSIDE = frozenset("head nav footer aside form button select option menu dialog label object canvas audio video datalist search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
CONTENT = frozenset("article main".split())
HINTS = (
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar aside widget "
    "widgets menu menus nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer copyright legal disclaimer share "
    "sharing social related recommended recommendations comment comments disqus respond replies reply form search skip pager "
    "pagination toolbar"
).split()
_HINT = re.compile(rf"(?:^|(?<![a-z0-9]))(?:{'|'.join(HINTS)})(?![a-z0-9])")
_BODY = re.compile(r"(?:^|[-_])(?:article|post|entry|story|content)(?:$|[-_])")
_KEEP = re.compile(r"^(?:with|has|no|without|not)[-_]|^(?:article|post|entry|story|content)[-_]+header$")
_TAG = re.compile(r"<(?:!--(.*?)(?:--!?>|$)|[!?][^>]*(?:>|$)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$))", re.S)
_TAG_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)", re.S)
_ATTR = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/>\"']|$)", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

KINDS = tuple(sorted(BLOCKS | VOID | RAW | frozenset("a b i em strong span u small code q cite abbr time sup sub s".split()))) + ("other",)
# Scores where no labelled page tells: a word speaks for the article, a tag against it.
WORD, TAG, CLUTTER, LIMIT = 1.0, -0.25, -1.0, 4.0


class Block(NamedTuple):
    text: str
    kind: str  # innermost element that makes a block, or "a"
    clutter: bool  # inside a menu, advert, form, ...
    inside: int  # number of the article or main element around it, 0 for none


class Tag(NamedTuple):
    kind: str
    inside: int
    clutter: bool


def _is_clutter(name: str, attrs: str, inside: int) -> bool:
    if name in OUTSIDE or (name == "header" and not inside):
        return True
    if not attrs or name in ("html", "body"):
        return False
    for key, *values in _ATTR.findall(attrs):
        key, value = key.lower(), "".join(values).lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and _HIDDEN.search(value)):
            return True
        if key == "role" and value in ROLES:
            return True
        if key in ("class", "id") and any(_HINT.search(w) and not _KEEP.search(w) for w in value.split()):
            return True
    return False


def scan(page: str) -> list[Block | Tag]:
    """Blocks of text and tags of a page in order.

    References are decoded, white space becomes one space, inline tags leave no trace. Elements
    left open end with the element around them; an article always starts outside of clutter that
    was left open before it.
    """
    out: list[Block | Tag] = []
    open_: list[tuple[str, bool, int]] = []  # name, clutter, inside
    bodies: list[int] = []  # how many elements were open below each one that names itself after content
    held: list[str] = []
    clutter, inside, articles = False, 0, 0

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                kind = next((n for n, _, _ in reversed(open_) if n in BLOCKS), "body")
                out.append(Block(text, kind, clutter, inside))

    def put(raw: str) -> None:
        if raw:
            held.append(html.unescape(raw) if "&" in raw else raw)

    at, size = 0, len(page)
    while at < size:
        i = page.find("<", at)
        if i < 0:
            put(page[at:])
            break
        put(page[at:i])
        m = _TAG.match(page, i) or _TAG_LOOSE.match(page, i)
        if not m:
            held.append("<")
            at = i + 1
            continue
        at = m.end()
        closing, name, attrs = (m.groups() if m.re is _TAG_LOOSE else m.groups()[1:])
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            held.append(" ")
            continue
        if name in BLOCKS:
            flush()
        if not closing and name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            at = size if not end else (page.find(">", end.end()) + 1 or size)
            continue
        kind = name if name in _KIND_SET else "other"
        if closing:
            k = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == name), None)
            if k is not None and (name in BLOCKS or all(n not in BLOCKS for n, _, _ in open_[k:])):
                if open_[k][1] != (k > 0 and open_[k - 1][1]):
                    flush()
                del open_[k:]
        elif name not in VOID and not attrs.endswith("/"):
            if name == "p":
                # A paragraph ends the one before it, and what was left open in that.
                k = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0] in BLOCKS), None)
                if k is not None and open_[k][0] == "p":
                    del open_[k:]
            below = open_[-1] if open_ else ("", False, 0)
            if name in CONTENT and not _is_clutter(name, attrs, 1):
                commented = any(c and n not in CONTENT and n in ("form",) for n, c, _ in open_)
                articles += not below[2]
                now = (name, commented, below[2] or articles)
            else:
                bodies = [k for k in bodies if k < len(open_)]
                now = (name, below[1] or _is_clutter(name, attrs, below[2] or len(bodies)), below[2])
                if name in ("div", "section") and any(_BODY.search(w) for _, *v in _ATTR.findall(attrs) for w in "".join(v).lower().split()):
                    bodies.append(len(open_))
            if now[1] != below[1]:
                flush()
            open_.append(now)
        _, clutter, inside = open_[-1] if open_ else ("", False, 0)
        out.append(Tag(kind, inside, clutter))
    flush()
    return out


_KIND_SET = frozenset(KINDS)


def labelled_counts(items: list[Block | Tag]) -> Counter:
    """Tokens by kind inside and outside of the article, of a page whose markup names one."""
    seen: Counter = Counter()
    if not any(isinstance(x, Block) and x.inside and not x.clutter for x in items):
        return seen
    for x in items:
        within = bool(x.inside and not x.clutter)
        if isinstance(x, Block):
            seen["clutter" if x.clutter else f"word {x.kind}", within] += x.text.count(" ") + 1
        else:
            seen["clutter tag" if x.clutter else f"tag {x.kind}", within] += 1
    return seen


def weights_from(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log odds of each kind of token for the article, words at least a little for and tags a little against."""
    sides = {side: sum(n for (_, s), n in counts.items() if s == side) + 1.0 for side in (True, False)}
    out = {}
    for kind in {k for k, _ in counts}:
        inside, outside = counts.get((kind, True), 0) + 0.5, counts.get((kind, False), 0) + 0.5
        odds = max(-LIMIT, min(LIMIT, math.log(inside / sides[True]) - math.log(outside / sides[False])))
        if kind == "clutter":
            out[kind] = min(CLUTTER, odds)
        elif "tag" in kind.split():
            out[kind] = max(2 * TAG, min(TAG / 4, odds))
        else:
            out[kind] = max(WORD / 2, odds) if kind != "word a" else odds
    return out


def best_region(items: list[Block | Tag], weights: dict[str, float]) -> tuple[int, int]:
    """The contiguous run of items with the highest sum, found in one scan; (0, 0) if none is above 0."""
    best = total = 0.0
    found, start = (0, 0), 0
    for i, x in enumerate(items):
        if isinstance(x, Tag):
            score = weights.get("clutter tag" if x.clutter else f"tag {x.kind}", TAG)
        else:
            n = x.text.count(" ") + 1
            if x.clutter:
                # Clutter within an article is left out of it without dividing it.
                score = 0.0 if x.inside else n * weights.get("clutter", CLUTTER)
            else:
                score = n * (weights.get(f"word {x.kind}", WORD) + (LIMIT if x.inside else 0.0))
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, found = total, (start, i + 1)
    return found


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """Blocks of the best region, clutter left out, joined by blank lines.

    A region that reaches into an article element is widened to all of it.
    """
    items = scan(page or "")
    start, stop = best_region(items, weights)
    around = {x.inside for x in items[start:stop] if x.inside and isinstance(x, Block)}
    if around:
        start = min(start, next(i for i, x in enumerate(items) if x.inside in around))
        stop = max(stop, next(i for i in range(len(items), 0, -1) if items[i - 1].inside in around))
    kept = [x.text for x in items[start:stop] if isinstance(x, Block) and not x.clutter and (x.inside or not around)]
    return "\n\n".join(kept)


def learned_weights(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Weights from all pages that name their article themselves.

    Counts by kind of token; the kinds are those of HTML, so what reaches the driver has a
    fixed bound of two rows for each kind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in pieces(batches, "html"):
            for page in batch.column("html").to_pylist():
                if page:
                    total.update(labelled_counts(scan(page)))
        yield pa.record_batch(
            [pa.array([k for k, _ in total], pa.string()), pa.array([s for _, s in total], pa.bool_()), pa.array(list(total.values()), pa.int64())],
            ["kind", "inside", "n"],
        )

    rows = pages.select(F.col(html_col).alias("html")).mapInArrow(run, "kind string, inside boolean, n long")
    return weights_from({(r.kind, r.inside): r.n for r in rows.groupBy("kind", "inside").agg(F.sum("n").alias("n")).collect()})


def extract(pages: DataFrame, weights: dict[str, float], key: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """``key, *keep, text, n_chars`` of every page, in place.

    A null or empty page, or one without an article, has an empty text. Null keys and repeated
    rows stay as they are; columns that aren't named are ignored; very long pages are worked on
    one at a time.
    """
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (key, *keep)}
    names = [f"c{i}" for i in range(len(kinds))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            texts = [main_text(p, weights) for p in batch.column("html").to_pylist()]
            yield pa.record_batch(
                [*(batch.column(c) for c in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [*names, "text", "n_chars"],
            )

    rows = pages.select(*[F.col(c).alias(n) for c, n in zip(kinds, names)], F.col(html_col).alias("html"))
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds.values())) + ", text string, n_chars long"
    return rows.mapInArrow(run, schema).toDF(*kinds, "text", "n_chars")


@query()
def op10_html_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages, with weights from the pages that name their article."""
    pages = table(spark, sf_dir, "pages")
    return extract(pages, learned_weights(pages))
