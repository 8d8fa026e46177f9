"""Main text of web pages: the best contiguous run of words and tags.

A page becomes a row of scored tokens: words score positive, tags negative, and one linear scan finds the contiguous run with
the highest sum. The scores are log-odds of standing inside the article, learned from labelled pages, here pages whose own
markup names their article. A whole menu, header, footer, sidebar, notice, advert, form, script, style or comment thread is
one tag-like token without words, so that the run can pass over an advert inside an article but never takes its text.

Null and empty html give an empty text. Broken markup (a tag never closed, a quote left open) is read as far as it goes; an
unclosed script or comment ends with the page. Runs that tie: the first. Repeated pages give equal rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field
from math import log

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gridweather.llm.common import written

# Names of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
    "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
BLOCKS = {
    "address", "article", "blockquote", "body", "br", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1",
    "h2", "h3", "h4", "h5", "h6", "hgroup", "hr", "html", "img", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td",
    "tfoot", "th", "thead", "tr", "ul",
}
RAW = ("script", "style", "noscript", "template", "textarea", "svg", "math", "iframe", "object", "title", "head", "select", "canvas", "audio", "video")
ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar"}
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscribe|signup|"
    r"menu|nav\w*|breadcrumbs?|sidebar|side|footer|foot|header|masthead|toolbar|pagination|pager|share|sharing|social|related|recommend\w*|"
    r"comments?|comment-\w+|disqus\w*|respond|replies|widget|login)(?:$|[\s_-])",
    re.I,
)
COMMENT, SCRIPTS, OTHER = "comment", "raw", "aside"

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)/?>", re.S
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


@dataclass(frozen=True)
class Weights:
    """Score of a word, and of tags by name; names not seen in the labelled pages take ``other``."""

    word: float = 2.0
    tags: dict[str, float] = field(default_factory=dict)
    other: float = -0.2

    #: Bounds that keep words positive and tags negative whatever the labelled pages say.
    WORD = (1.0, 6.0)
    TAGS = (-6.0, -0.05)


#: Used where no page names its article. Set aside content costs little, since its words are left out anyway.
DEFAULT = Weights(tags={"/article": -6.0, "/main": -6.0, "/body": -6.0, OTHER: -0.5, SCRIPTS: -0.2, COMMENT: -0.05})


def set_aside(name: str, attributes: str) -> bool:
    """Whether an element holds no main text by its name, role, class or id, or is hidden."""
    if name in ASIDE:
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    for key, *values in ATTRIBUTE.findall(attributes):
        value, key = "".join(values), key.lower()
        if key in ("class", "id") and NAMES.search(value):
            return True
        if key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
    return False


def tokens(page: str) -> list[tuple[str, str]]:
    """(tag name, "") or ("", text) in page order; what is set aside is one tag."""
    out: list[tuple[str, str]] = []
    at, skip, depth = 0, "", 0
    find = TAG.search
    while True:
        tag = find(page, at)
        if not skip:
            piece = page[at : tag.start() if tag else len(page)]
            if piece:
                out.append(("", piece))
        if not tag:
            return out
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            if not skip:
                out.append((COMMENT, ""))
            continue
        closing = bool(tag[1])
        if skip:
            if name == skip and not tag[0].endswith("/>"):
                depth += -1 if closing else 1
                if not depth:
                    skip = ""
            elif name in RAW and not closing:
                at = _after(page, at, name)
            continue
        if not closing and name in RAW:
            at = _after(page, at, name)
            out.append((SCRIPTS, ""))
        elif not closing and name not in VOID and not tag[0].endswith("/>") and set_aside(name, tag[3]):
            skip, depth = name, 1
            out.append((OTHER, ""))
        else:
            out.append(("/" + name if closing else name, ""))


_ends: dict[str, re.Pattern] = {}


def _after(page: str, at: int, name: str) -> int:
    end = _ends.setdefault(name, re.compile(rf"</{name}\s*>", re.I)).search(page, at)
    # A head that is never closed ends where the body begins.
    if not end and name == "head":
        end = re.compile(r"(?=<body\b)", re.I).search(page, at)
    return end.end() if end else len(page)


def feature(tag: str) -> str:
    name = tag.lstrip("/")
    return tag if name in BLOCKS or name in INLINE or tag in (COMMENT, SCRIPTS, OTHER) else "unknown"


def main_text(page: str | None, weights: Weights) -> str:
    """Text of the best run: inline tags leave no gap, all others and the ends of blocks one space."""
    row = tokens(page or "")
    best = (0.0, 0, 0)
    total, start = 0.0, 0
    decoded: list[str] = []
    for i, (tag, text) in enumerate(row):
        text = entities.unescape(text) if text else ""
        decoded.append(text)
        score = weights.tags.get(feature(tag), weights.other) if tag else weights.word * len(text.split())
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best[0]:
            best = (total, start, i + 1)
    parts = []
    for (tag, _), text in zip(row[best[1] : best[2]], decoded[best[1] : best[2]]):
        parts.append(text if not tag else "" if tag.lstrip("/") in INLINE or tag == COMMENT else " ")
    return " ".join("".join(parts).split())


def labelled_counts(page: str) -> Counter:
    """(feature, inside) counts of one page that names its article; words count as ``word``."""
    row, inside, seen, out = tokens(page), 0, 0, Counter()
    names = ("article", "main")
    for tag, text in row:
        if tag in names:
            out[feature(tag), False] += 1  # its own tags stand at the border, not inside
            inside, seen = inside + 1, seen + 1
        elif tag.lstrip("/") in names:
            inside = max(0, inside - 1)
            out[feature(tag), False] += 1
        elif tag:
            out[feature(tag), inside > 0] += 1
        else:
            out["word", inside > 0] += len(text.split())
    return out if seen else Counter()


def fit(pages: DataFrame, labelled_pages: int = 2_000) -> Weights:
    """Log-odds from the pages of at most ``labelled_pages`` ids that name their article, the first by id; the defaults if there are none."""
    labelled = pages.select(F.col("page_id").alias("page_id"), F.col("html").cast("string").alias("html")).where(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    # The ids alone are sorted out in one task, at most so many of each; the pages themselves are read where they lie.
    chosen = written(pages.sparkSession, labelled.select("page_id").distinct().orderBy("page_id").limit(labelled_pages), "labelled-pages")
    bounded = labelled.join(F.broadcast(chosen), labelled["page_id"].eqNullSafe(chosen["page_id"]), "left_semi")

    def count(batches):
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column("html"):
                total.update(labelled_counts(page.as_py() or ""))
        keys = list(total)
        yield pa.RecordBatch.from_pydict(
            {"feature": pa.array([k[0] for k in keys], pa.string()), "inside": pa.array([k[1] for k in keys], pa.bool_()), "n": pa.array([total[k] for k in keys], pa.int64())}
        )

    counted = bounded.mapInArrow(count, "feature string, inside boolean, n bigint")
    # One row per name of HTML at most comes back.
    rows = counted.groupBy("feature").agg(F.sum(F.when(F.col("inside"), F.col("n"))).alias("i"), F.sum(F.when(~F.col("inside"), F.col("n"))).alias("o")).collect()
    if not rows:
        return DEFAULT
    seen = {r["feature"]: (r["i"] or 0, r["o"] or 0) for r in rows}
    clip = lambda x, bounds: min(bounds[1], max(bounds[0], x))
    odds = {name: log((i + 1) / (o + 1)) for name, (i, o) in seen.items()}
    tags = {name: clip(x, Weights.TAGS) for name, x in odds.items() if name != "word"}
    tags[OTHER] = max(tags.get(OTHER, DEFAULT.tags[OTHER]), DEFAULT.tags[OTHER])
    tags[SCRIPTS] = max(tags.get(SCRIPTS, DEFAULT.tags[SCRIPTS]), DEFAULT.tags[SCRIPTS])
    tags[COMMENT] = DEFAULT.tags[COMMENT]
    return Weights(clip(odds.get("word", 0.0), Weights.WORD), DEFAULT.tags | tags)


def extracted(html: Column, weights: Weights = DEFAULT) -> Column:
    """Main text of an html column."""

    @F.arrow_udf("string")
    def of(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py(), weights) for p in pages], pa.string())

    return of(html)


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text and its length in code points."""
    weights = weights or fit(pages)
    base = pages.select("page_id", "url", extracted(F.col("html").cast("string"), weights).alias("text"))
    return base.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
