"""Main text of web pages as a maximum-scoring subsequence of tokens.

A page is a run of tokens: words, which score positive, and tags, which score negative. How negative a tag
is comes from labelled pages: on pages that mark their article (one <article> or <main> element) tags are
counted inside and outside of it, and a tag's weight is the scaled log of its share inside. Tags that do not
occur inside an article cost most, so the best contiguous run stops before them. One linear scan (Kadane)
finds that run; its blocks are the text. Elements that are never article text (scripts, styles, menus,
forms, ...) and those whose class, id or role is the name of a menu, advert, notice or comment are left out.
Such a name is a whole word of the attribute, made of NOT_TEXT and PLACE parts only; it counts for no heading
and no element that holds an article or main element. A left-out element ends by HTML's rules: with its end
tag, with the end tag of an element around it, or where the next tag implies its end.

Defined results: null or empty html gives an empty text; a page without tags is one block; markup cut short
at the end of a page is dropped; of several best runs the first counts; repeated rows are done one by one;
without labelled pages the weights are DEFAULT.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fields, workers_import_this

#: Most pages that weights are learnt from: those with the smallest hashes.
SAMPLE = 2_000
SCALE, LEAST, MOST = 4.0, 0.05, 60.0
#: A tag that neither labelled pages nor DEFAULT have costs this; a left-out element costs LEAST.
GAP = 8.0
WORD_WEIGHT = 1.0
#: Element names.
DROPPED = frozenset("script style noscript template iframe svg math head title object canvas audio video".split())
BOILERPLATE = frozenset("nav header footer aside form button select option textarea menu dialog fieldset label input".split())
BLOCKS = frozenset(
    "address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo br cite code data dfn em i img kbd mark q s samp small span strong sub sup time u var wbr".split())
#: Parts of names in class, id or role that mark what is no article text, and parts that may stand beside them.
NOT_TEXT = re.compile(
    r"ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice|notification|popup|modal|newsletter|subscribe|nav\w*|menu\w*|breadcrumb\w*|sidebar|widget|footer|foot|header|masthead|toolbar|share|sharing|social|related|recommend\w*|comment\w*|disqus|replies|reply|respond|search|login|signup|pagination|pager|skip|copyright|disclaimer|navigation|complementary|contentinfo",
    re.IGNORECASE,
)
PLACE = frozenset("site top bottom left right primary secondary global main list item items box container wrapper wrap block bar area inner outer links buttons icons form posts articles stories section".split())
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|"[^"]*"|'[^']*'""")
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.IGNORECASE)
#: HTML's implied ends. These start tags end an open p; SIBLINGS end the named ones, inside of the second.
ENDS_P = frozenset("address article aside blockquote dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table ul".split())
SIBLINGS = {"tr": (("tr",), ("table",))} | {n: (("td", "th"), ("table", "tr")) for n in ("td", "th")} | {n: (("tbody", "thead", "tfoot"), ("table",)) for n in ("tbody", "thead", "tfoot")} | {"option": (("option",), ("select",))}
LIST_ITEMS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt")}
CELLS = ("table", "td", "th", "caption")
TABLE_PARTS = frozenset("td th tr tbody thead tfoot caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.DOTALL)
#: Weights where no page is labelled.
DEFAULT = dict.fromkeys("a abbr b blockquote br cite code del em figcaption figure h1 h2 h3 h4 h5 h6 i img ins li ol p pre q s small span strong sub sup u ul wbr".split(), -LEAST) | dict.fromkeys(
    "div section table tbody tr td th dl dt dd hr details summary".split(), -1.0
)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): kind is text, open or close; the insides of DROPPED elements do not come."""
    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            yield "text", "", page[at:]
            return
        if m.start() > at:
            yield "text", "", page[at : m.start()]
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, rest = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in DROPPED:
            if not closing and not rest.rstrip().endswith("/"):
                stop = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, at)
                if stop:
                    at = stop.end()
                elif name not in ("head", "title"):
                    return
            continue
        yield "close" if closing else "open", name, rest


def boilerplate_name(name: str) -> bool:
    parts = [p for p in re.split(r"[_-]+", name.lower().replace("side-bar", "sidebar")) if p]
    hits = [bool(NOT_TEXT.fullmatch(p)) for p in parts]
    return any(hits) and all(hit or p in PLACE or p.isdigit() for hit, p in zip(hits, parts, strict=True))


def named(rest: str) -> tuple[bool, bool]:
    """Of a tag's attributes: whether a name is one of boilerplate, whether the element is hidden."""
    by_name = hidden = False
    for key, a, b, c in ATTRIBUTE.findall(rest):
        key, value = key.lower(), a or b or c
        if key in ("class", "id", "role"):
            by_name = by_name or any(map(boilerplate_name, value.split()))
        elif key == "hidden" or key == "aria-hidden" and value.strip().lower() == "true" or key == "style" and NO_DISPLAY.search(value):
            hidden = True
    return by_name, hidden


def element_ends(found: list[tuple[str, str, str]]) -> dict[int, int]:
    """For each start tag of an element with content, the first token after the element."""
    ends: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    depths: dict[str, list[int]] = {}
    #: Depths of block elements, and of those that an li, dd or dt does not look beyond.
    walls: list[int] = []
    strict: list[int] = []

    def last(*names: str) -> int:
        return max((depths[n][-1] for n in names if depths.get(n)), default=-1)

    def close(depth: int, at: int) -> None:
        while len(stack) > depth:
            name, start = stack.pop()
            depths[name].pop()
            for kind in (walls, strict):
                if kind and kind[-1] == len(stack):
                    kind.pop()
            ends[start] = at

    for at, (kind, name, rest) in enumerate(found):
        if kind == "open":
            if name in ENDS_P and (p := last("p")) > last(*CELLS, "button"):
                close(p, at)
            if name in LIST_ITEMS and (d := last(*LIST_ITEMS[name])) >= 0 and d >= (strict[-1] if strict else -1):
                close(d, at)
            elif name in SIBLINGS and (d := last(*SIBLINGS[name][0])) > last(*SIBLINGS[name][1]):
                close(d, at)
            if name in VOID or rest.rstrip().endswith("/"):
                continue
            if name in BLOCKS or name in BOILERPLATE and name != "label":
                walls.append(len(stack))
                if name not in ("address", "div", "p"):
                    strict.append(len(stack))
            depths.setdefault(name, []).append(len(stack))
            stack.append((name, at))
        elif kind == "close" and (d := last(name)) >= 0:
            if name in ("html", "body", "table"):
                wall = -1
            elif name in TABLE_PARTS:
                wall = last("table")
            elif name in BLOCKS or name in BOILERPLATE and name != "label":
                wall = last(*CELLS, *(("button",) if name == "p" else ("ul", "ol") if name == "li" else ()))
            else:
                wall = walls[-1] if walls else -1
            if d > wall:
                start = stack[d][1]
                close(d, at)
                ends[start] = at + 1
    close(0, len(found))
    return ends


def left_out(found: list[tuple[str, str, str]]) -> dict[int, int]:
    """Start tags of elements that are never article text, with the first token after each."""
    names = {at: named(rest) for at, (kind, name, rest) in enumerate(found) if kind == "open" and rest.strip(" /")}
    plain = (False, False)
    ends = element_ends(found)
    held = [0]
    for at, (kind, name, _) in enumerate(found):
        held.append(held[-1] + (kind == "open" and name in ("article", "main") and not names.get(at, plain)[0]))
    out = {}
    for at, end in ends.items():
        name = found[at][1]
        by_name, hidden = names.get(at, plain)
        if name in BOILERPLATE and name != "form":
            out[at] = end
        elif name in ("html", "body", "article", "main"):
            continue
        elif hidden or (name == "form" or by_name and name not in HEADINGS) and held[end] == held[at + 1]:
            out[at] = end
    return out


def blocks(page: str, weights: dict[str, float]) -> list[tuple[float, str | None]]:
    """The page's tokens as (weight, text): a run of words of one block, or (weight, None) for tags."""
    out: list[tuple[float, str | None]] = []
    words: list[str] = []
    cost = 0.0

    def flush() -> None:
        nonlocal cost
        text = " ".join(html.unescape("".join(words)).split())
        if text:
            out.append((WORD_WEIGHT * (text.count(" ") + 1) + cost, text))
        elif cost:
            out.append((cost, None))
        words.clear()
        cost = 0.0

    found = list(tokens(page))
    skips = left_out(found)
    after = 0
    for at, (kind, name, rest) in enumerate(found):
        if at < after:
            continue
        if kind == "text":
            words.append(rest)
            continue
        skip = kind == "open" and at in skips
        if skip:
            after = skips[at]
        weight = weights.get(name, -GAP)
        if name == "br" or name not in BLOCKS:
            if name in ("br", "img", "wbr") or name not in INLINE:
                words.append(" ")
            if not skip:
                cost += weight
            continue
        flush()
        out.append((-LEAST if skip else weight, None))
    flush()
    return out


def best_run(scored: list[tuple[float, str | None]]) -> tuple[int, int]:
    """[start, end) of the contiguous run of the largest sum, by one scan."""
    best, at, sum_, start = 0.0, (0, 0), 0.0, 0
    for k, (weight, _) in enumerate(scored):
        if sum_ <= 0:
            sum_, start = 0.0, k
        sum_ += weight
        if sum_ > best:
            best, at = sum_, (start, k + 1)
    return at


def main_text(page: str, weights: dict[str, float]) -> str:
    scored = blocks(page, weights)
    a, b = best_run(scored)
    return "\n\n".join(text for _, text in scored[a:b] if text)


MARKED = re.compile(r"<(article|main)\b[^>]*>", re.IGNORECASE)


def tag_counts(page: str) -> tuple[Counter, Counter] | None:
    """Tags inside and outside of a page's one article element, without those in left-out elements; None if the page does not mark one."""
    names = [m[1].lower() for m in MARKED.finditer(page)]
    own = "article" if names.count("article") == 1 else "main" if names.count("main") == 1 else None
    if own is None:
        return None
    inside, outside, within, after = Counter(), Counter(), False, 0
    found = list(tokens(page))
    skips = left_out(found)
    for at, (kind, name, _) in enumerate(found):
        if kind == "text" or at < after:
            continue
        if kind == "open" and at in skips:
            after = skips[at]
        elif name == own:
            outside[name] += 1
            within = kind == "open"
        else:
            (inside if within else outside)[name] += 1
    return inside, outside


def learn_weights(pages: DataFrame, most: int = SAMPLE) -> dict[str, float]:
    """Tag weights from at most ``most`` different marked pages; only counts of known element names reach the
    driver. Hashes are ranked first, so only the chosen pages move."""
    html_text = F.col("html").cast("string")
    marked = pages.filter(F.col("html").rlike(r"(?i)<(article|main)[\s>]")).select(F.xxhash64(html_text).alias("own"), html_text.alias("html"))
    chosen = marked.select(F.col("own").alias("rank")).distinct().orderBy("rank").limit(most)
    # Bounded by ``most`` numbers.
    sample = marked.join(F.broadcast(chosen), F.col("own") == F.col("rank"), "left_semi").dropDuplicates(["own"]).select("html")
    named = sorted(BLOCKS | INLINE | BOILERPLATE | VOID)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, outside = Counter(), Counter()
        for batch in batches:
            for page in batch.column("html").to_pylist():
                if found := tag_counts(page):
                    inside.update(found[0])
                    outside.update(found[1])
        tags = [t for t in named if inside[t] or outside[t]]
        yield pa.RecordBatch.from_pydict({"tag": pa.array(tags, pa.string()), "inside": pa.array([inside[t] for t in tags], pa.int64()), "outside": pa.array([outside[t] for t in tags], pa.int64())})

    rows = sample.mapInArrow(count, fields(("tag", "string"), ("inside", "long"), ("outside", "long"))).groupBy("tag").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o")).collect()
    if not rows:
        return dict(DEFAULT)
    return DEFAULT | {r["tag"]: -min(MOST, max(LEAST, -SCALE * math.log((r["i"] + 0.01) / (r["i"] + r["o"] + 0.01)))) if r["i"] else -MOST for r in rows}


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text of every row. No shuffle."""
    workers_import_this(pages.sparkSession)
    weights = learn_weights(pages) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([main_text(p, weights) for p in batch.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), found], names=["page_id", "url", "text"])

    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return base.mapInArrow(run, fields(("page_id", "long"), ("url", "string"), ("text", "string")))


def op9_html_main(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
