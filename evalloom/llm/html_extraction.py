"""Main-text extraction by line-block distribution.

Markup is stripped into blocks (one "line" each), the weights of a sliding window of lines are summed, and the text
between a surge of that sum and the next dive is kept. A line weighs its text outside links, and nothing if it is mostly
links. Text that stands bare in a container, rather than in a paragraph, heading, list or table, weighs an eighth; so does
text in an element whose class, id or role names page furniture, and, if the page marks its article (article or main), text
outside it. A line that is weighed down counts only if it is a surge even so. In a marked article a line counts as a surge at
least; there an element with a furniture name only loses that. Elements that are furniture by their tag (menus, forms,
scripts) or hidden give no lines.

Defined results: null or empty html gives an empty text; of pages without any surge of structured text, bare text weighs
in full; of pages without any surge at all, all lines that have weight stay; the empty text if nothing is left after stripping.
End tags may be omitted where HTML allows it. Very long and very deep pages are read whole in linear time; repeated rows
give repeated results; extra columns of the input pass through unless they clash with ``text`` or ``n_chars``, which are replaced.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: Subtrees whose text is never main text.
SKIP_TAGS = frozenset("script style noscript template head title nav header footer aside form button select textarea iframe svg canvas object video audio dialog menu".split())
#: Elements whose content is not markup: it ends at the own end tag only.
RAW_TAGS = frozenset("script style textarea title iframe noscript template svg".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK_TAGS = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: Names in class, id or role that mark page furniture.
FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|banner|sponsor(?:ed)?|promo|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|footer|foot|header|masthead|topbar|"
    r"comments?|commentlist|disqus|replies|reply|respond|cookies?|consent|gdpr|notice|alert|popup|modal|newsletter|subscribe|signup|login|search|social|share|sharing|related|recommended|widget|toolbar|pagination|copyright|legal|disclaimer|contentinfo|complementary)(?:$|[\s_-])",
    re.I,
)
KEEP_FURNITURE_TAGS = frozenset("html body main article".split())
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*?)(?:>|$)", re.S)
ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
SPACE = re.compile(r"\s+")
#: An element that opens ends open ones of these kinds, up to the nearest of those boundaries.
_CELLS = frozenset(("td", "th"))
IMPLIED = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "td": (_CELLS, frozenset(("tr", "table"))),
    "th": (_CELLS, frozenset(("tr", "table"))),
    "tr": (_CELLS | {"tr"}, frozenset(("table",))),
    "tbody": (_CELLS | {"tr", "thead", "tbody"}, frozenset(("table",))),
}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Blocks whose own text is content rather than left over in a container.
STRUCTURED = HEADINGS | frozenset("p pre blockquote li dt dd td th figcaption caption summary".split())


class Line(NamedTuple):
    """A block: its text, the characters inside links, and where it stands."""

    text: str
    linked: int
    within: bool = False
    named: bool = False
    bare: bool = False


def _skipped(tag: str, attrs: str) -> bool:
    return tag in SKIP_TAGS or bool(attrs and tag not in KEEP_FURNITURE_TAGS and HIDDEN.search(attrs))


def _named(tag: str, attrs: str) -> bool:
    return bool(attrs) and tag not in KEEP_FURNITURE_TAGS and any(FURNITURE.search(m[2] or m[3] or m[4] or "") for m in ATTR.finditer(attrs))


def _opens(tag: str, skipped: str, in_article: bool) -> bool:
    """Whether an element within a skipped one shows that it is no furniture."""
    if skipped == "form":
        return tag in ("article", "main", "h1")
    return in_article and tag == "h1" and skipped not in ("nav", "footer", "aside")


class _Open:
    """The open elements, with what is asked of them at hand: where each tag is open, and which block is the innermost."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.named: list[bool] = []
        self.at: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        self.n_named = 0

    def push(self, tag: str, named: bool) -> None:
        if tag in BLOCK_TAGS:
            self.blocks.append(len(self.tags))
        self.at[tag].append(len(self.tags))
        self.tags.append(tag)
        self.named.append(named)
        self.n_named += named

    def cut(self, depth: int) -> None:
        """End all elements from ``depth`` on."""
        while len(self.tags) > depth:
            tag = self.tags.pop()
            self.at[tag].pop()
            self.n_named -= self.named.pop()
            if tag in BLOCK_TAGS:
                self.blocks.pop()

    def last(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def count(self, tag: str) -> int:
        return len(self.at.get(tag, ()))

    def implied(self, tag: str) -> int | None:
        """From where on elements end because ``tag`` opens."""
        if tag in IMPLIED:
            kinds, within = IMPLIED[tag]
            bound = self.last(within)
            ends = [i for k in kinds for i in self.at.get(k, ())[-1:] if i > bound]
            return min(ends) if ends else None
        if tag in BLOCK_TAGS and self.count("p") and self.blocks[-1] == self.at["p"][-1]:
            return self.at["p"][-1]  # a block ends an open paragraph and what is open in it
        return None


def html_blocks(source: str) -> list[Line]:
    """Blocks of the page in order. Furniture by tag and hidden subtrees are left out; unclosed elements end with their ancestor."""
    lines: list[Line] = []
    buf: list[str] = []
    link_buf: list[str] = []  # of it, the text inside links
    open_ = _Open()
    skip_at: int | None = None  # depth of the subtree that is being skipped
    at = 0
    raw_end = None

    def plain(parts: list[str]) -> str:
        return SPACE.sub(" ", html_lib.unescape("".join(parts))).strip()

    def inside() -> bool:
        return open_.count("article") + open_.count("main") > 0

    def flush() -> None:
        text = plain(buf)
        if text:
            block = open_.tags[open_.blocks[-1]] if open_.blocks else ""
            named = open_.n_named > 0 and not (block == "h1" and inside())  # the title of an article, whatever it stands in
            lines.append(Line(text, len(plain(link_buf)), inside(), named, block not in STRUCTURED))
        buf.clear()
        link_buf.clear()

    n = len(source)
    while at < n:
        if raw_end:
            m = re.compile(rf"</{raw_end}\s*[^>]*>", re.I).search(source, at)
            at = m.end() if m else n
            if open_.tags and open_.tags[-1] == raw_end:
                open_.cut(len(open_.tags) - 1)
                if skip_at is not None and len(open_.tags) < skip_at:
                    skip_at = None
            raw_end = None
            continue
        m = TOKEN.search(source, at)
        text = source[at : m.start()] if m else source[at:]
        if text and skip_at is None:
            buf.append(text)
            if open_.count("a"):
                link_buf.append(text)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag, closing, attrs = m[2].lower(), bool(m[1]), m[3] or ""
        if tag == "br" or tag == "wbr":
            if skip_at is None:
                buf.append(" " if tag == "br" else "")
            continue
        if (tag in BLOCK_TAGS or tag in SKIP_TAGS) and skip_at is None:
            flush()
        if closing:
            if open_.count(tag):
                open_.cut(open_.at[tag][-1])
                if skip_at is not None and len(open_.tags) < skip_at:
                    skip_at = None
            continue
        if tag in VOID_TAGS:
            continue
        ends = open_.implied(tag)
        if ends is not None and (skip_at is None or ends >= skip_at - 1):
            open_.cut(ends)
            if skip_at is not None and len(open_.tags) < skip_at:
                skip_at = None
        if attrs.endswith("/") and tag in ("svg", "iframe"):
            continue
        open_.push(tag, _named(tag, attrs))
        if skip_at is not None and len(open_.tags) > skip_at and _opens(tag, open_.tags[skip_at - 1], inside()):
            skip_at = None  # a form around the page, a header in the article: what comes from here on is not furniture
        if skip_at is None and _skipped(tag, attrs):
            skip_at = len(open_.tags)
        if tag in RAW_TAGS:
            raw_end = tag
    if skip_at is None:
        flush()
    return lines


def html_lines(source: str) -> list[tuple[str, int, bool]]:
    """(text, characters inside links, within an article or main element) of each block."""
    return [tuple(x[:3]) for x in html_blocks(source)]


#: Share that a line weighs where it stands bare, under a furniture name, or outside the marked article.
DOWN = 0.125


def line_weights(lines: list[Line], surge: int = 80, link_share: float = 0.5, bare: float = DOWN) -> list[float]:
    marked = any(x.within for x in lines)
    out: list[float] = []
    for x in lines:
        own = 0 if x.linked > link_share * len(x.text) else len(x.text) - x.linked
        if x.within and not x.named:
            out.append(max(len(x.text), surge))
            continue
        if x.within:
            out.append(own if own >= surge else 0)
            continue
        share = (DOWN if marked else 1.0) * (DOWN if x.named else 1.0) * (bare if x.bare else 1.0)
        out.append(own * share if share == 1.0 or own * share >= surge else 0)
    return out


def regions(own: list[float], window: int = 3, surge: int = 80, back: int = 0) -> list[bool]:
    """Whether each line lies between a surge and the next dive: the sum over ``window`` lines reaches ``surge``, and falls to zero.

    A region begins up to ``back`` lines earlier, as far as the lines before its surge have weight: short ones before the first long one.
    """
    keep, is_open = [], False
    for i, w in enumerate(own):
        total = sum(own[i : i + window])
        if not is_open and total >= surge and w:
            is_open = True
            for j in range(i - 1, max(-1, i - 1 - back), -1):
                if not own[j]:
                    break
                keep[j] = True
        elif is_open and total == 0:
            is_open = False
        keep.append(is_open and w > 0)
    return keep


def main_lines(lines: list[Line], window: int = 3, surge: int = 80) -> list[str]:
    """The lines between surge and dive points of the windowed weights."""
    own = line_weights(lines, surge)
    kept = regions(own, window, surge, back=window - 1)
    if not any(kept):  # no structure on this page: text counts as it stands
        own = line_weights(lines, surge, bare=1.0)
        kept = regions(own, window, surge)
    return [x.text for x, k in zip(lines, kept if any(kept) else own, strict=True) if k]


def extract_main_text(source: str | None) -> str:
    return "\n\n".join(main_lines(html_blocks(source))) if source else ""


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` (main text, never null) and ``n_chars`` (its code points) instead of the html."""
    keep = [f for f in pages.schema.fields if f.name.lower() not in (html_col.lower(), "text", "n_chars")]
    schema = T.StructType([*keep, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = [extract_main_text(x) for x in pdf[html_col]]
            out = pdf[[f.name for f in keep]].copy()
            out["text"] = text
            out["n_chars"] = [len(x) for x in text]
            yield out

    return pages.select(*[F.col(f"`{f.name}`") for f in keep], F.col(f"`{html_col}`")).mapInPandas(run, schema)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
