"""Main text of web pages: streamed parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

The standard library's parser streams a page as events.  Every block becomes a line with its text length and number of
tags; lines belong to the nearest container, and containers form a tree.  The ratios of text to tags of all lines,
boilerplate too, are smoothed with a Gaussian, and lines outside marked boilerplate at or above one standard deviation are
content (Weninger et al., CETR).  Inside ``article`` or ``main`` half of that is enough, and if one holds content the rest of
the page does not count; if none does, the whole page is judged.  Content lines cluster in the smallest container around
them, widened to its parent if it is only a ``div``, ``section``, ``table`` or cell.  Containers in there are kept whole,
headings, short paragraphs and cells too, unless at least half of their text is links (smoothing lets links beside long
text pass); if that leaves none, those with content lines stay.  If no line passes, the one with the largest smoothed ratio stands for them.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import picked

#: Elements without article text.
SKIPPED = frozenset("head title script style noscript template iframe object svg canvas nav footer aside form button select "
                    "textarea menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
                   "footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot "
                   "th thead tr ul".split())
CONTAINERS = frozenset("article body div main section table td".split())
#: A start tag of the first closes an open element of the second.
CLOSES = {"li": {"li", "p"}, "dd": {"dd", "dt", "p"}, "dt": {"dd", "dt", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
          "tr": {"tr", "td", "th", "p"}, "body": {"head"}}
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search".split())
NAMES = re.compile(
    r"(?:(?:site|page|main|top|bottom|left|right|global|user|reader|cookie|post|article|blog|google|sticky|mobile)[-_]?)?"
    r"(?:ads?|adverts?|advertisement|adsense|advertising|sponsor(?:ed|s)?|promo(?:tion|s)?|banner|cookies?|consent|gdpr|notices?|"
    r"newsletter|subscribe|subscription|signup|login|popup|modal|overlay|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|"
    r"rail|footer|comments?|commentlist|discussion|replies|disqus|related|recommended|share|sharing|social|widgets?|toolbar|"
    r"pagination|pager|skip|masthead|teasers?|cta|author[-_]?bio)(?:[-_]?(?:\d+|box|bar|list|area|section|wrap|wrapper|container|links?|block|slot|unit|"
    r"form|thread|item|body|inner|outer|top|bottom|left|right|main|text|banner|notice))*", re.I)
#: Of the limit for content, what suffices inside ``article`` and ``main``.
PRIOR = 0.5
HEADER = re.compile(r"(?:site|page|main|top|global)?[-_]?header(?:[-_]?(?:bar|wrap|wrapper|container|inner|top|main))*", re.I)


class Lines(HTMLParser):
    """Collects the lines of one page: (text, tags, region, boilerplate, code points in links)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool, int]] = []
        self.open: list[tuple[str, bool, int]] = []  # name, boilerplate, region
        self.kinds = {0: "page"}
        self.paths: dict[int, tuple[int, ...]] = {0: (0,)}  # from the page down to the region
        self.link, self.linked = False, 0
        self.text: list[str] = []
        self.tags = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text or self.tags:
            _, skipped, region = self.open[-1] if self.open else ("", False, 0)
            self.lines.append((text, self.tags, region, skipped, self.linked))
        self.text, self.tags, self.linked = [], 0, 0

    def _boilerplate(self, tag: str, attrs: dict[str, str | None]) -> bool:
        if tag in SKIPPED:
            return True
        if tag in ("main", "body", "html"):
            return False
        inside = any(name in ("article", "main") for name, _, _ in self.open)
        if tag == "header" and not inside:
            return True
        if "hidden" in attrs or attrs.get("aria-hidden") == "true" or (attrs.get("role") or "").lower() in ROLES:
            return True
        if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style") or "", re.I):
            return True
        names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split()
        return any(NAMES.fullmatch(n) or not inside and HEADER.fullmatch(n) for n in names)

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "br":
            self.text.append(" ")
        if tag in BLOCKS:
            self.flush()
            closes = CLOSES.get(tag, {"p"})
            while self.open and self.open[-1][0] in closes:
                self.open.pop()
        self.tags += 1
        if tag == "a":
            self.link = any(name == "href" for name, _ in attrs)
        if tag in VOID or tag not in BLOCKS and tag not in SKIPPED and not attrs:
            return
        _, skipped, region = self.open[-1] if self.open else ("", False, 0)
        boilerplate = self._boilerplate(tag, dict(attrs))
        if tag not in BLOCKS and tag not in SKIPPED and not boilerplate:
            return
        if tag not in BLOCKS and boilerplate:
            self.flush()
        if tag in CONTAINERS:
            above, region = region, len(self.kinds)
            self.kinds[region] = tag
            self.paths[region] = (*self.paths[above], region)
        self.open.append((tag, skipped or boilerplate, region))

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        self.link = self.link and tag != "a"
        if not any(name == tag for name, _, _ in self.open):
            if tag in BLOCKS:
                self.flush()
            return
        self.flush()
        while self.open.pop()[0] != tag:
            pass

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.open[-1][0] == tag:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        self.linked += len(data.strip()) if self.link else 0


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    reach = max(1, math.ceil(3 * sigma))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weights /= weights.sum()
    return np.convolve(np.pad(ratios, reach, mode="edge"), weights, mode="valid")


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The blocks of the content regions of one page, one per line; empty for null, empty or text-free pages."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines, kinds, paths = parser.lines, parser.kinds, parser.paths
    usable = [i for i, (text, _, _, skipped, _) in enumerate(lines) if text and not skipped]
    if not usable:
        return ""
    ratio = smoothed(np.array([len(text) / max(1, tags) for text, tags, *_ in lines]), sigma)
    limit = ratio.std()
    for kind, share in (("article", PRIOR), ("main", PRIOR), ("", 1.0)):
        around = {r for r, path in paths.items() if not kind or any(kinds[x] == kind for x in path)}
        passing = [i for i in usable if lines[i][2] in around and ratio[i] >= share * limit]
        if passing:
            break
    passing = passing or [max(usable, key=lambda i: ratio[i])]
    return "\n".join(lines[i][0] for i in _cluster(lines, kinds, paths, [i for i in usable if lines[i][2] in around], passing))


def _cluster(lines: list, kinds: dict, paths: dict, usable: list[int], passing: list[int]) -> list[int]:
    """The usable lines of the containers that the content lines are in or beside, without lists of links."""
    content = {lines[i][2] for i in passing}
    shared = paths[lines[passing[0]][2]]
    for region in content:
        shared = shared[:sum(1 for _ in itertools.takewhile(lambda ab: ab[0] == ab[1], zip(shared, paths[region])))]
    if kinds[shared[-1]] not in ("article", "main", "body", "page"):
        shared = shared[:-1]
    size, linked = Counter(), Counter()
    for i in usable:
        size[lines[i][2]] += len(lines[i][0])
        linked[lines[i][2]] += lines[i][4]
    whole = {r for r in size if shared[-1] in paths[r] and 2 * linked[r] < size[r]} or content
    return [i for i in usable if lines[i][2] in whole]


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
                      sigma: float = 1.0) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages``; one narrow pass, no shuffle.

    Null or empty html gives an empty text; null ids and urls are passed on; repeated rows stay; an empty table gives an
    empty one.  Nothing is cut from long pages."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, sigma) for h in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    rows = picked(pages, page_id=page_id, url=url, html=html)
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
