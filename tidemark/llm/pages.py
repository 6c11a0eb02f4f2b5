"""Main text of web pages by text-to-tag ratio.

The standard library's parser streams events. They become lines, one for each block of text, each with the number of
its characters and of the tags met since the line before. What stands in elements that never hold an article (scripts,
menus and so on), or in ones with a class, id or role that as a whole says so, is left out; a block left out parts the
lines into regions, an inline element doesn't. Names that tell something else (`has-sidebar`, `related-work`,
`notice-board`, `comments-open`) don't count, nor do any of an article or main element that isn't inside another one or
a block left out, nor `header` inside an article. Forms are left out, but for one that holds an article or main element,
or over half of the page's text with a paragraph in it: some servers wrap whole pages.

If the page marks an article or main part, its lines are the result. If not, each division or section of the page is a
region of its own; the ratios of characters to tags are smoothed with a Gaussian, and lines are clustered by a threshold
at a share of the page's spread of ratios: a region stays, whole, if any line of it lies in the upper cluster. So a
short paragraph or heading inside an article stays with it. Where nothing reaches the threshold, the region with the
highest ratio stays.

Null, empty and text-free pages give an empty text. Broken markup is skipped: declarations of any form, and a tag or
comment that the page ends in. Repeated rows give repeated results, an empty table none; other columns are ignored.
Pages are read whole, whatever their length, in time that grows with it, however deep elements are nested.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose start or end also ends a block of text.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p "
    "pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that hold no article text.
OUTSIDE = frozenset(
    "head title script style noscript template iframe object svg canvas audio video nav menu aside footer "
    "button select textarea dialog search fieldset".split()
)
CONTENT = frozenset(("article", "main"))
#: Elements that make a region where a page doesn't mark its article.
PART = frozenset(("body", "center", "details", "div", "section", "td"))
#: Words of a class, id or role that mark what stands beside an article.
BESIDE = re.compile(
    r"^(?:ads?|advert\w*|adsense|banners?|sponsor(?:ed|s)?|promo\w*|nav\w*|menus?|breadcrumbs?|sidebars?|side|aside|"
    r"footers?|headers?|masthead|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|overlay|newsletter|subscri\w+|"
    r"signup|login|social|shar(?:e|ing)|comments?|replies|reply|disqus|respond|related|recommend\w*|widgets?|"
    r"toolbar|pagination|pager|search|complementary|contentinfo|navigation|banner|dialog)$"
)
#: Words that may stand with those: they tell form and place, not another thing.
WITH_BESIDE = re.compile(
    r"^(?:area|articles?|bars?|blocks?|body|bottom|box(?:es)?|btns?|buttons?|col(?:umn)?|container|content|entry|form|global|"
    r"holder|icons?|inner|items?|js|layout|left|links?|lists?|main|page|panels?|post|posts?|primary|region|right|rows?|"
    r"secondary|section|site|slots?|stories|story|threads?|top|units?|user|web|wrap(?:per)?|\d+)$"
)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_MARKING = ("class", "id", "role")


#: First words of a name that tell what it doesn't hold itself, and last words that tell a state.
_ABOUT, _STATE = frozenset("category cat tag".split()), frozenset("open opened closed enabled disabled".split())
_HEADER, _ARTICLE = frozenset(("header", "headers")), frozenset("article content entry post story".split())


def _marks(name: str, in_article: bool) -> bool:
    """Whether one name of a class, id or role says, as a whole, that its element stands beside the article."""
    words = [w.lower() for w in _WORD.findall(name)]
    if len(words) > 1 and (words[0] in _ABOUT or words[-1] in _STATE):
        return False
    own_header = in_article or not _ARTICLE.isdisjoint(words)
    beside = [bool(BESIDE.match(w)) for w in words]
    if own_header and all(w in _HEADER for w, b in zip(words, beside) if b):
        return False
    return any(beside) and all(b or WITH_BESIDE.match(w) for w, b in zip(words, beside))


def _hidden(attributes: list[tuple[str, str | None]]) -> bool:
    return any(name == "hidden" or name == "aria-hidden" and value == "true" for name, value in attributes)


def _beside(attributes: list[tuple[str, str | None]], in_article: bool) -> bool:
    """Whether an element's own names say that it stands beside the article."""
    names = [one for name, value in attributes if name in _MARKING and value for one in value.split()]
    return any(_marks(name, in_article) for name in names)


@dataclass
class Form:
    """What a form on a page holds."""

    holds_article: bool = False
    has_paragraph: bool = False
    chars: int = 0


@dataclass(frozen=True)
class Line:
    """A block of text: the tags before and in it, its region and part, whether an article or main element holds it, its forms."""

    text: str
    tags: int
    region: int
    part: int
    content: bool
    forms: tuple[Form, ...]


class Lines(HTMLParser):
    """The lines of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self._open: list[tuple[str, bool]] = []  # open elements, and whether each is left out
        self._places: dict[str, list[int]] = {}  # of the open elements of a name
        self._blocks: list[int] = []  # places of the open blocks
        self._parts: list[int] = [0]
        self._forms: list[Form] = []
        self._outs: list[int] = []  # places of the open elements left out
        self._out = self._hard = self._content = self._tags = self._region = self._made = 0
        self._text: list[str] = []

    def _end_line(self) -> None:
        text = " ".join("".join(self._text).split())
        self._text.clear()
        if text:
            for form in self._forms:
                form.chars += len(text)
            self.lines.append(Line(text, self._tags, self._region, self._parts[-1], self._content > 0, tuple(self._forms)))
            self._tags = 0

    def handle_starttag(self, tag, attrs):
        self._tags += 1
        if tag in BLOCK:
            self._end_line()
        elif tag == "br":
            self._text.append(" ")
        if tag in VOID:
            return
        if tag in BLOCK:
            self._close("p")  # a paragraph ends where the next block begins
        if tag == "p":
            if self._forms and not self._out:
                self._forms[-1].has_paragraph = True
            if not attrs:
                return  # nothing hangs on where it ends
        out = tag in OUTSIDE or tag == "header" and not self._content
        if not out and attrs and tag not in ("html", "body"):
            # Names leave out an article only inside another one or a block left out, as a reader's comment.
            named = tag not in CONTENT or self._content or self._out
            out = _hidden(attrs) or bool(named) and _beside(attrs, self._content > 0)
        if tag in CONTENT and not out and self._out and not self._hard:
            # An article that starts while a marked block is still open: that block was never closed.
            self._leave(self._outs[0])
        if tag == "p" and not out:
            return
        self._places.setdefault(tag, []).append(len(self._open))
        if tag in BLOCK:
            self._blocks.append(len(self._open))
            self._region += out
        if out:
            self._outs.append(len(self._open))
        self._open.append((tag, out))
        self._out += out
        self._hard += out and tag in OUTSIDE
        if tag in CONTENT and not self._out:
            self._content += 1
            for form in self._forms:
                form.holds_article = True
        if tag in PART:
            self._made += 1
            self._parts.append(self._made)
        if tag == "form":
            self._forms.append(Form())
            self._region += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self._open and self._open[-1][0] == tag:
            self._leave(len(self._open) - 1)

    def handle_endtag(self, tag):
        self._tags += 1
        if tag in BLOCK:
            self._end_line()
        self._close(tag)

    def _close(self, tag: str) -> None:
        """Leave the innermost element of this name; an inline one only within its block."""
        places = self._places.get(tag)
        if places and (tag in BLOCK or not self._blocks or places[-1] > self._blocks[-1]):
            self._leave(places[-1])

    def _leave(self, k: int) -> None:
        """Close the k-th open element and all inside it."""
        if self._blocks and self._blocks[-1] >= k:
            self._end_line()
        while len(self._open) > k:
            tag, out = self._open.pop()
            self._places[tag].pop()
            self._content -= tag in CONTENT and not self._out
            self._out -= out
            self._hard -= out and tag in OUTSIDE
            if out:
                self._outs.pop()
            if tag in BLOCK:
                self._blocks.pop()
                self._region += out
            if tag in PART:
                self._parts.pop()
            if tag == "form":
                self._forms.pop()
                self._region += 1

    def handle_data(self, data):
        if not self._out:
            self._text.append(data)

    def parse_html_declaration(self, i):
        """The place after a comment or any other declaration, -1 if it doesn't end."""
        if self.rawdata.startswith("<!--", i):
            return self.parse_comment(i)
        end = "]]>" if self.rawdata.startswith("<![CDATA[", i) else ">"
        at = self.rawdata.find(end, i + 2)
        return at + len(end) if at >= 0 else -1

    def close(self):
        if re.match("<(?:[a-zA-Z/!?]|$)", self.rawdata):
            self.rawdata = ""  # the page ends in a tag or comment
        super().close()
        self._end_line()


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """A Gaussian of this width over the lines; at the ends it weighs only the lines there are."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    inside = slice(reach, reach + len(ratios))
    return np.convolve(ratios, kernel)[inside] / np.convolve(np.ones(len(ratios)), kernel)[inside]


def main_text(html: str, sigma: float = 1.0, share: float = 0.5) -> str:
    """The page's main text: blocks in page order, joined by two line ends."""
    parser = Lines()
    parser.feed(html)
    parser.close()
    total = sum(len(line.text) for line in parser.lines)
    lines = [line for line in parser.lines if all(_wraps(form, total) for form in line.forms)]
    if any(line.content for line in lines):
        return "\n\n".join(line.text for line in lines if line.content)
    if not lines:
        return ""
    ratios = smoothed(np.array([len(line.text) / max(1, line.tags) for line in lines]), sigma)
    limit = min(share * ratios.std(), ratios.max())
    stays = {(line.region, line.part) for line, ratio in zip(lines, ratios) if ratio >= limit}
    return "\n\n".join(line.text for line in lines if (line.region, line.part) in stays)


def _wraps(form: Form, total: int) -> bool:
    """Whether a form is no form to fill in, but holds the page."""
    return form.holds_article or form.has_paragraph and 2 * form.chars > total


def extract(pages: DataFrame, sigma: float = 1.0, share: float = 0.5) -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points)."""

    def run(batches):
        for batch in slices(batches):
            texts = [main_text(html or "", sigma, share) for html in batch.column("html").to_pylist()]
            counts = pa.array([len(text) for text in texts], pa.int64())
            kept = [batch.column("page_id"), batch.column("url")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), counts], ["page_id", "url", "text", "n_chars"])

    types = dict(pages.dtypes)
    schema = f"page_id {types['page_id']}, url {types['url']}, text string, n_chars bigint"
    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
