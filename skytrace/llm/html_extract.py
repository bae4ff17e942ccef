"""Main text of web pages by two-pass block rules.

Pages are cut into blocks at block-level tags. The first pass decides a block by its length, the
share of its characters in links, and its density of stop words. What these leave open, short blocks above all, gets the
label of the nearest decided blocks before and after it in the second pass. Both passes judge all blocks, wherever they stand. An article or main
element is a prior: its blocks need less to be good, look for neighbours within it first, and are good if nothing there is decided; blocks outside of it look for neighbours outside.

Elements that never hold main text (page footers, forms, scripts, ...) and elements that their class or id names as adverts, notices, comments and the like
are left out before.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .words import slices

#: A tag; quotes open a value after ``=`` only.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=(?!\s*[\"'])|=\s*\"[^\"]*\"|=\s*'[^']*')*+)>")
ATTRIBUTE = re.compile(r"([^\s/=>\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
#: What they hold is no markup, up to their end tag.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
#: Their content is never main text.
ASIDE = frozenset(
    "head nav footer aside form menu dialog select button fieldset label search noscript template object embed svg math canvas audio video map".split()
)
#: What may stand in a head; anything else ends it.
HEAD = frozenset("head title meta link base script style noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an open element of the same kind.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEMS = frozenset("li dd dt td th".split())
MAIN = frozenset(["article", "main"])
#: Elements whose names inside main text may tell that they hold none.
CONTAINERS = frozenset("div section ul ol dl table article ins p figure".split())
#: Words in class, id or role that name boilerplate around the main text.
UNWANTED = re.compile(
    r"(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu\w*|breadcrumbs?|sidebar\w*|widgets?|footer|masthead|site-?header|page-?header|topbar|toolbar|cookie\w*|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscri\w+|signup|login|share|sharing|social|related|recommend\w*|comments?|disqus|replies|reply|responses?|pagination|pager|tagcloud|copyright|disclaimer|search|contentinfo|complementary|dialog)",
    re.I,
)
#: Parts of names that mean the same inside the main text, whatever stands beside them, and parts that do so alone or beside a word for a place.
CERTAIN = re.compile(r"ads?|advert\w*|adsense|sponsor\w*|promo|cookies?|consent|gdpr|notices?|popup|newsletter|subscri(?:be|ption)|signup|comments?|disqus", re.I)
LIKELY = re.compile(r"share|sharing|social|related|sidebar|replies|respond|responses?|recommend\w*|pagination|pager|breadcrumbs?|toolbar|disclaimer", re.I)
PLACES = re.compile(r"list|box|bar|links?|buttons?|posts?|articles?|section|widget|area|wrapper|container|block|thread|content|body|items?|banner|nav", re.I)
COMMENTS = re.compile(r"comments?|disqus|replies|respond", re.I)
WITHOUT = frozenset("has no with without".split())
#: Frequent words of languages, a line a language: English, Spanish, French, German, Italian, Portuguese, Dutch, Swedish, Polish, Turkish, Russian.
STOP_WORDS = frozenset(
    """
    a an and are as at by for from he in is it of on or that the this to was with you
    con de del el en es la las lo los no para por que se su una y
    au aux avec dans des du elle est et il les par pas pour qui sur un une à
    das dem den der die ein eine ist mit nicht sich sie und von zu auch auf im
    che di e i il le nel non per si sono
    as com da do em não o os um uma
    dat een en het is niet op te van voor
    att det en för med och som är
    do i jest na nie się to w z że
    bir bu da de için ile ve
    в и из к как на не но он по с что это я
    """.split()
)
WORD = re.compile(r"[^\W\d_]+")
SPACES = re.compile(r"\s+")


class Block:
    __slots__ = ("text", "links", "n_links", "main", "item", "heading", "kind", "holder", "label", "by")

    def __init__(self, text: str, links: int, n_links: int, main: int, item: bool, heading: bool, kind: bool, holder: Element | None) -> None:
        self.text, self.links, self.n_links, self.main, self.item, self.heading, self.kind, self.holder = text, links, n_links, main, item, heading, kind, holder
        #: good, bad, near (good next to a good block) or short; and what decided it
        self.label = self.by = ""


class Element:
    """An open element: why it holds no main text (its kind, its name, nothing), and how much text it holds once it is closed."""

    __slots__ = ("name", "why", "chars")

    def __init__(self, name: str, why: str, before: int) -> None:
        self.name, self.why, self.chars = name, why, -before


def _why(name: str, attributes: str, in_main: bool) -> str:
    """Whether an element's tag or its own names say that it holds no main text."""
    if name in ASIDE or name == "header" and not in_main:
        return "kind"
    if not attributes or attributes.isspace() or name in ("html", "body"):
        return ""
    words: list[str] = []
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), next((g for g in m.groups()[1:] if g), "")
        if key == "hidden" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return "kind"
        if key in ("class", "id", "role"):
            words += value.split()
    found = ""
    for w in words:
        parts = [p for p in re.split(r"[-_]+", w) if p]
        if WITHOUT.intersection(p.lower() for p in parts):
            continue
        if name in CONTAINERS and any(map(COMMENTS.fullmatch, parts)) and all(CERTAIN.fullmatch(p) or PLACES.fullmatch(p) or COMMENTS.fullmatch(p) or p.lower() in ("user", "reader", "post") for p in parts):
            return "kind"
        if in_main:
            certain, likely = any(map(CERTAIN.fullmatch, parts)), any(map(LIKELY.fullmatch, parts))
            rest = all(CERTAIN.fullmatch(p) or LIKELY.fullmatch(p) or PLACES.fullmatch(p) for p in parts)
            if name in CONTAINERS and (certain or likely) and rest:
                return "kind"
            if name in CONTAINERS and certain:
                found = "name"
        elif name not in MAIN and any(UNWANTED.fullmatch(p) for p in [w, *parts]):
            found = "name"
    return found


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, with what their elements say about them. Time grows with the page's length."""
    out: list[Block] = []
    open_: list[Element] = []
    names: dict[str, int] = {}  # how many elements of a name are open
    mains: list[int] = []  # where main elements stand in open_
    named: list[tuple[int, Element]] = []  # open elements left out by name, and where they stand
    kinds = 0  # open elements left out by kind
    main_no = total = 0
    parts: list[str] = []
    links = n_links = in_link = 0
    broke = False

    def text(raw: str) -> None:
        nonlocal links, broke
        if raw:
            piece = html.unescape(raw) if "&" in raw else raw
            if size := len(piece.strip()):
                broke = False
                links += size * (in_link > 0)
            parts.append(piece)

    def flush() -> None:
        nonlocal links, n_links, broke, total
        if parts:
            content = SPACES.sub(" ", "".join(parts)).strip()
            if content:
                # of nested elements the innermost holds the least; names around a main element don't count in it
                holder = named[-1][1] if named and (not mains or named[-1][0] > mains[0]) else None
                total += len(content)
                inner = open_[-1].name if open_ else ""
                out.append(Block(content, min(links, len(content)), n_links, main_no if mains else 0, inner in ITEMS, any(e.name in HEADINGS for e in open_[-3:]), kinds > 0, holder))
            parts.clear()
        links, n_links, broke = 0, 0, False

    def enter(name: str, why: str) -> None:
        nonlocal kinds
        element = Element(name, why, total)
        names[name] = names.get(name, 0) + 1
        kinds += why == "kind"
        if why == "name":
            named.append((len(open_), element))
        open_.append(element)

    def leave(place: int) -> None:
        nonlocal kinds
        while len(open_) > place:
            element = open_.pop()
            element.chars += total
            names[element.name] -= 1
            kinds -= element.why == "kind"
        while mains and mains[-1] >= place:
            mains.pop()
        while named and named[-1][0] >= place:
            named.pop()

    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        text(page[at:lt])
        after = page[lt + 1 : lt + 2]
        if after in ("!", "?") or after == "/" and not page[lt + 2 : lt + 3].isalpha():
            if page.startswith("<!--", lt):
                end = lt + 4 if page.startswith((">", "->"), lt + 4) else page.find("-->", lt + 4)
                at = size if end < 0 else page.find(">", end) + 1
            else:
                end = page.find(">", lt)
                at = size if end < 0 else end + 1
            continue
        m = TAG.match(page, lt)
        if not m:
            if after == "/" or after.isalpha() and after.isascii():
                break  # a tag that never ends
            parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        name, closing = m[2].lower(), bool(m[1])
        if not closing and open_ and open_[-1].name == "head" and name not in HEAD:
            flush()
            leave(len(open_) - 1)
        if name in RAW and not closing:
            if name in BLOCK:
                flush()
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            if not end:
                break
            close = page.find(">", end.end())
            at = size if close < 0 else close + 1
            continue
        if name == "br":
            if broke:
                flush()
            else:
                parts.append("\n")
                broke = True
            continue
        if name == "a":
            in_link = 0 if closing else 1
            n_links += in_link
            continue
        edge = name in BLOCK or name in ASIDE
        if edge:
            flush()
            in_link = 0
        if name in VOID:
            continue
        if closing:
            if edge and names.get(name) or not edge and any(e.name == name for e in open_[-8:]):
                place = len(open_) - 1
                while open_[place].name != name:
                    place -= 1
                if not edge and any(e.why for e in open_[place:]):
                    flush()
                leave(place)
            continue
        if not edge:
            why = _why(name, m[3], bool(mains)) if m[3] else ""
            if why:
                flush()
                enter(name, why)
            continue
        if name in BLOCK and open_ and open_[-1].name == "p":
            leave(len(open_) - 1)
        if name in CLOSES:
            for i in range(len(open_) - 1, max(len(open_) - 4, -1), -1):
                if open_[i].name in CLOSES[name]:
                    leave(i)
                    break
                if open_[i].name in ("ul", "ol", "dl", "table"):
                    break
        enter(name, _why(name, m[3], bool(mains)))
        if name in MAIN and not kinds:
            if not mains:
                main_no += 1
            mains.append(len(open_) - 1)
    flush()
    leave(0)
    return out


def classify(
    found: list[Block], short: int = 70, long: int = 200, low: float = 0.15, high: float = 0.3, some_links: float = 0.2, most_links: float = 0.5, few_links: int = 2,
    stop_words: frozenset[str] = STOP_WORDS, inherit: bool = True,
) -> list[bool]:
    """Whether each block is main text: first by its own measures, then by its neighbours. ``by`` tells what decided it.

    Without ``inherit`` there is no second pass, and what the first leaves open is no main text.
    """
    chars = sum(len(b.text) for b in found)
    out = [b.kind or b.holder is not None and 2 * b.holder.chars <= chars for b in found]
    stops = []
    for b, without in zip(found, out, strict=True):
        words = WORD.findall(b.text.lower()) if not without and len(b.text) >= short else []
        stops.append((sum(w in stop_words for w in words), len(words)))
    hits, all_ = (sum(x[i] for x in stops) for i in (0, 1))
    fits = hits >= low / 2 * all_  # else the stop words are of other languages than the page
    for b, without, (own, words) in zip(found, out, stops, strict=True):
        size, linked, density = len(b.text), b.links / len(b.text), own / words if words else 0.0
        if without:
            b.label, b.by = "bad", "markup"
        elif linked > most_links and (b.item or not b.main or b.n_links > few_links):
            b.label, b.by = "bad", "links"
        elif linked > some_links and (not b.main or size >= short and fits and density < low):
            b.label, b.by = "bad", "links"
        elif size < short or linked > most_links:
            b.label, b.by = "short", "neighbours"
        elif not fits:
            b.label, b.by = ("good", "length") if size > long else ("near", "neighbours")
        elif density >= high and (size > long or b.main) or density >= low and size > long and b.main:
            b.label, b.by = "good", "density"
        elif density >= low or b.main:
            b.label, b.by = "near", "neighbours"
        else:
            b.label, b.by = "bad", "density"
    if inherit:
        _inherit(found, "near")
        _inherit(found, "short")
        _headings(found)
    return [b.label == "good" for b in found]


def _inherit(found: list[Block], kind: str) -> None:
    """Give blocks of a kind the label of the nearest decided blocks around them: of their own main element, if they have one, else of the page."""
    before, after = _neighbours(found), _neighbours(found[::-1])[::-1]
    new = []
    for b, x, y in zip(found, before, after, strict=True):
        if b.main:
            good = "good" in (x, y) or not (x or y)
        elif kind == "near":
            good = "good" in (x, y)
        else:
            good = x == y == "good" or b.heading and y == "good"
        new.append("good" if good else "bad")
    for b, label in zip(found, new, strict=True):
        if b.label == kind:
            b.label = label


def _neighbours(found: list[Block]) -> list[str]:
    """The label of the last decided block before each block: of the same main element; of any outside. What is left out of a main element doesn't count in it."""
    out, last = [], {}
    for b in found:
        out.append(last.get(b.main, ""))
        if b.label in ("good", "bad") and (b.by != "markup" or not b.main):
            last[b.main] = b.label
    return out


def _headings(found: list[Block]) -> None:
    """A heading over nothing but what is left out, as over a list of comments, goes with it."""
    good = without = False
    for i in range(len(found) - 1, -1, -1):
        b = found[i]
        if i + 1 == len(found) or found[i + 1].main != b.main:
            good = without = False
        if b.heading and b.label == "good":
            if without and not good:
                b.label, b.by = "bad", "neighbours"
            good = without = False
        else:
            good |= b.label == "good"
            without |= b.by == "markup"


def main_text(page: str | None) -> str:
    """The main text of one page: its good blocks, joined by line feeds; empty if there are none."""
    if not page:
        return ""
    found = blocks(page)
    return "\n".join(b.text for b, good in zip(found, classify(found), strict=True) if good)


def extract_main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Replace ``html_col`` by ``text``, the main text of each whole page, and ``n_chars``, its code points.

    Null and empty pages, and pages of boilerplate only, give an empty text; an empty table gives an empty one. Pages are taken one by
    one, so repeated rows give equal results and long pages nothing but themselves in memory;
    columns ``text`` and ``n_chars`` of the input are replaced.
    """
    new = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    schema = T.StructType([f for f in pages.schema if f.name not in (html_col, "text", "n_chars")] + new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, html_col):
            texts = [main_text(x) for x in batch.column(html_col).to_pylist()]
            add = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
            yield pa.RecordBatch.from_arrays([add[c] if c in add else batch.column(c) for c in schema.names], schema.names)

    return pages.mapInArrow(run, schema)
