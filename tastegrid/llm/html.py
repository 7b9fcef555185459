"""Main text of web pages by boosted trees over DOM nodes."""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.boosting import Trees, boost
from tastegrid.llm.frames import add_columns, bounded_sample

TRAIN_PAGES = 300
MADE_PAGES = 400
SEED = 8

# Fixed values of the HTML standard
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title noscript template iframe noembed noframes textarea xmp svg math".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strike "
    "strong sub sup time tt u var wbr br img rt rp link meta input source track area base embed param".split()
)
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
#: Which open element a start tag ends, and which elements bound the search.
CLOSES_SAME = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "body": ({"head"}, set()),
}

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_NAMES = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_PARTS = re.compile(r"[a-z]+")

#: Words of class, id, role and itemprop, by what they tell.
BOILER_GROUPS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs crumbs toc pagination pager skip tabs",
    "header": "header masthead topbar banner logo branding",
    "footer": "footer foot copyright legal colophon",
    "sidebar": "sidebar aside rail widget widgets related recommended popular trending tags tagcloud more secondary complementary",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay toast warning paywall disclaimer privacy",
    "advert": "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion promoted outbrain taboola dfp",
    "form": "form login signin signup subscribe subscription newsletter search contact register",
    "comment": "comment comments respond reply replies disqus discussion reviews reader",
    "share": "share sharing social facebook twitter follow like print email byline meta author",
}
CONTENT_WORDS = set("article articlebody content contents main post entry story body text page prose blog news copy".split())
_GROUPS = {word: place for place, words in enumerate(BOILER_GROUPS.values()) for word in words.split()}
BOILER_TAGS = set("nav aside footer header form button select dialog menu fieldset".split())
TAGS = "#text p div section article main h1 h2 h3 li ul ol td tr table blockquote pre body header footer nav aside form figure".split()


@dataclass
class Page:
    """Elements and text runs in page order; node 0 is the root."""

    tag: list[str] = field(default_factory=lambda: ["#root"])
    parent: list[int] = field(default_factory=lambda: [-1])
    names: list[str] = field(default_factory=lambda: [""])
    text: list[str] = field(default_factory=lambda: [""])
    linked: list[int] = field(default_factory=lambda: [0])

    def add(self, tag: str, parent: int, names: str = "", text: str = "", linked: int = 0) -> int:
        for column, value in ((self.tag, tag), (self.parent, parent), (self.names, names), (self.text, text), (self.linked, linked)):
            column.append(value)
        return len(self.tag) - 1


def parse(source: str) -> Page:
    """Read a page as browsers do in the common cases: end tags may be missing or stray."""
    page, stack, depth_of = Page(), [0], {0: 0}
    runs: list[str] = []
    linked, link_depth, at = 0, -1, 0

    def flush() -> None:
        nonlocal linked
        if runs:
            text = " ".join("".join(runs).split())
            if text:
                page.add("#text", stack[-1], "", text, min(linked, len(text)))
            runs.clear()
        linked = 0

    def pop_to(place: int) -> None:
        nonlocal link_depth
        flush()
        del stack[place:]
        if link_depth >= place:
            link_depth = -1

    def find(tags: set[str], bounds: set[str]) -> int:
        for place in range(len(stack) - 1, 0, -1):
            tag = page.tag[stack[place]]
            if tag in tags:
                return place
            if tag in bounds:
                return 0
        return 0

    def say(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = entities.unescape(piece) if "&" in piece else piece
            runs.append(piece)
            if link_depth >= 0:
                linked += len(piece.strip())

    while True:
        token = _TOKEN.search(source, at)
        if token is None:
            say(source[at:])
            break
        say(source[at : token.start()])
        at = token.end()
        closing, name = token.group(1), token.group(2) or token.group(4)
        if closing:
            closing = closing.lower()
            if closing == "a":
                link_depth = -1
            elif closing == "p" and not find({"p"}, set()):
                flush()
            elif closing not in INLINE:
                place = find({closing}, {"td", "th", "table"} if closing in ("p", "li") else set())
                if place:
                    pop_to(place)
        elif name:
            name = name.lower()
            attributes = token.group(3) or token.group(5) or ""
            if name in RAW:
                if not attributes.rstrip().endswith("/") or name not in ("svg", "math"):
                    end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(source, at)
                    at = end.end() if end else len(source)
            elif name == "a":
                link_depth = len(stack)
            elif name == "br":
                runs.append(" ")
            elif name not in INLINE:
                if name in CLOSES_P:
                    place = find({"p"}, {"td", "th", "table", "button", "caption"})
                    if place:
                        pop_to(place)
                if name in CLOSES_SAME:
                    tags, bounds = CLOSES_SAME[name]
                    place = find(tags, bounds)
                    while place:
                        pop_to(place)
                        place = find(tags, bounds) if name in ("tr", "tbody", "tfoot") else 0
                flush()
                words = " ".join(value.strip("\"'") for value in _NAMES.findall(attributes)) if attributes else ""
                node = page.add(name, stack[-1], words.lower())
                if name not in VOID and not (attributes.rstrip().endswith("/") and name not in CLOSES_P):
                    stack.append(node)
    flush()
    return page


_TAG_PLACE = {tag: place for place, tag in enumerate(TAGS)}
_LOCAL = 15
N_FEATURES = len(TAGS) + 2 * (len(BOILER_GROUPS) + 3) + _LOCAL


def features(page: Page) -> np.ndarray:
    """A row per node: tag, attribute words, those of ancestors, densities, depth, siblings."""
    count, groups = len(page.tag), len(BOILER_GROUPS)
    marks = np.zeros((count, groups + 3))
    above = np.zeros((count, groups + 3))
    tags = np.zeros((count, len(TAGS)))
    chars, links, marksum, blocks, depth = (np.zeros(count) for _ in range(5))
    nodes = np.ones(count)
    siblings: list[int] = [0] * count
    place_in: list[int] = [0] * count
    before = np.zeros(count)
    parent = page.parent
    done = 0
    for node in range(count):
        tag, up = page.tag[node], parent[node]
        where = _TAG_PLACE.get(tag)
        if where is not None:
            tags[node, where] = 1
        if page.names[node]:
            for word in _PARTS.findall(page.names[node]):
                if word in _GROUPS:
                    marks[node, _GROUPS[word]] = 1
                if word in CONTENT_WORDS:
                    marks[node, groups] = 1
        if tag in BOILER_TAGS:
            marks[node, groups + 1] = 1
        elif tag in ("article", "main"):
            marks[node, groups + 2] = 1
        if up >= 0:
            np.maximum(above[up], marks[up], out=above[node])
            depth[node] = depth[up] + 1
            place_in[node] = siblings[up]
            siblings[up] += 1
        if tag == "#text":
            text = page.text[node]
            chars[node], links[node], blocks[node] = len(text), page.linked[node], 1
            marksum[node] = sum(map(text.count, ".,!?;:"))
        before[node] = done
        done += chars[node]
    for node in range(count - 1, 0, -1):
        up = parent[node]
        chars[up] += chars[node]
        links[up] += links[node]
        marksum[up] += marksum[node]
        blocks[up] += blocks[node]
        nodes[up] += nodes[node]
    up = np.maximum(np.array(parent), 0)
    total, many = max(done, 1.0), np.array(siblings, float)
    size = np.maximum(chars, 1)
    last = np.zeros(count)
    recent: dict[int, float] = {}
    for node in range(1, count):
        last[node] = recent.get(parent[node], 0.0)
        recent[parent[node]] = chars[node]
    local = np.column_stack(
        [
            np.log1p(chars), links / size, marksum / size, chars / nodes, np.log1p(blocks), np.log1p(chars / np.maximum(blocks, 1)),
            depth, chars / total, before / total, np.log1p(many[up]), np.array(place_in) / np.maximum(many[up], 1),
            np.log1p(last), chars / np.maximum(chars[up], 1), links[up] / size[up], np.log1p(nodes),
        ]
    )
    return np.hstack([tags, marks, above, local])


def decode(page: Page, chances: np.ndarray) -> np.ndarray:
    """The likeliest choice of kept nodes in which no kept node has a dropped ancestor."""
    odds = np.log(np.clip(chances, 1e-6, 1 - 1e-6) / np.clip(1 - chances, 1e-6, 1 - 1e-6))
    gain = odds.copy()
    gain[0] = 0.0
    for node in range(len(gain) - 1, 0, -1):
        if gain[node] > 0:
            gain[page.parent[node]] += gain[node]
    kept = np.zeros(len(gain), bool)
    kept[0] = True
    for node in range(1, len(gain)):
        kept[node] = gain[node] > 0 and kept[page.parent[node]]
    return kept


def text_of(page: Page, kept: np.ndarray) -> str:
    return "\n".join(text for text, keep, tag in zip(page.text, kept, page.tag) if keep and tag == "#text")


def semantic_labels(page: Page) -> np.ndarray | None:
    """Which nodes hold main text by the page's own article or main element; None without one."""
    count, groups = len(page.tag), len(BOILER_GROUPS)
    state = [0] * count  # 1 inside the article, 2 inside something else
    for node in range(1, count):
        up, tag = state[page.parent[node]], page.tag[node]
        odd = tag in BOILER_TAGS - {"header"} or any(_GROUPS.get(word, groups) < groups for word in _PARTS.findall(page.names[node]))
        state[node] = 2 if up == 2 or (odd and tag not in ("article", "main")) else 1 if up == 1 or tag in ("article", "main") else 0
    if 1 not in state:
        return None
    return _upward(page, [page.tag[node] == "#text" and state[node] == 1 for node in range(count)])


def _upward(page: Page, holds: list[bool]) -> np.ndarray:
    for node in range(len(holds) - 1, 0, -1):
        if holds[node]:
            holds[page.parent[node]] = True
    return np.array(holds)


def made_page(draw: np.random.Generator) -> tuple[str, list[str]]:
    """A page of a random layout and the blocks of its main text."""

    def sentence(low: int, high: int) -> str:
        words = ["".join(draw.choice(list("aeioulnrstdm"), draw.integers(2, 9))) for _ in range(draw.integers(low, high))]
        return " ".join(words) + draw.choice([".", ".", "!", "?", ""])

    def para(low: int = 1, high: int = 6) -> str:
        return " ".join(sentence(4, 18) for _ in range(draw.integers(low, high)))

    def named(words: str) -> str:
        word = draw.choice(words.split())
        shape = draw.choice([f'class="{word}"', f'id="{word}"', f'class="c{draw.integers(9)} {word}-box"', f'class="{word}_{draw.integers(99)}"'])
        return " " + shape

    def list_of(low: int, high: int) -> str:
        return "<ul>" + "".join(f'<li><a href="#">{sentence(1, 4)}</a></li>' for _ in range(draw.integers(low, high))) + "</ul>"

    def junk() -> str:
        kind = draw.choice(list(BOILER_GROUPS))
        tag = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}.get(kind, "div")
        label = named(BOILER_GROUPS[kind])
        if draw.random() < 0.5 and tag != "div":
            label = ""
        elif draw.random() < 0.7:
            tag = draw.choice(["div", "section"]) if tag != "form" else tag
        if kind == "comment":
            body = "".join(f"<div><p>{para(1, 4)}</p></div>" for _ in range(draw.integers(1, 6)))
        elif kind in ("menu", "sidebar", "share"):
            body = list_of(2, 9) if draw.random() < 0.7 else f"<p>{sentence(2, 9)}</p>" + list_of(1, 4)
        elif kind == "form":
            body = f"<label>{sentence(1, 4)}</label><input name='q'><button>{sentence(1, 3)}</button>"
        else:
            body = f"<p>{para(1, 3)}</p>" if draw.random() < 0.6 else sentence(2, 12)
        return f"<{tag}{label}>{body}</{tag}>"

    blocks: list[str] = []
    inside = ""
    if draw.random() < 0.8:
        blocks.append(sentence(3, 9))
        inside += f"<h1>{blocks[-1]}</h1>"
    for _ in range(draw.integers(1, 14)):
        roll = draw.random()
        if roll < 0.08:
            inside += junk()
            continue
        if roll < 0.18:
            items = [sentence(2, 10) for _ in range(draw.integers(2, 5))]
            blocks += items
            inside += "<ul>" + "".join(f"<li>{item}</li>" for item in items) + "</ul>"
            continue
        blocks.append(sentence(2, 7) if roll < 0.3 else para())
        tag = "h2" if roll < 0.3 else draw.choice(["p", "p", "p", "div", "blockquote"])
        first, _, rest = blocks[-1].partition(" ")
        text = blocks[-1] if draw.random() < 0.7 else f'<a href="#">{first}</a> {rest}'
        inside += f"<{tag}>{text}" + ("" if tag == "p" and draw.random() < 0.3 else f"</{tag}>")
    wrap = draw.choice(["article", "main", "div", "section", "named", "both", "plain"])
    if wrap == "named":
        inside = f"<div{named(' '.join(sorted(CONTENT_WORDS)))}>{inside}</div>"
    elif wrap == "both":
        inside = f"<main><div>{inside}</div></main>"
    elif wrap != "plain":
        inside = f"<{wrap}>{inside}</{wrap}>"
    head, tail = "".join(junk() for _ in range(draw.integers(0, 4))), "".join(junk() for _ in range(draw.integers(0, 4)))
    body = head + inside + tail
    if draw.random() < 0.4:
        body = f"<div{named('wrap wrapper container layout site outer')}>{body}</div>"
    return f"<html><head><title>x</title></head><body>{body}</body></html>", blocks


def made_labels(page: Page, blocks: list[str]) -> np.ndarray:
    """Which nodes hold the blocks of a made page."""
    wanted = {" ".join(block.split()) for block in blocks}
    return _upward(page, [tag == "#text" and text in wanted for tag, text in zip(page.tag, page.text)])


def train(pages: DataFrame, bound: int = TRAIN_PAGES, made: int = MADE_PAGES, seed: int = SEED) -> Trees:
    """Trees from `made` pages of random layouts and about `bound` real ones.

    Real pages with an article or main element teach by that element; others
    are left out. Both numbers bound what the driver holds.
    """
    rows: list[np.ndarray] = []
    labels: list[np.ndarray] = []
    draw = np.random.default_rng(seed)
    for _ in range(made):
        source, blocks = made_page(draw)
        page = parse(source)
        rows.append(features(page)[1:])
        labels.append(made_labels(page, blocks)[1:])
    sample = bounded_sample(pages.where(F.col("html").isNotNull()), F.col("page_id"), bound)
    for batch in _node_rows(sample):
        rows.append(batch[:, :-1])
        labels.append(batch[:, -1] > 0)
    return boost(np.vstack(rows), np.concatenate(labels).astype(float))


def _node_rows(sample: DataFrame) -> list[np.ndarray]:
    """Feature rows, label last, of at most 200 nodes drawn evenly from each sampled page."""

    def run(arrays: list[pa.Array]) -> dict[str, pa.Array]:
        made = []
        for source in arrays[0].to_pylist():
            page = parse(source)
            known = semantic_labels(page)
            if known is None or len(known) < 2:
                made.append(None)
                continue
            table = np.column_stack([features(page), known])[1:]
            made.append(table[:: -(-len(table) // 200)].ravel())
        return {"rows": pa.array(made, pa.list_(pa.float64()))}

    found = add_columns(sample.select("html"), ["html"], run, "rows array<double>").select("rows")
    return [np.array(row).reshape(-1, N_FEATURES + 1) for row in found.where("rows IS NOT NULL").toPandas()["rows"]]


def main_texts(sources: list[str | None], model: Trees) -> list[str]:
    """The main text of each page; null pages count as empty."""
    pages = [parse(source or "") for source in sources]
    tables = [features(page) for page in pages]
    chances = model.chances(np.vstack(tables))
    ends = np.cumsum([len(table) for table in tables])
    return [text_of(page, decode(page, own)) for page, own in zip(pages, np.split(chances, ends[:-1]))]


def extract(pages: DataFrame, model: Trees) -> DataFrame:
    """`pages` with text and n_chars (code points); empty text for pages without any.

    Blocks are the text runs of block elements, with character references
    decoded and white space turned into single spaces, one per line. Columns
    text and n_chars of `pages` are replaced.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(arrays: list[pa.Array]) -> dict[str, pa.Array]:
        texts = main_texts(arrays[0].to_pylist(), shared.value)
        clean = [text.encode("utf-8", "replace").decode() for text in texts]
        return {"text": pa.array(clean, pa.string()), "n_chars": pa.array([len(text) for text in clean], pa.int64())}

    return add_columns(pages, ["html"], run, "text string, n_chars long")
