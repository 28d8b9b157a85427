"""Main text of web pages from shallow block features and a decision tree.

A page becomes a flat list of text blocks. A block's features are its number of words and link density, those
of its neighbours, the kind of its own element, and marks of the elements around it; a decision tree, trained on the
small labelled table below, tells article text from the rest. Most labelled pages have no marks, as most pages of the
web don't name their parts, so the tree decides by words, links and neighbours first and uses marks where these leave a
doubt. Texts of script, style and other elements without prose never are blocks.

Null and empty pages have no text; pages cut off inside a tag, a comment, a script or another element of raw text end there. A quote in a tag opens a string only behind an
equals sign and only if it is closed, so stray apostrophes swallow nothing; buttons, selects, drawings and the like are left out up to their end tags, and those without an
end tag leave what follows as it is. Pages are
handled whole and one by one, so repeated rows and ties get equal texts and empty tables no rows. Only the id
and html columns are read, and those to be kept.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import sliced

#: Words from which on a block counts as long, whatever its number of words.
LONG = 15
#: Bytes of pages handled at a time inside a task.
SLICE_BYTES = 4 << 20
#: Fixed values of HTML: elements that part blocks, that hold no prose, that have no end.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SILENT = frozenset("script style noscript template iframe svg math canvas object select textarea button title head audio video datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPAQUE = frozenset("script style textarea title iframe noscript".split())
FURNITURE = frozenset("nav footer aside form dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
#: Words in class or id that tell of things around an article: prose that isn't the article's, and lists of links and controls.
FOREIGN = frozenset("ad ads advert adverts advertisement advertising adsense comment comments commentlist consent cookie cookies disclaimer disqus footer gdpr login masthead newsletter promo promotion sidebar signup sponsor sponsored subscribe subscription taboola".split())
CONTROLS = frozenset("breadcrumb breadcrumbs menu modal nav navbar navigation pager pagination popup recommended recommendations related replies reply respond share sharing skip social teaser toolbar topbar widget widgets".split())
#: Words that also name parts of articles: they tell only where all the words of a name are of these kinds.
COMMON = frozenset("alert banner dialog form notice search".split())
LAYOUT = frozenset("area bar block box button buttons container content group inner link links list main outer page panel section site top bottom wrap wrapper".split())
#: Elements whose text is silent up to their end tag; without one they say nothing of what follows.
CLOSED = SILENT - OPAQUE - {"head"}
#: The share of linked words under which a block counts as prose.
PROSE_LINKS = 0.2
_TAG = re.compile(r"<!--|<!\[CDATA\[|<[!?]|</?([a-zA-Z][^\s/>]*)")
# A quote opens a string only behind an equals sign, and only if it is closed.
_REST = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|["'=])*+>""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
_NAMES = re.compile(r"[a-z0-9]+")
FEATURES = ("words", "link_share", "words_before", "link_share_before", "words_after", "link_share_after", "heading", "paragraph", "item", "in_main", "page_has_main", "in_furniture", "hinted", "in_header")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    own: str  # the element whose text it is
    marks: tuple[bool, bool, bool, bool, bool]  # in main, in furniture, foreign, control, in header


def _hints(value: str) -> tuple[bool, bool]:
    """Whether a class or id tells of foreign prose, and of links and controls."""
    foreign = control = False
    for name in value.split():
        words = set(_NAMES.findall(name))
        foreign = foreign or not FOREIGN.isdisjoint(words)
        control = control or not CONTROLS.isdisjoint(words) or not COMMON.isdisjoint(words) and words <= COMMON | CONTROLS | LAYOUT
    return foreign, control


def _unclosed(page: str, name: str) -> set[int]:
    """Where the start tags of `name` stand that no end tag answers."""
    open_: list[int] = []
    for tag in re.finditer(rf"<(/?){name}(?=[\s/>])", page, re.I):
        if not tag[1]:
            open_.append(tag.start())
        elif open_:
            open_.pop()
    return set(open_)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    unclosed: dict[str, set[int]] = {}
    out: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    outside = (False,) * 6
    stack: list[tuple[str, bool, bool, bool, bool, bool, bool]] = []  # name, and marks that hold inside: main, furniture, foreign, control, header, silent
    state = outside
    links, at, end = 0, 0, len(page)

    def add(text: str) -> None:
        if text and not state[5]:
            parts.append(text)
            if links:
                linked.append(text)

    def flush() -> None:
        if parts:
            words = html.unescape("".join(parts)).split()
            if words:
                own = next((name for name, *_ in reversed(stack) if name in BLOCK), "body")
                out.append(Block(" ".join(words), len(words), len(html.unescape("".join(linked)).split()), own, state[:5]))
            parts.clear()
            linked.clear()

    while at < end:
        tag = _TAG.search(page, at)
        if not tag:
            add(page[at:])
            break
        add(page[at : tag.start()])
        mark = tag[0]
        if mark in ("<!--", "<![CDATA["):
            close = page.find("-->" if mark == "<!--" else "]]>", tag.end())
            if close < 0:
                break
            if mark != "<!--":
                add(html.escape(page[tag.end() : close]))
            at = close + 3
            continue
        rest = _REST.match(page, tag.end())
        close = rest.end() if rest else page.find(">", tag.end()) + 1
        if not close:
            break
        at = close
        if tag[1] is None:
            continue
        name = tag[1].lower()
        if mark[1] == "/":
            if name in BLOCK:
                flush()
            if name == "a":
                links = max(0, links - 1)
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    state = stack[-1][1:] if stack else outside
                    break
            continue
        if name == "br":
            add(" ")
        if name in BLOCK:
            flush()
            links = 0
            if stack and stack[-1][0] == "head":  # a head without an end tag ends where the body begins
                stack.pop()
                state = stack[-1][1:] if stack else outside
        if name == "a":
            links = 1
        attributes = page[tag.end() : close - 1]
        if name in VOID or attributes.endswith("/") and name not in BLOCK:
            continue
        if name in OPAQUE:
            stop = re.compile(rf"</{name}\b", re.I).search(page, at)
            if not stop:
                break
            after = page.find(">", stop.end()) + 1
            if not after:
                break
            at = after
            continue
        quiet = name in SILENT
        if name in CLOSED:
            if name not in unclosed:
                unclosed[name] = _unclosed(page, name)
            quiet = tag.start() not in unclosed[name]
        if name in BLOCK or quiet or attributes:
            main, furniture, foreign, control, header, silent = state
            silent = silent or quiet
            furniture = furniture or name in FURNITURE
            header = header or name == "header"
            if name in ("article", "main"):
                main = True
            if attributes and name not in ("html", "body", "main", "article", "a"):
                for key, value in _ATTRIBUTE.findall(attributes):
                    key, value = key.lower(), value.strip("\"'").lower()
                    if key in ("class", "id"):
                        names = set(_NAMES.findall(value))
                        found = _hints(value)
                        foreign, control = foreign or found[0], control or found[1]
                        header = header or "header" in names
                        main = main or "articlebody" in names
                    elif key == "role":
                        furniture = furniture or value in ROLES
                        main = main or value in ("main", "article")
                    elif key == "style":
                        silent = silent or "display:none" in value.replace(" ", "")
                    elif key == "aria-hidden":
                        silent = silent or value == "true"
                    elif key == "itemprop":
                        main = main or value == "articlebody"
            new = (main, furniture, foreign, control, header, silent)
            if name in BLOCK or quiet or new != state:
                stack.append((name, *new))
                state = new
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    """FEATURES of each block."""
    if not found:
        return np.zeros((0, len(FEATURES)))
    number = np.array([b.words for b in found], float)
    share, words = np.array([b.linked for b in found]) / number, np.minimum(number, LONG)
    kinds = np.array([(b.own[0] == "h" and b.own[1:].isdigit(), b.own in ("p", "blockquote", "pre"), b.own in ("li", "dt", "dd", "td", "th")) for b in found], float)
    main, furniture, foreign, control, header = np.array([b.marks for b in found], float).T
    # Prose of some length inside an article is the article's, also where its element is named like a list of links.
    hinted = np.maximum(foreign, control * (1 - main * (number >= LONG) * (share < PROSE_LINKS)))
    shift = lambda x, k: np.concatenate([[0.0], x[:-1]]) if k < 0 else np.concatenate([x[1:], [0.0]])
    return np.column_stack([words, share, shift(words, -1), shift(share, -1), shift(words, 1), shift(share, 1), kinds, main, np.full(len(found), main.max()), furniture, hinted, header])


#: The labelled table: pages in which {+n} is a block of n words of article text and {-n} one of anything else.
LABELLED = """
<body><div><ul><li><a>{-1}</a></li><li><a>{-1}</a></li><li><a>{-2}</a></li></ul></div><div>{-8}</div><div><h1>{+9}</h1><p>{+10}</p><p>{+60}</p><p>{+5}</p><p>{+90}</p><p>{+1}</p></div><div>{-9}</div></body>
<body><div><ul><li><a>{-1}</a></li><li><a>{-3}</a></li></ul></div><div>{-12}</div><div><h1>{+4}</h1><p>{+5}</p><p>{+3}</p><p>{+140}</p></div><div>{-6}</div></body>
<body><ul><li><a>{-2}</a></li><li><a>{-1}</a></li></ul><div>{-4}</div><h1>{+12}</h1><p>{+300}</p><p>{+1}</p><p>{+48}</p><p>{+2}</p><p>{+94}</p><p>{+1}</p><p>{+11}</p><p>{+1}</p><div>{-14}</div></body>
<body><div><a>{-1}</a></div><div><a>{-1}</a></div><div>{-10}</div><div><h1>{+2}</h1><p>{+2}</p></div><div>{-5}</div></body>
<body><div><ul><li><a>{-1}</a></li></ul></div><div>{-3}</div><div><h1>{+7}</h1><p>{+7}</p><p>{+28}</p><ul><li>{+6}</li><li>{+11}</li><li>{+4}</li></ul><p>{+45}</p></div><div>{-18}</div></body>
<body><div><h1>{+6}</h1><p>{+33}</p><h2>{+3}</h2><p>{+51}</p><p>{+8}</p></div><div><p><a>{-3}</a></p><p><a>{-5}</a></p><p><a>{-4}</a></p></div><div>{-11}</div></body>
<body><ul><li><a>{-1}</a></li><li><a>{-2}</a></li><li><a>{-1}</a></li></ul><h1>{+8}</h1><p>{+21}</p><p>{+17}</p><h3>{-2}</h3><ul><li><a>{-6}</a></li><li><a>{-7}</a></li></ul><div>{-7}</div></body>
<body><div>{-6}</div><ul><li><a>{-1}</a></li></ul><div>{+70}</div><div>{+38}</div><div>{+110}</div><div>{-8}</div><div><a>{-2}</a></div></body>
<body><table><tr><td><a>{-1}</a></td><td><a>{-2}</a></td></tr></table><h1>{+5}</h1><p>{+40}</p><table><tr><td>{+2}</td><td>{+3}</td></tr></table><p>{+66}</p><div>{-4}</div></body>
<body><div>{-9}</div><div><h1>{+10}</h1><p>{+1}</p><p>{+1}</p><p>{+3}</p></div><div>{-12}</div></body>
<body><div><ul><li><a>{-1}</a></li><li><a>{-1}</a></li></ul></div><div>{-7}</div><div><p>{+44}</p><p>{+1}</p><p>{+12}</p><p>{+230}</p><p>{+1}</p><p>{+3}</p><p>{+60}</p><p>{+1}</p><p>{+160}</p><p>{+9}</p></div><div>{-10}</div></body>
<body><div><ul><li><a>{-1}</a></li><li><a>{-1}</a></li></ul></div><div>{-11}</div><div><h1>{+11}</h1></div><div>{-7}</div></body>
<body><nav><a>{-1}</a><a>{-1}</a></nav><article><h1>{+4}</h1><p>{+12}</p><p>{+3}</p></article></body>
<body><article><p>{+3}</p><p>{+3}</p><p>{+3}</p></article></body>
<body><div class=ad>{-6}</div><main><h1>{+9}</h1><p>{+52}</p><p>{+7}</p></main></body>
<body><p><a>{-2}</a> <a>{-1}</a> <a>{-2}</a></p><h1>{+6}</h1><p>{+24}</p><p><a>{+3}</a></p><p>{+35}</p><p><a>{-1}</a> <a>{-2}</a></p><div>{-13}</div></body>
<body><nav><ul><li><a>{-1}</a></li><li><a>{-2}</a></li></ul></nav><div class=ad>{-9}</div><article><h1>{+8}</h1><p>{+60}</p><p>{+2}</p><p>{+35}</p></article><footer>{-12}</footer></body>
<body><header><a>{-3}</a><p>{-14}</p></header><main><h1>{+6}</h1><p>{+3}</p><p>{+80}</p><ul><li>{+7}</li><li>{+5}</li></ul><blockquote>{+18}</blockquote></main><aside><h3>{-2}</h3><p>{-40}</p></aside></body>
<body><div class=cookie-notice><p>{-25}</p></div><article><header><h1>{+9}</h1></header><p>{+4}</p><p><a>{+6}</a></p><div class=related><a>{-7}</a><a>{-8}</a></div><p>{+50}</p><div id=comments><p>{-30}</p><p>{-3}</p></div></article><footer><p>{-40}</p></footer></body>
<body><div id=menu><a>{-1}</a><a>{-1}</a></div><div><h1>{+7}</h1><p>{+70}</p><p>{+40}</p><p>{+12}</p><p>{+55}</p></div><div id=sidebar><p>{-22}</p></div><div class=footer>{-15}</div></body>
<body><div><a>{-2}</a> <a>{-3}</a></div><div>{+90}</div><div>{+45}</div><div>{+30}</div><div><a>{-4}</a></div><div>{-3}</div></body>
<body><div><a>{-1}</a></div><div><a>{-2}</a></div><h2>{+5}</h2><p>{+28}</p><p>{+64}</p><div><a>{-6}</a></div><div><a>{-3}</a></div></body>
<body><form><p>{-20}</p><label>{-3}</label></form><article><p>{+22}</p><form><p>{-16}</p></form><p>{+1}</p><h2>{+3}</h2><p>{+33}</p><p>{+90}</p></article><section class=newsletter><p>{-35}</p></section></body>
<body><section><p>{-50}</p></section><article><h1>{+4}</h1><p>{+20}</p><p>{+20}</p></article><section><p>{-60}</p><p>{-2}</p></section></body>
<body><div role=banner><p>{-10}</p></div><p>{+40}</p><p>{+25}</p><div class=share><p>{-5}</p></div><p>{+48}</p><div role=contentinfo><p>{-45}</p></div></body>
<body><div class=header><h1>{-3}</h1><p>{-11}</p></div><article><div class=entry-header><h1>{+10}</h1></div><p>{+15}</p><p>{+70}</p></article><aside class=promo><p>{-18}</p></aside></body>
<body><article><p>{+1}</p><p>{+2}</p><p>{+1}</p><p>{+3}</p><aside><p>{-55}</p></aside><p>{+2}</p></article><div><p>{-70}</p><p>{-65}</p></div></body>
<body><article><h1>{+5}</h1><p><a>{+3}</a></p><p>{+120}</p><nav><a>{-2}</a></nav><div class=comment><p>{-75}</p></div></article><div><h2>{-4}</h2><p>{-30}</p></div></body>
<body><header><p>{-30}</p><p>{-28}</p></header><nav><p>{-40}</p></nav><div class=ad><p>{-60}</p></div><div><p>{+60}</p><p>{+30}</p></div><div class=comments><p>{-50}</p><p>{-33}</p><p>{-60}</p></div><footer><p>{-60}</p><p>{-31}</p></footer></body>
<body><div class=topbar><p>{-26}</p><p>{-44}</p></div><h1>{+6}</h1><p>{+41}</p><p>{+9}</p><p>{+52}</p><aside><p>{-58}</p><p>{-62}</p></aside><p>{+47}</p><form><p>{-29}</p><p>{-34}</p></form></body>
<body><div><a>{-40}</a></div><p>{+40}</p><p>{+33}</p><div><a>{-30}</a></div><p>{+64}</p><p>{+27}</p><div><a>{-26}</a></div></body>
"""


@dataclass
class Tree:
    """Splits in preorder: feature (-1: leaf), threshold, left and right child, share of article blocks."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while True:
            inner = self.feature[node] >= 0
            if not inner.any():
                return self.share[node]
            f = np.maximum(self.feature[node], 0)
            low = x[np.arange(len(x)), f] <= self.threshold[node]
            node = np.where(inner, np.where(low, self.left[node], self.right[node]), node)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 1) -> Tree:
    """A classification tree by Gini impurity; of equal splits the first feature and lowest threshold win."""
    nodes: list[list] = []

    def build(rows: np.ndarray, level: int) -> int:
        me, label = len(nodes), y[rows]
        nodes.append([-1, 0.0, 0, 0, float(label.mean())])
        if level == depth or label.min() == label.max():
            return me
        best = None
        for f in range(x.shape[1]):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            value, ones, n = x[order, f], np.cumsum(y[order]), np.arange(1, len(order) + 1)
            cut = np.flatnonzero(value[1:] > value[:-1])
            cut = cut[(cut + 1 >= least) & (len(order) - cut - 1 >= least)]
            if not len(cut):
                continue
            a, b, total = n[cut], ones[cut], ones[-1]
            c, d = len(order) - a, total - b
            impurity = 2 * b * (1 - b / a) + 2 * d * (1 - d / c)
            k = int(impurity.argmin())
            if best is None or impurity[k] < best[0] - 1e-12:
                best = (float(impurity[k]), f, float(value[cut[k]] + value[cut[k] + 1]) / 2)
        if best is None:
            return me
        low = x[rows, best[1]] <= best[2]
        nodes[me][:2] = best[1:]
        nodes[me][2] = build(rows[low], level + 1)
        nodes[me][3] = build(rows[~low], level + 1)
        return me

    build(np.arange(len(x)), 0)
    cols = list(zip(*nodes, strict=True))
    return Tree(np.array(cols[0], np.int64), np.array(cols[1]), np.array(cols[2], np.int64), np.array(cols[3], np.int64), np.array(cols[4]))


def labelled_table(text: str = LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the labelled pages."""
    xs, ys = [], []
    for page in text.strip().splitlines():
        found = blocks(re.sub(r"\{([+-])(\d+)\}", lambda m: " ".join([{"+": "yes", "-": "no"}[m[1]]] * int(m[2])), page))
        xs.append(features(found))
        ys += [int(b.text.startswith("yes")) for b in found]
    return np.concatenate(xs), np.array(ys)


def train() -> Tree:
    return grow(*labelled_table())


def main_text(page: str | None, tree: Tree) -> str:
    """The article blocks of a page, joined by empty lines."""
    found = blocks(page or "")
    if not found:
        return ""
    keep = tree.predict(features(found)) >= 0.5
    return "\n\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = (), tree: Tree | None = None) -> DataFrame:
    """id_col, text (never null) and the columns `keep` of every page."""
    tree = tree or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, pages in sliced(batch.column(1), SLICE_BYTES):
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([main_text(p, tree) for p in pages], pa.string()), *part.columns[2:]], names=names)

    names = ["id", "text", *(f"extra_{k}" for k in range(len(keep)))]
    kinds = [df.schema[id_col].dataType.simpleString(), "string", *(df.schema[c].dataType.simpleString() for c in keep)]
    source = df.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"), *(F.col(c).alias(f"extra_{k}") for k, c in enumerate(keep)))
    out = source.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    return out.withColumnsRenamed({"id": id_col} | {f"extra_{k}": c for k, c in enumerate(keep)})
