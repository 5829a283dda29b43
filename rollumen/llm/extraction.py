"""Main text of web pages: a linear-chain conditional random field over a page's leaf blocks.

A page is read as browsers do, as far as blocks need it: raw text of scripts and styles, comments, implied and missing end tags, unquoted and
unclosed attributes. A leaf block is text between two bounds of block elements. Its features are the tags, classes, ids and roles of
its ancestors, and its text: length, share of links, marks, its neighbours' lengths. The field is fitted on labelled pages, which
are pages in which an attribute marks the elements of the main text (layouts.py renders some around a corpus's texts), and Viterbi's
path of a whole page says which blocks stay.

A null page counts as empty; a page without a main block gives the empty text. Pages of any length are read whole, in time
linear in their length. Repeated pages are read as often as they are there; there are no ties to break, as each page stands alone. Other columns
are not read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollumen.llm import crf

# Elements of HTML by how they are laid out.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
UNSEEN = frozenset("script style title textarea noscript template iframe object svg select button datalist video audio canvas map".split())
#: What a start tag ends when it stands open.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "tbody", "thead"}}
#: Elements that say what their content is for, as a class does.
PARTS = frozenset("article aside dialog figure footer form header main nav search section".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_REST = re.compile(r"[^>\"']*+(?:(?<==)\"[^\"]*+\"[^>\"']*+|(?<==)'[^']*+'[^>\"']*+|[\"'][^>\"']*+)*+>")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))|([a-zA-Z][^\s=\"'/>]*)")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CLOSERS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in UNSEEN}
#: Elements deep in others of many different classes pass on the features of the outermost.
INHERITED = 400
#: A page on which so many tags had to be mended is read to the next `>` only.
MENDED = 50


class Block:
    __slots__ = ("text", "keys", "tag", "linked", "label")

    def __init__(self, text: str, keys: frozenset, tag: str, linked: float, label: bool) -> None:
        self.text, self.keys, self.tag, self.linked, self.label = text, keys, tag, linked, label


def _keys(tag: str, attributes: str, mark: str | None) -> tuple[set[str], bool]:
    """Features of an element, and whether it is marked as main text."""
    out, near, marked = {f"in:{tag}"}, {f"near:{tag}"} if tag in PARTS else set(), False
    if "=" in attributes or "hidden" in attributes or mark:
        for name, a, b, c, alone in _ATTRIBUTE.findall(attributes):
            name, value = (name or alone).lower(), a or b or c
            if name in ("class", "id", "role", "itemprop"):
                for w in _WORDS.findall(value[:400]):
                    w = w.lower()
                    if len(w) > 1:
                        out.add(f"class:{w}")
                        near.add(f"near:{w}")
                        if len(w) > 4:
                            out.add(f"class4:{w[:4]}")
                if name == "role":
                    out.add(f"role:{value.lower()[:30]}")
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                out.add("hidden")
            elif name == mark:
                marked = True
    return out | near, marked


def _inside(keys: frozenset, own: set[str]) -> frozenset:
    """Features of an element's content; what is nearest takes the place of what was."""
    if own <= keys or len(keys) > INHERITED:
        return keys
    if any(k.startswith("near:") for k in own):
        keys = frozenset(k for k in keys if not k.startswith("near:"))
    return keys | own


def leaf_blocks(html: str, mark: str | None = None) -> list[Block]:
    """The leaf blocks of a page in order. `mark` names the attribute that labels main text."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset, bool]] = [("", frozenset(), False)]
    text: list[str] = []
    link, length, linked, mended, unclosed = False, 0, 0, 0, set()

    def flush() -> None:
        nonlocal length, linked
        if text:
            words = " ".join("".join(text).split())
            if words:
                tag, keys, label = stack[-1]
                out.append(Block(words, keys, tag, linked / max(1, length), label))
            text.clear()
        length = linked = 0

    def add(piece: str) -> None:
        nonlocal length, linked
        if piece:
            text.append(unescape(piece) if "&" in piece else piece)
            n = len(piece.strip())
            length += n
            linked += n if link else 0

    at, n = 0, len(html)
    while at < n:
        found = _OPEN.search(html, at)
        if found is None:
            add(html[at:])
            break
        add(html[at : found.start()])
        comment, odd, slash, tag = found.groups()
        at = found.end()
        if comment:
            end = html.find("-->", max(at - 2, 0))
            at = n if end < 0 else end + 3
            continue
        if odd:
            end = html.find(">", at)
            at = n if end < 0 else end + 1
            continue
        rest = _REST.match(html, at) if mended < MENDED else None
        if rest is None:
            mended += 1
            end = html.find(">", at)
            if end < 0:
                break  # an unfinished tag at the end of the page is no text
            attributes, at = html[at:end], end + 1
        else:
            attributes, at = html[at : rest.end() - 1], rest.end()
        tag = tag.lower()
        if slash:
            if tag == "a":
                link = False
            elif tag in BLOCKS:
                flush()
                for k in range(len(stack) - 1, max(0, len(stack) - 256), -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        link = False
                        break
            continue
        if tag in UNSEEN and not attributes.endswith("/"):
            if tag in ("title", "select", "textarea", "button", "video", "audio", "iframe", "object"):
                text.append(" ")
            closer = None if tag in unclosed else _CLOSERS[tag].search(html, at)
            if closer is not None:
                at = closer.end()
            elif tag in ("script", "style"):
                break
            else:
                unclosed.add(tag)  # an element that is never closed: what follows is read
            continue
        if tag == "a":
            link = True
        elif tag == "br":
            text.append(" ")
        elif tag in BLOCKS:
            flush()
            if stack[-1][0] == "p" or stack[-1][0] in HEADINGS and tag in HEADINGS:
                stack.pop()
                link = False
            ends = ENDS.get(tag)
            while ends and stack[-1][0] in ends:
                stack.pop()
            if tag not in VOID:
                own, marked = _keys(tag, attributes, mark)
                _, keys, label = stack[-1]
                stack.append((tag, _inside(keys, own), label or marked))
    flush()
    return out


# Marks of text that stands around articles.
_MARKS = {"copyright": "©", "bar": "|", "dot": "·", "raquo": "»", "arrow": "→", "at": "@", "ellipsis": "…", "bullet": "•", "star": "★"}
#: Words of notices, forms and footers; other words are left out, as a corpus's own would only be learnt by heart.
_TELLING = frozenset(
    "accept advertisement agree anzeige archive author blog buy categories comment comments contact contacto cookie cookies copyright datenschutz derechos dismiss droits email "
    "facebook follow footer home impressum imprint javascript kommentare kontakt latest legal like login menu more newsletter next offer partner password popular "
    "posts powered press previous print privacy promoted publicidad publicité read rechte recommended related reply report reserved sale save search share sign site "
    "sitemap skip sponsored subscribe tags terms trending tweet vorbehalten réservés reservados commentaires comentarios".split()
)
_SIZES = (1, 2, 4, 7, 12, 20, 35, 60, 100)
_STOPS = re.compile(r"[.!?…。！？]+[\"'”’»)]*(?:\s|$)")


def _size(words: int) -> int:
    return sum(words > s for s in _SIZES)


def own_features(block: Block) -> list[str]:
    """Features of a block's text."""
    words = block.text.count(" ") + 1
    stops = len(_STOPS.findall(block.text[-4000:] if len(block.text) > 8000 else block.text))
    out = [f"tag:{block.tag}", f"size:{_size(words)}", f"links:{min(4, int(block.linked * 4.999))}", f"stops:{min(3, stops)}"]
    out.append("ends" if stops and _STOPS.search(block.text[-6:]) else "open")
    if "," in block.text:
        out.append("comma")
    out += [f"mark:{name}" for name, mark in _MARKS.items() if mark in block.text]
    if sum(c.isdigit() for c in block.text[:200]) * 4 > min(200, len(block.text)):
        out.append("digits")
    if words <= 20:
        out += [f"word:{w}" for w in sorted(_TELLING & {w.strip(".,:;!?()[]»›").lower() for w in block.text.split()})]
    return out


def page_features(blocks: list[Block]) -> tuple[list[frozenset], list[list[str]]]:
    """For each block the features of its ancestors, which many blocks share, and its own."""
    seen = frozenset().union(*{b.keys for b in blocks}) if blocks else frozenset()
    outside = [t for t in ("article", "main") if f"in:{t}" in seen]
    own = [own_features(b) for b in blocks]
    sizes = [f[1] + ("L" if b.linked > 0.5 else "") for b, f in zip(blocks, own)]
    last = len(blocks) - 1
    for k, b in enumerate(blocks):
        own[k].append(f"before:{sizes[k - 1] if k else 'none'}")
        own[k].append(f"after:{sizes[k + 1] if k < last else 'none'}")
        own[k] += [f"outside:{t}" for t in outside if f"in:{t}" not in b.keys]
        own[k] += [f"{f}/{b.tag}" for f in own[k][1:3]]
    return [b.keys for b in blocks], own


def fit(pages: list[str], mark: str = "data-main") -> crf.Chain:
    """The field of labelled pages: in each the elements of the main text have the attribute `mark`."""
    sequences, labels = [], []
    for html in pages:
        blocks = leaf_blocks(html, mark)
        keys, own = page_features(blocks)
        sequences.append([[*a, *b] for a, b in zip(keys, own)])
        labels.append([int(b.label) for b in blocks])
    return crf.fit(sequences, labels)


class Extractor:
    """Main texts by a fitted field; sums of ancestors' weights are kept for as many different sets as `held`."""

    def __init__(self, chain: crf.Chain, held: int = 20_000) -> None:
        self.chain, self.held, self.sums = chain, held, {}

    def labels(self, blocks: list[Block]) -> list[int]:
        weights, scores = self.chain.weights, []
        for keys, own in zip(*page_features(blocks)):
            got = self.sums.get(keys)
            if got is None:
                if len(self.sums) >= self.held:
                    self.sums.clear()
                got = self.sums[keys] = sum(weights.get(f, 0.0) for f in sorted(keys))
            for f in own:
                got += weights.get(f, 0.0)
            scores.append(got)
        return self.chain.labels(scores)

    def text(self, html: str | None) -> str:
        blocks = leaf_blocks(html or "")
        return "\n".join(b.text for b, y in zip(blocks, self.labels(blocks)) if y)


def extracted(pages: DataFrame, chain: crf.Chain) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Extractor(chain)
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                texts = [tool.text(x.as_py()) for x in part.column(2)]
                lengths = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), lengths], ["page_id", "url", "text", "n_chars"])

    kept = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return kept.mapInArrow(run, f"page_id {kept.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
