"""Main text of web pages by inferred wrappers: union-free expressions over the pages of one host."""

from __future__ import annotations

import html as htmllib
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import TEXTS, cut, in_arrow, pieces, texts_of

#: Pages of a host from which on a text that is the same on all of them is part of the frame.
FIXED_PAGES = 5
#: Elements nested deeper have no term of their own: their text counts to the last one that has.
DEPTH = 200
#: Terms of pages that a task may hold before it hands them on.
HELD_TERMS = 100_000
#: Wrappers are broadcast up to so many bytes in all; beyond, pages and wrappers are joined by a shuffle.
BROADCAST_BYTES = 16_000_000

# Elements of HTML by what they mean for a page's text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
NOISE = frozenset("nav footer aside form head button select input canvas object dialog audio video map datalist optgroup option".split()) | RAW
FRAMES = frozenset("html body div section center table tbody tr td form span".split())
MAIN = frozenset(("article", "main"))
NOISE_ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar toolbar form".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot adsense sponsor sponsored sponsors promo promos promotion banner banners sidebar sidebars rail menu menus nav navigation navbar topnav subnav breadcrumb breadcrumbs "
    "cookie cookies consent gdpr notice notices popup popups modal overlay newsletter subscribe subscription signup login share sharing shares social related recommended recommendations comment comments commentlist respond disqus reply replies "
    "footer topbar widget widgets toolbar pagination pager skip hidden paywall feedback".split()
)
#: Content inside an article, where they name its own heading.
HEADER_WORDS = frozenset(("header", "masthead"))
#: Words beside those of noise that say nothing: a class of noise words and these is noise, one with any other word may be a topic.
FILLER_WORDS = frozenset(
    "area articles bar block bottom box button buttons card center cell col column container content embed first form foot group head holder icon icons inline inner item items last layer left link links list main message mobile module more "
    "outer page panel post posts primary right row secondary section site slot small space story stories sub text thread title top unit view wrap wrapper zone".split()
)
#: Alone, these words may name a topic too.
TOPIC_WORDS = frozenset("notice notices reply replies related social menu menus promotion feedback rail comment".split())
#: Levels of noise by attributes: none; sure; sure unless inside an article; inside an article only with evidence of the host's pages.
NONE, SURE, OUTSIDE, WEAK = range(4)
#: Share of an element's characters in links, and links, from which on it is a menu.
LINKED, LINKS = 0.8, 3
#: Which open elements a new one closes: (those, and where the search for them ends).
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
SCOPE = frozenset("div section article main td th li dd body html table blockquote aside nav header footer form figure details".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def host_of(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _level(value: str) -> int:
    """Noise of a class or id, by its words."""
    level = NONE
    for token in _CAMEL.sub("-", value).lower().split():
        words = _WORDS.findall(token)
        if NOISE_WORDS.isdisjoint(words):
            continue
        sure = all(w in NOISE_WORDS or w in FILLER_WORDS for w in words) and not (len(words) == 1 and words[0] in TOPIC_WORDS)
        if sure:
            return SURE
        level = WEAK
    return level


def _marks(tag: str, raw: str) -> tuple[str, int]:
    """The element's name in streams (tag, classes and id), and the level of noise that its attributes tell."""
    if not raw or raw.isspace():
        return tag, WEAK if tag in ("menu",) else NONE
    name, level, header = tag, WEAK if tag in ("menu",) else NONE, False
    for key, *values in _ATTRIBUTE.findall(raw):
        key, value = key.lower(), next((v for v in values if v), "")
        if key in ("class", "id"):
            words = _WORDS.findall(_CAMEL.sub(" ", value).lower())
            name += "." + ".".join(words) if key == "class" else "#" + "-".join(words)
            found = _level(value)
            level = found if found == SURE or level == NONE else level
            header |= not HEADER_WORDS.isdisjoint(words)
        elif key == "role":
            level = SURE if value.lower() in NOISE_ROLES else level
            name += "@main" if value.lower() == "main" else ""
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            level = SURE
    return name, level or (OUTSIDE if header else NONE)


def events(html: str) -> Iterator[tuple]:
    """The page as a stream: ("open", tag, name, noise), ("close", tag), ("text", characters), tags being closed as HTML implies."""
    stack: list[str] = []
    opened: Counter = Counter()  # open elements by tag, so that the stack is searched only for what it has
    at, size = 0, len(html)

    def close(down_to: int) -> Iterator[tuple]:
        while len(stack) > down_to:
            opened[stack[-1]] -= 1
            yield ("close", stack.pop())

    for m in iter(lambda: _TOKEN.search(html, at), None):
        if m.start() > at:
            yield ("text", html[at : m.start()])
        at = m.end()
        slash, tag, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if slash:
            if opened[tag]:
                k = len(stack) - 1
                while stack[k] != tag and (tag in BLOCK or stack[k] not in SCOPE):
                    k -= 1
                if stack[k] == tag:
                    yield from close(k)
            continue
        closes, until = CLOSES.get(tag, ({"p"}, SCOPE) if tag in BLOCK else (None, None))
        if closes and any(opened[c] for c in closes):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k] in closes:
                    yield from close(k)
                    if tag not in ("tr",):
                        break
                elif stack[k] in until:
                    break
        yield ("open", tag, *_marks(tag, raw))
        if tag in VOID or raw.endswith("/") and tag not in BLOCK and tag not in RAW:
            yield ("close", tag)
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
            stop = html.find(">", end.end()) + 1 if end else 0
            at = stop or size
            yield ("close", tag)
        else:
            stack.append(tag)
            opened[tag] += 1
    if at < size:
        yield ("text", html[at:])
    yield from close(0)


# ---- inference -------------------------------------------------------------------------------------


class Node:
    """A term of a wrapper: an element with a sequence of terms; any of them may be optional or repeated."""

    __slots__ = ("anchors", "chars", "children", "linked", "name", "noise", "optional", "pages", "repeated", "tag", "text")

    def __init__(self, tag: str, name: str, noise: int):
        self.tag, self.name, self.noise = tag, name, noise
        self.optional = self.repeated = False
        self.children: list[Node] = []
        self.text: str | None = ""  # the text outside of the children; None for a slot
        self.chars = self.linked = self.anchors = 0  # characters outside of the children, those of them in links, links
        self.pages = 1  # that hold the term


def tree(html: str) -> Node:
    """A page as a wrapper of its own, repeated siblings not yet folded."""
    root = Node("", "", NONE)
    stack, anchors = [root], 0
    for event in events(html):
        if event[0] == "text":
            if said := " ".join(event[1].split()):
                node = stack[-1]
                node.text = f"{node.text} {said}".strip()
                node.chars += len(said)
                node.linked += len(said) if anchors else 0
        elif event[0] == "open":
            node = stack[-1]
            if len(stack) <= DEPTH:
                node = Node(*event[1:])
                stack[-1].children.append(node)
            if event[1] == "a":
                anchors += 1
                node.anchors += 1
            stack.append(node)
        else:
            stack.pop()
            anchors -= event[1] == "a"
    return root


def fold(node: Node) -> Node:
    """Neighbouring terms of the same name become one repeated group; its members are aligned with each other."""
    out: list[Node] = []
    for child in node.children:
        fold(child)
        if out and out[-1].name == child.name:
            align(out[-1], child)
            out[-1].repeated = True
        else:
            out.append(child)
    node.children = out
    return node


def align(left: Node, right: Node) -> Node:
    """Generalise ``left`` so that it covers ``right`` too.

    Texts that differ become slots. Where the streams of terms mismatch, a term that goes on from the
    one before is a repetition of it; else the nearer place where the streams meet again decides which
    side's terms were optional.
    """
    if left.text != right.text:
        left.text = None
    left.chars, left.linked, left.anchors = left.chars + right.chars, left.linked + right.linked, left.anchors + right.anchors
    left.noise = SURE if SURE in (left.noise, right.noise) else max(left.noise, right.noise)
    left.repeated |= right.repeated
    left.optional |= right.optional
    out: list[Node] = []
    a, b, i, j = left.children, right.children, 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i].name == b[j].name:
            out.append(align(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j < len(b) and out and out[-1].name == b[j].name:
            out[-1] = align(out[-1], b[j])
            out[-1].repeated = True
            j += 1
        elif i < len(a) and out and out[-1].name == a[i].name:
            out[-1] = align(out[-1], a[i])
            out[-1].repeated = True
            i += 1
        else:
            to_b = next((k for k in range(j, len(b)) if i < len(a) and b[k].name == a[i].name), len(b) + len(a))
            to_a = next((k for k in range(i, len(a)) if j < len(b) and a[k].name == b[j].name), len(a) + len(b))
            if j < len(b) and (i >= len(a) or to_b - j <= to_a - i):
                term, j = b[j], j + 1
            else:
                term, i = a[i], i + 1
            term.optional = True
            out.append(term)
    left.children = out
    return left


#: Rank of a term's noise among pages that differ: what is noise everywhere outweighs what needs evidence, and this what is noise outside of an article.
RANKS = {NONE: 0, OUTSIDE: 1, WEAK: 2, SURE: 3}


def terms(page: str) -> dict[str, list]:
    """The folded page's terms by path: tag, rank of noise, characters, those in links, links, whether repeated, and the text's hash, None for a slot."""
    root = fold(tree(page))
    out: dict[str, list] = {}
    for path, node in [("", root), *_paths(root)]:
        term = out.get(path)
        if term is None:
            term = out[path] = [node.tag, 0, 0, 0, 0, node.repeated, []]
        else:  # terms between which others stand
            term[5] = True
        term[1] = max(term[1], RANKS[node.noise])
        term[2] += node.chars
        term[3] += node.linked
        term[4] += node.anchors
        term[6] = None if node.text is None or term[6] is None else [*term[6], node.text]
    for term in out.values():
        term[6] = None if term[6] is None else xxhash.xxh3_64_intdigest(json.dumps(term[6])) >> 1
    return out


def assemble(rows: list[tuple]) -> Node:
    """The wrapper of a host from its terms (path, tag, rank, characters, those in links, links, whether repeated, whether the text is one, pages) in the order of paths.

    A term that some of the pages with its parent lack is optional.
    """
    nodes: dict[str, Node] = {}
    for path, tag, rank, chars, linked, anchors, repeated, same, pages in rows:
        at = path.rfind(">")
        node = nodes[path] = Node(tag, path[at + 1 :], next(n for n, r in RANKS.items() if r == rank))
        node.chars, node.linked, node.anchors, node.repeated, node.text, node.pages = chars, linked, anchors, repeated, "" if same else None, pages
        if path:
            nodes[path[:at]].children.append(node)
            node.optional = pages < nodes[path[:at]].pages
    return nodes[""]


def expression(node: Node) -> str:
    """A wrapper as a union-free expression over token streams: #text is a slot, + repeats, ? is optional."""
    inner = ("#text" if node.text is None else "") + "".join(map(expression, node.children))
    if not node.name:
        return inner
    group = f"(<{node.name}>{inner}</{node.tag}>)"
    return group + ("*" if node.repeated and node.optional else "+" if node.repeated else "?" if node.optional else "")


def _paths(node: Node, path: str = "") -> Iterator[tuple[str, Node]]:
    for child in node.children:
        here = f"{path}>{child.name}"
        yield here, child
        yield from _paths(child, here)


def _is_noise(node: Node, inside: bool) -> bool:
    """Whether a term isn't content by its kind or attributes; a header inside the article may be its heading, and what may be a topic there stays."""
    if node.tag == "header":
        return not inside
    if node.tag in NOISE:
        return True
    return (node.noise == SURE or node.noise != NONE and not inside) and node.tag not in MAIN and node.tag not in ("html", "body") and not _heading(node.tag)


def _is_menu(node: Node) -> bool:
    """Whether nearly all characters of a term are in links, of which a page has several."""
    chars, linked, anchors = _sums(node)
    return anchors >= LINKS * node.pages and linked >= LINKED * chars > 0


def _is_evident(node: Node) -> bool:
    """Whether the host's pages tell that a term which may be a topic is none: all that have it say the same in it, or it is a menu."""
    return node.pages > 1 and not _slots(node) or _is_menu(node)


def _sums(node: Node) -> tuple[int, int, int]:
    found = [node.chars, node.linked, node.anchors]
    for child in node.children:
        found = [a + b for a, b in zip(found, _sums(child))]
    return found[0], found[1], found[2]


def _slots(node: Node) -> bool:
    return node.text is None or any(map(_slots, node.children))


def _holds_main(node: Node) -> bool:
    return any(c.tag in MAIN or c.name.endswith("@main") or _holds_main(c) for c in node.children)


def _size(node: Node) -> int:
    return node.chars + sum(map(_size, node.children))


def _heading(tag: str) -> bool:
    return len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()


def labels(wrapper: Node, pages: int) -> dict[str, int]:
    """Label the terms: 0 for noise by kind, attributes and, outside an article, by texts that are on all pages and the same there, or by being links.

    Inside an article, a term that its attributes call noise with a word that may be a topic is noise only
    if the host's pages tell so: all say the same in it, or it is links.

    The main text (1) is in the article or main elements. A wrapper without them takes the element at
    which the characters of slots part: from the root on, an element is entered while it has nearly all
    of them and no heading stands beside it. An element that looks like noise but has the article or
    most of the page in it is a frame (2) and only passed through.
    """
    out: dict[str, int] = {}
    weights: dict[str, int] = {}
    whole = _size(wrapper)

    def mark(node: Node, path: str, inside: bool) -> int:
        """Characters of slots below ``node`` that aren't noise."""
        chars = node.chars if node.text is None or node.pages < pages or pages < FIXED_PAGES or inside else 0
        for child in node.children:
            here = f"{path}>{child.name}"
            is_main = child.tag in MAIN or child.name.endswith("@main")
            if inside and child.noise == WEAK and _is_evident(child):
                out[here] = 0
                continue
            if not inside and child.tag not in FRAMES and not _holds_main(child) and _is_menu(child) and _sums(child)[0] < 0.5 * whole:
                out[here] = 0
                continue
            if _is_noise(child, inside):
                if not inside and (_holds_main(child) or child.tag not in NOISE and _size(child) > 0.6 * whole):
                    out[here] = 2
                else:
                    out[here] = 0
                    continue
            if is_main and not inside:
                out[here] = 1
            weights[here] = mark(child, here, inside or is_main)
            chars += weights[here]
        return chars

    total = mark(wrapper, "", False)
    if 1 in out.values() or not total:
        return out
    node, path = wrapper, ""
    while not any(_heading(c.tag) for c in node.children):
        entered = [c for c in node.children if c.tag in FRAMES and weights.get(f"{path}>{c.name}", 0) >= 0.9 * total]
        if not entered:
            break
        node, path = entered[0], f"{path}>{entered[0].name}"
    out[path] = 1
    if pages >= FIXED_PAGES:
        for here, below in _paths(node, path):
            if not weights.get(here, 1) and below.chars and not _heading(below.tag):
                out.setdefault(here, 0)
    return out


# ---- extraction ------------------------------------------------------------------------------------


def extract(html: str, wrapper: dict[str, int] | None = None) -> str:
    """The main text of a page by its host's wrapper: blocks in order, joined by line feeds.

    Elements whose path the wrapper knows take its label; others go by their own kind and attributes,
    inside their parent's label. A page in which nothing lies at the wrapper's places is read whole,
    less the noise.
    """
    stream = list(events(html))
    wrapper = wrapper or {}
    text = _walk(stream, wrapper)
    if text is None:
        text = _walk(stream, {p: n for p, n in wrapper.items() if n != 1} | {"": 1})
    return text or ""


def _walk(stream: list[tuple], wrapper: dict[str, int]) -> str | None:
    """None if no element of the page has label 1."""
    blocks: list[str] = []
    parts: list[str] = []
    found = "" in wrapper and wrapper[""] == 1
    stack: list[tuple[str, int, bool]] = [("", int(found), False)]  # path, label, inside an article

    def flush() -> None:
        if parts:
            if said := " ".join("".join(parts).split()):
                blocks.append(said)
            parts.clear()

    for event in stream:
        if event[0] == "text":
            if stack[-1][1] == 1:
                parts.append(htmllib.unescape(event[1]))
            continue
        if event[0] == "open":
            tag, name, noise = event[1:]
            path, label, inside = stack[-1]
            here = f"{path}>{name}" if len(stack) <= DEPTH else path
            is_main = tag in MAIN or name.endswith("@main")
            if label != -1:
                known = wrapper.get(here) if len(stack) <= DEPTH else None
                if known == 0 or known != 2 and _is_noise(Node(tag, name, noise), inside):
                    label = -1
                elif known == 1 or is_main:
                    label, found = 1, True
            stack.append((here, label, inside or is_main))
            if tag in BLOCK:
                flush()
            elif tag in ("br", "td", "th", "img"):
                parts.append(" ")
        else:
            stack.pop()
            if event[1] in BLOCK:
                flush()
            elif event[1] in ("td", "th"):
                parts.append(" ")
    flush()
    return "\n".join(blocks) if found and (blocks or wrapper.get("") == 1 or any(v == 1 for v in wrapper.values())) else None


def wrappers(pages: DataFrame) -> DataFrame:
    """``host, wrapper`` (labels of its terms as JSON), ``expression`` (the wrapper), inferred from all pages of each host.

    Since all pages are aligned, each page is covered by its host's expression.

    Each task hands on the terms of its pages, merged by host and path; these partial wrappers are
    merged by sums and extremes, whatever their order. So a host with a third of all pages brings as
    many rows from each task as it has paths to the one that labels it.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list] = {}  # tag, rank, characters, those in links, links, whether repeated, least and greatest hash, whether a slot, pages

        def flush() -> pa.RecordBatch:
            rows = [(*key, *term) for key, term in held.items()]
            held.clear()
            kinds = (
                pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(),
                pa.int64(),
            )
            names = ["host", "path", "tag", "rank", "chars", "linked", "anchors", "repeated", "lo", "hi", "slot", "pages"]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

        for batch in pieces(batches, TEXTS):
            for host, page in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                for path, (tag, rank, chars, linked, anchors, repeated, text) in terms(page).items():
                    slot, text = text is None, text or 0
                    if (t := held.get((host, path))) is None:
                        held[host, path] = [tag, rank, chars, linked, anchors, repeated, text, text, slot, 1]
                    else:
                        held[host, path] = [
                            min(t[0], tag), max(t[1], rank), t[2] + chars, t[3] + linked, t[4] + anchors, t[5] or repeated, min(t[6], text),
                            max(t[7], text), t[8] or slot, t[9] + 1,
                        ]
                if len(held) > HELD_TERMS:
                    yield flush()
        yield flush()

    def induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, rows = None, []
        for batch in batches:
            made: list[tuple[str, str, str]] = []
            for name, *term in zip(*(c.to_pylist() for c in batch.columns)):
                if name != host:
                    if rows:
                        made.append((host, *label(rows)))
                    host, rows = name, []
                rows.append(tuple(term))
            yield _hosts(made)
        yield _hosts([(host, *label(rows))] if rows else [])

    def label(rows: list[tuple]) -> tuple[str, str]:
        wrapper = assemble(rows)
        return json.dumps(labels(wrapper, wrapper.pages)), expression(wrapper)

    def _hosts(rows: list[tuple[str, str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["host", "wrapper", "expression"])

    some = pages.select("host", "html").transform(
        in_arrow, partial,
        "host string, path string, tag string, rank int, chars long, linked long, anchors long, repeated boolean, lo long, hi long, slot boolean, pages long",
    )
    whole = some.groupBy("host", "path").agg(
        F.min("tag").alias("tag"), F.max("rank").alias("rank"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.sum("anchors").alias("anchors"), F.max("repeated").alias("repeated"), (~F.max("slot") & (F.min("lo") == F.max("hi"))).alias("same"), F.sum("pages").alias("pages")
    )
    # a path sorts behind the paths that it begins with
    return whole.repartition("host").sortWithinPartitions("host", "path").transform(in_arrow, induce, "host string, wrapper string, expression string")


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``page_id, url, html``.

    ``text`` is the main text of the whole page, empty if there is none; ``n_chars`` its code points. A
    null or empty html gives an empty text, and pages whose url is null or has no host share a wrapper.
    Repeated rows are extracted each for itself; no pages give no rows; other columns are ignored.
    """
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    made = cut(wrappers(rows).drop("expression"))
    size = made.agg(F.coalesce(F.sum(F.length("host") + F.length("wrapper")), F.lit(0))).first()[0]
    joined = rows.join(F.broadcast(made) if size <= BROADCAST_BYTES else made, "host", "left").select("page_id", "url", "html", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict[str | None, dict[str, int]] = {None: {}}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = []
                for page, wrapper in zip(texts_of(part.column(2)), part.column(3).to_pylist()):
                    if wrapper not in parsed:
                        if len(parsed) > 1000:
                            parsed.clear()
                        parsed[wrapper] = json.loads(wrapper) if wrapper else {}
                    out.append(extract(page, parsed[wrapper]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    kinds = dict(pages.dtypes)
    return joined.transform(in_arrow, run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
