"""Items and anchors of a whole page in one pass over its tokens, for pages whose id no other page has.

The rules are those of ``tree`` and ``html``; what is computed there by grouping token rows is here
gathered page by page, so nothing of a page is shuffled.  Which element a token lies in follows from
the path of open elements alone, so paths are the states of an automaton that is built as tags are
met: a step that was taken before is one lookup, a new one applies the rules of ``tree``.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from html.entities import name2codepoint
from itertools import repeat

import numpy as np
import pyarrow as pa

from quire.operators.tree import BLOCK_LEVEL, BLOCK_TAGS, BOLD_TAGS, ENDS, FENCES, HEADINGS, ITALIC_TAGS, Tag, parse_code

# The patterns of ``html`` and ``text``, as Python reads them (ASCII, as Java does) ------
#: ``html.RAW_TEXT_RE`` with the first letters apart, which fails sooner.
RAW_TEXT = re.compile(r"(?s)<(?:[sS](?:(?i:cript)(?:\s[^>]*)?>.*?(?:</(?i:script)\s*>|\Z)|(?i:tyle)(?:\s[^>]*)?>.*?(?:</(?i:style)\s*>|\Z))"
                      r"|[nN](?i:oscript)(?:\s[^>]*)?>.*?(?:</(?i:noscript)\s*>|\Z)|!--.*?(?:-->|\Z))", re.A)
TOKEN = re.compile(r"(?s)<(?:/?[A-Za-z](?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+>|[!?][^>]*>)?|[^<]+", re.A)
#: What stands between "<" and the first ">" if the tag ends there for sure: every quote after "=" is closed.
PLAIN = re.compile(r"(?s)/?[A-Za-z](?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=(?!\s*+[\"']))*+|[!?].*", re.A)
NAME = re.compile(r"/?([A-Za-z][^ \t\n\r\f/>]*)")
ROOT_CLASS = re.compile(r"(?i)(content|entry|post|article|body)", re.A)
ENTITY = re.compile(r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")
ATTRS = {name: re.compile(r"(?i)\s" + name + r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.A) for name in ("class", "src", "alt", "href")}
HAS_HREF = re.compile(r"(?i)\shref(\s*=|[\s/>]|\Z)", re.A)
SEPARATOR = "<!---->"
NAMED = {**{k: chr(v) for k, v in name2codepoint.items()}, "apos": "'"}
STYLES = ["Normal", "Heading 3", "Heading 4", "List Number", "List Bullet"]
#: Of steps kept for a task; then all are forgotten.
MOST_STEPS = 200_000
# What a step asks for beside the next path
NOTHING, BLOCK, BLOCK_IN_BLOCK, LEAF_IN_BLOCK, BREAK, IMAGE, ANCHOR, ROOT, END, NO_TAG = range(10)


def _entity(m: re.Match) -> str:
    e = m[0]
    if e[1] != "#":
        return NAMED.get(e[1:-1], e)
    hexa = e[2] in "xX"
    digits = (e[3:-1] if hexa else e[2:-1]).lstrip("0")
    code = int(digits, 16 if hexa else 10) if 0 < len(digits) <= 7 else 0
    if code == 0xFEFF:                             # a byte order mark to the decoder
        return ""
    return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else "�"


def decoded(s: str) -> str:
    return ENTITY.sub(_entity, s) if "&" in s else s


def attr(tk: str, name: str) -> str:
    m = ATTRS[name].search(tk)
    return (m[1] or m[2] or m[3] or "") if m else ""


def code(tag: str) -> str:
    """As ``html._code``: a tag, given without its brackets, as ``tree.parse_code`` reads it; empty for declarations."""
    if tag[0] in "!?":
        return ""
    name = NAME.match(tag)[1].lower()
    if tag[0] == "/":
        return "/" + name
    marked = name == "div" and ROOT_CLASS.search(attr(tag, "class"))
    return name + ("/" if tag[-1] == "/" else "") + ("*" if marked else "")


class NotPlain(Exception):
    """Some "<" of the page does not open a tag, or its tag holds "<" or ">"."""


Pieces = Iterable[tuple[str | None, str, str]]


def plain_pieces(html: str) -> tuple[int, Pieces]:
    """The page cut at each "<" into ``(tag, ">", text behind it)``, and the number of tokens before the first.
    ``Paths.step`` finds out whether that is right for all of them."""
    first, *rest = html.split("<")
    return int(bool(first)), map(str.partition, rest, repeat(">"))


def exact_pieces(html: str) -> tuple[int, Pieces]:
    """The same by the pattern; a text that no tag stands before comes with no tag."""
    tokens = TOKEN.findall(html)
    return 0, [(tk[1:-1], ">", "") if len(tk) > 1 and tk[0] == "<" else (None, ">", tk) for tk in tokens]


#: A base URL that ``resolved`` takes: scheme, authority, path.
BASE = re.compile(r"([A-Za-z][A-Za-z0-9+.\-]*:(//[^/?#]*)?)([^?#]*)")
DOTS = re.compile(r"(?:^|/)\.\.?(?:/|\Z)")
NOT_PLAIN_HREF = re.compile(r"[?#:\n\r]|//")
ABSOLUTE = re.compile(r"https?:(//[^/?#\n\r]*)[^#\n\r]*")
SLASHES = re.compile("/{2,}")
NO_LINK = ("#", "javascript:", "mailto:")


def split_base(url: str | None) -> tuple[str, str, str] | None:
    """``(scheme and authority, authority, path)`` of a plain URL; None: leave it to ``urls.with_resolved_url``."""
    m = BASE.match(url) if url and url.isascii() and "\n" not in url and "\r" not in url else None
    return (m[1], m[2] or "", m[3]) if m else None


def resolved(base: tuple[str, str, str], href: str) -> str | None:
    """``urls.with_resolved_url`` for plain links: http(s) addresses and paths; None: it has to do it."""
    if not href or not href.isascii():
        return None
    if href.startswith(("http://", "https://")):
        return href if ABSOLUTE.fullmatch(href) else None
    if NOT_PLAIN_HREF.search(href):
        return None
    path = href if href[0] == "/" else SLASHES.sub("/", base[2][:base[2].rfind("/") + 1] + href)
    if DOTS.search(path):
        segments: list[str] = []
        parts = path.split("/")
        for x in parts:
            if x == "..":
                del segments[-1:]
            elif x != ".":
                segments.append(x)
        if parts[-1] in (".", ".."):
            segments.append("")
        path = "/".join(segments)
    return base[0] + (path if path.startswith("/") else "/" + path)


def authority(url: str) -> str:
    m = ABSOLUTE.fullmatch(url)
    return m[1] if m else split_base(url)[1]


def key(url: str) -> str:
    return url.rstrip("/").lower()


def style(tag: str, up: str | None) -> int:
    if tag in HEADINGS:
        return 1 if tag < "h4" else 2
    return (3 if up == "ol" else 4) if tag == "li" else 0


class Path:
    """A path of open elements.  ``top``: the content root's place in it (-1: the page is the root; None: not met
    yet); ``free``: the root was a tag that is never open, so it has no end.  Steps are under the tags met here."""
    __slots__ = ("names", "top", "free", "steps", "by_code", "gone", "own", "block", "bold", "italic", "style", "anchor", "up")

    def __init__(self, names: tuple[str, ...], top: int | None, free: bool, strip: frozenset[str], parents: frozenset[str]):
        self.names, self.top, self.free, self.steps, self.by_code = names, top, free, {}, {}
        self.gone = any(n in strip for n in names)
        self.own = self.anchor = -1
        self.block = self.bold = self.italic = False
        self.style, self.up = 0, None
        if top is None or self.gone:
            return
        for i in range(top + 1, len(names)):
            name = names[i]
            if name in BLOCK_TAGS:
                self.own, self.bold, self.italic = i, False, False
            else:
                self.bold, self.italic = self.bold or name in BOLD_TAGS, self.italic or name in ITALIC_TAGS
            if name == "a":
                self.anchor = i if "" in parents or i > 0 and names[i - 1] in parents else -1
        self.block = self.own >= 0 and self.own == len(names) - 1
        if self.own >= 0:
            self.style = style(names[self.own], names[self.own - 1] if self.own else None)
        if self.anchor > 0:
            self.up = names[self.anchor - 1]


def _last(names: list[str], among: tuple[str, ...]) -> int:
    return next((i for i in range(len(names) - 1, -1, -1) if names[i] in among), -1)


def _fenced(names: list[str], depth: int, fence: tuple[str, ...] | None) -> bool:
    return any(n in (BLOCK_LEVEL if fence is None else fence) for n in names[depth + 1:])


#: The next path, its steps, the depths of its block and its anchor, what to do, and at which depth.
Step = tuple[Path, dict, int, int, int, int]


class Paths:
    """The paths met so far, for one choice of the content root."""

    def __init__(self, kind: str | None, strip: frozenset[str], parents: frozenset[str]):
        self.kind, self.strip, self.parents = kind, strip, parents
        self.forget()

    def forget(self) -> None:
        self.known: dict[tuple, Path] = {}
        self.n = 0
        self.start = self.path((), -1 if self.kind is None else None, self.kind is None)

    def path(self, names: tuple[str, ...], top: int | None, free: bool) -> Path:
        key = (names, top, free)
        if key not in self.known:
            self.known[key] = Path(names, top, free, self.strip, self.parents)
        return self.known[key]

    def step(self, at: Path, tag: str | None, exact: bool) -> Step:
        """From ``at`` over a tag."""
        if tag is None:
            return self._found(at, NO_TAG, 0)
        if not exact and not PLAIN.fullmatch(tag):
            raise NotPlain
        c = code(tag)
        found = at.by_code.get(c)
        if found is None:
            found = at.by_code[c] = self._found(*self._step(at, parse_code(c)))
            self.n += 1
        if len(tag) < 16 and "=" not in tag:
            at.steps[tag] = found
            self.n += 1
        return found

    @staticmethod
    def _found(after: Path, what: int, depth: int) -> Step:
        return after, after.steps, after.own, after.anchor, what, depth

    def _step(self, at: Path, tag: Tag | None) -> tuple[Path, int, int]:
        if tag is None:
            return at, NOTHING, 0
        names, top = list(at.names), at.top
        if not tag.start:
            own = _last(names, HEADINGS if tag.name in HEADINGS else (tag.name,))
            if own >= 0 and not _fenced(names, own, FENCES.get(tag.name)):
                del names[own:]
        else:
            for among, fence in ENDS.get(tag.name, ()):
                depth = _last(names, among)
                if depth >= 0 and not _fenced(names, depth, fence):
                    del names[depth:]
        depth = len(names)
        if top is not None and top >= depth:
            if not at.free:
                return at, END, 0
            top = depth - 1
        base = self.path(tuple(names), top, at.free)
        if not tag.start:
            return base, NOTHING, 0
        name, gone = tag.name, base.gone or tag.name in self.strip
        is_root = top is None and not gone and self.kind == ("marked" if tag.marked and name == "div" else name)
        if is_root:
            top = depth - 1 if tag.leaf else depth
        after = self.path((*names, name) if not tag.leaf else tuple(names), top, at.free or is_root and tag.leaf)
        if is_root:
            return after, ROOT, 0
        if top is None or gone:
            return after, NOTHING, 0
        if name in BLOCK_TAGS:
            return after, (LEAF_IN_BLOCK if tag.leaf else BLOCK_IN_BLOCK) if base.block else NOTHING if tag.leaf else BLOCK, depth
        if name == "br" and base.block:
            return after, BREAK, depth - 1
        if name == "img":
            return after, IMAGE, 0
        if name == "a" and ("" in self.parents or depth > 0 and names[-1] in self.parents):
            return after, ANCHOR, depth
        return after, NOTHING, 0


class Walker:
    """Walks pages under one choice of stripped elements, root and link parents."""

    def __init__(self, strip: frozenset[str], root: str, parents: frozenset[str] = frozenset()):
        order = ("article", "main", "marked", "body") if root == "auto" else ("body",)
        self.roots = [(re.compile("(?i)<" + ("div" if kind == "marked" else kind), re.A) if kind else re.compile(""), Paths(kind, strip, parents))
                      for kind in (*order, None)]

    def _paths(self, html: str) -> Iterator[Paths]:
        for may, paths in self.roots:
            if may.search(html):
                if paths.n > MOST_STEPS:
                    paths.forget()
                yield paths

    def walk(self, html: str, one: Callable, *more) -> object:
        """``one`` of the page's pieces under the first root that the page has."""
        html = RAW_TEXT.sub(SEPARATOR, html)
        for exact in (False, True):
            try:
                for paths in self._paths(html):
                    got = one(paths, exact, *(exact_pieces if exact else plain_pieces)(html), *more)
                    if got is not None:
                        return got
            except NotPlain:
                pass
        raise AssertionError("the whole page is a root")

    def items(self, html: str, images: bool, dedup: bool) -> list[list]:
        """Items in order: ``[part, style, runs (pos, text, bold, italic), full_text, block]`` of a text,
        ``[part, src, alt]`` of an image."""
        found, containers = self.walk(html, _items, images)
        found.sort(key=_part)
        out: list[list] = []
        seen: set[str] = set()
        for g in found:
            if len(g) == 5:
                if g[4] in containers:
                    continue
                runs = g[2]
                full = g[3] = runs[0][1] if len(runs) == 1 else " ".join([r[1] for r in runs])
                if dedup:
                    if full in seen:
                        continue
                    seen.add(full)
            out.append(g)
        return out

    def anchors(self, html: str) -> list[list]:
        """``[pos, href, texts, up]`` of the anchors with an ``href``, in order."""
        return self.walk(html, _anchors)


def _part(g: list) -> int:
    return g[0]


def _items(paths: Paths, exact: bool, i: int, pieces: Pieces, images: bool) -> tuple[list[list], set[int]] | None:
    """None: the page has no such root."""
    at, step = paths.start, paths.step
    steps, own, met = at.steps, at.own, at.top is not None
    found: list[list] = []
    containers: set[int] = set()
    size = 64
    block, part, group = [0] * size, [0] * size, [None] * size      # by depth: the open block, its part, the part's texts
    for tag, close, text in pieces:
        if not close:
            raise NotPlain
        at, steps, own, _, what, depth = steps.get(tag) or step(at, tag, exact)
        if not what:
            pass
        elif what == BLOCK or what == BLOCK_IN_BLOCK:
            if what == BLOCK_IN_BLOCK:
                containers.add(block[depth - 1])
            if depth >= size:
                for x in (block, part, group):
                    x.extend([None] * size)
                size *= 2
            block[depth] = part[depth] = i
            group[depth] = None
        elif what == IMAGE:
            if images:
                src = decoded(attr(tag, "src")).strip()
                if src and not src.startswith("data:"):
                    found.append([i, src, decoded(attr(tag, "alt")).strip() or "Image"])
        elif what == BREAK:
            part[depth] = i
            group[depth] = None
        elif what == LEAF_IN_BLOCK:
            containers.add(block[depth - 1])
        elif what == ROOT:
            met = True
        elif what == END:
            break
        elif what == NO_TAG:
            i -= 1
        i += 1
        if text:
            if own >= 0:
                if "&" in text:
                    text = ENTITY.sub(_entity, text)
                text = " ".join(text.split())
                if text:
                    g = group[own]
                    if g is None:
                        group[own] = g = [part[own], at.style, [], None, block[own]]
                        found.append(g)
                    g[2].append((i, text, at.bold, at.italic))
            i += 1
    return (found, containers) if met else None


def _anchors(paths: Paths, exact: bool, i: int, pieces: Pieces) -> list[list] | None:
    at, step = paths.start, paths.step
    steps, own, met = at.steps, at.anchor, at.top is not None
    found: list[list] = []
    open_: dict[int, list] = {}                    # by depth: the open anchor's texts
    for tag, close, text in pieces:
        if not close:
            raise NotPlain
        at, steps, _, own, what, depth = steps.get(tag) or step(at, tag, exact)
        if what < ANCHOR:
            pass
        elif what == ANCHOR:
            texts = open_[depth] = []
            if HAS_HREF.search(tag):
                found.append([i, decoded(attr(tag, "href")).strip(), texts, at.names[depth - 1] if depth else None])
        elif what == ROOT:
            met = True
        elif what == END:
            break
        else:
            i -= 1
        i += 1
        if text:
            if own >= 0:
                text = decoded(text).strip()
                if text:
                    open_[own].append(text)
            i += 1
    return found if met else None


def kept_links(found: list[list], url: str | None, reserved: tuple[str, ...] | None, most: int | None) -> list[list]:
    """Without links that later steps drop for sure: unusable ones, other sites' and, with ``reserved`` titles, the page's
    own address; and without those behind the ``most`` first that are kept for sure."""
    base, met, sure, out = split_base(url), set(), 0, []
    own = base and key(url)
    for link in found:
        href = link[1]
        if not href or href.startswith(NO_LINK):
            continue
        to = base and resolved(base, href)
        if to is None:
            most = None                            # it may be any link's first occurrence
        else:
            if authority(to).lower() != base[1].lower():
                continue
            k = key(to)
            if reserved is not None and k == own:
                continue
            if most is not None and k not in met:
                met.add(k)
                title = " ".join(link[2])
                sure += title.isascii() and not any(r in title.lower() for r in reserved or ())
        out.append(link)
        if most is not None and sure >= most:
            break
    return out


RUNS = pa.list_(pa.struct([("pos", pa.int32()), ("text", pa.string()), ("bold", pa.bool_()), ("italic", pa.bool_())]))
Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


@contextmanager
def no_collection() -> Iterator[None]:
    """What pages are cut into holds no cycles, and there is much of it: not to be searched for some."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def item_rows(strip: frozenset[str], root: str, images: bool, dedup: bool, runs: bool, texts: bool) -> Batches:
    """For ``mapInArrow`` over ``(page_id, url, html)``: ``page_id, idx, style, full_text, img_url, src, base_url, alt`` of every
    item and its ``runs``, or without ``runs`` their number and bold texts; without ``texts`` of images only.  ``src`` and
    ``base_url`` are there where ``img_url`` has yet to be resolved from them."""
    def rows(walker: Walker, batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, idx, styles, full, img, src, alt = [], [], [], [], [], [], []
        n_runs, bold, all_runs = [], [], []
        for html, url in zip(batch.column(2).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            before, base = len(idx), None
            for k, g in enumerate(walker.items(html, images, dedup) if html else ()):
                if len(g) == 3:
                    base = base or split_base(url and url.decode(errors="replace"))
                    to = base and resolved(base, g[1])
                    img.append(to)
                    src.append(g[1] if to is None else None)
                    alt.append(g[2])
                    styles.append(None)
                    full.append("")
                    if runs:
                        all_runs.append(None)
                    else:
                        n_runs.append(0)
                        bold.append("")
                elif texts:
                    img.append(None)
                    src.append(None)
                    alt.append(None)
                    styles.append(g[1])
                    full.append(g[3])
                    own = g[2]
                    if runs:
                        all_runs.append(own)
                    else:
                        n_runs.append(len(own))
                        bold.append((own[0][1] if own[0][2] else "") if len(own) == 1 else "|".join([r[1] for r in own if r[2]]))
                else:
                    continue
                idx.append(k)
            counts.append(len(idx) - before)
        of = np.repeat(np.arange(len(counts)), counts)
        src = pa.array(src, pa.string())
        more = {"runs": _run_array(all_runs)} if runs else {"n_runs": pa.array(n_runs, pa.int32()), "bold_text": pa.array(bold, pa.string())}
        return pa.RecordBatch.from_pydict({
            "page_id": batch.column(0).take(pa.array(of)), "idx": pa.array(idx, pa.int32()),
            "style": pa.DictionaryArray.from_arrays(pa.array(styles, pa.int8()), pa.array(STYLES)).cast(pa.string()),
            "full_text": pa.array(full, pa.string()), "img_url": pa.array(img, pa.string()), "src": src,
            "base_url": batch.column(1).take(pa.array(of, mask=np.asarray(src.is_null()))), "alt": pa.array(alt, pa.string()), **more})

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = Walker(strip, root)
        for batch in them:
            with no_collection():
                out = rows(walker, batch)
            yield out
    return batches


def _run_array(them: list[list[tuple] | None]) -> pa.Array:
    offsets = np.zeros(len(them) + 1, np.int32)
    offsets[1:] = np.cumsum([len(x or ()) for x in them])
    flat = [r for x in them if x for r in x]
    columns = list(zip(*flat, strict=True)) if flat else [()] * 4
    values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RUNS.value_type, strict=True)], fields=list(RUNS.value_type))
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array([x is None for x in them], pa.bool_()))


def anchor_rows(strip: frozenset[str], root: str, parents: frozenset[str], reserved: tuple[str, ...] | None, most: int | None) -> Batches:
    """For ``mapInArrow`` over ``(page_id, url, html)``: ``page_id, pos, href, base_url, text, up`` of the anchors with ``href``
    that ``kept_links`` keeps."""
    def rows(walker: Walker, batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, links = [], []
        for html, url in zip(batch.column(2).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            found = walker.anchors(html) if html else []
            if found:
                found = kept_links(found, url and url.decode(errors="replace"), reserved, most)
            counts.append(len(found))
            links.extend(found)
        pos, href, texts, up = zip(*links, strict=True) if links else ((),) * 4
        of = pa.array(np.repeat(np.arange(len(counts)), counts))
        return pa.RecordBatch.from_pydict({
            "page_id": batch.column(0).take(of), "pos": pa.array(pos, pa.int32()), "href": pa.array(href, pa.string()),
            "base_url": batch.column(1).take(of), "text": pa.array([" ".join(t) for t in texts], pa.string()), "up": pa.array(up, pa.string())})

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = Walker(strip, root, parents)
        for batch in them:
            with no_collection():
                out = rows(walker, batch)
            yield out
    return batches
