"""Open-element stack: which element every tag and text of a page lies in.

Tag sequences nest by rules that no window can follow (a start tag may end several open
elements, an end tag counts only up to a fence), so this one step is a fold over the tags of a
page, linear in their number.  It sees tag names only and returns places; texts, attributes and
everything that is computed from them stay in Spark's expressions (``quire.operators.html``).

Rules, after the HTML standard's tree construction:

* void and self-closed tags are never open;
* a start tag ends the open elements that its row of ``ENDS`` names, up to a fence: any block
  ends ``p``; ``li``, ``dt``/``dd``, ``td``/``th``, ``tr``, table parts, headings and ``a`` end
  their like;
* an end tag ends the nearest open element of its name with all inside it, but not beyond its
  fence: an inline tag ends nothing around a block, a list item nothing around its list, and
  nothing reaches out of a table cell; an end tag without such an element counts for nothing;
* what is open at the end of the page ends there.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa

# Fixed values --------------------------------------------------------------
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
SCOPE = ("table", "td", "th", "caption")
LIST_SCOPE = (*SCOPE, "ul", "ol", "menu", "dir", "section", "article", "blockquote", "main", "fieldset", "figure", "details")
#: Block-level elements: a start tag of one ends an open ``p``, and inline ends stop at them.
BLOCK_LEVEL = frozenset((
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form header hgroup hr html iframe li main menu nav noscript ol p pre section summary table tbody td tfoot th thead tr ul").split()) | set(HEADINGS)
#: start tag -> (names it ends, names it doesn't look beyond; None: any block)
_TABLE, _CELL, _PARTS = ("table",), ("td", "th"), ("thead", "tbody", "tfoot")
ENDS: dict[str, list[tuple[tuple[str, ...], tuple[str, ...] | None]]] = {
    **{t: [(("p",), (*SCOPE, "button"))] for t in BLOCK_LEVEL - {"body", "html", "button", "caption", "iframe", "noscript"}},
    "a": [(("a",), None)],
}
for _t, _more in {"li": [(("li",), LIST_SCOPE)], "dt": [(("dt", "dd"), (*SCOPE, "dl"))], "dd": [(("dt", "dd"), (*SCOPE, "dl"))],
                  "td": [(_CELL, _TABLE)], "th": [(_CELL, _TABLE)], "tr": [(("tr",), _TABLE), (_CELL, _TABLE)],
                  **{p: [(_PARTS, _TABLE), (("tr",), _TABLE), (_CELL, _TABLE)] for p in _PARTS},
                  **{h: [(HEADINGS, None)] for h in HEADINGS}}.items():
    ENDS[_t] = ENDS[_t] + _more
#: end tag -> names it doesn't look beyond; other blocks: SCOPE, inline tags: any block
FENCES: dict[str, tuple[str, ...]] = {
    **dict.fromkeys(BLOCK_LEVEL, SCOPE), "li": LIST_SCOPE[:8], "dt": (*SCOPE, "dl"), "dd": (*SCOPE, "dl"),
    **dict.fromkeys((*_CELL, "tr", *_PARTS, "caption"), _TABLE), **dict.fromkeys(("table", "body", "html"), ()),
}


class Tag(NamedTuple):
    """A tag as its code says: ``name``, ``/name`` (end), ``name/`` (self-closed), ``name*`` (marked)."""
    start: bool
    name: str
    leaf: bool
    marked: bool


def parse_code(code: str | None) -> Tag | None:
    """None for a text."""
    if not code:
        return None
    if code[0] == "/":
        return Tag(False, code[1:], True, False)
    name = code.rstrip("*/")
    return Tag(True, name, code.rstrip("*").endswith("/") or name in VOID_TAGS, code.endswith("*"))


def enclosing(tags: list[Tag | None]) -> tuple[list[int], list[int], list[int]]:
    """Per token the place of the element it lies in (-1: none); per start tag the place where
    its element ends; per end tag the element it ends (-1: none)."""
    n = len(tags)
    parent, end, ended = [-1] * n, [n] * n, [-1] * n
    stack: list[int] = []                          # open elements, outermost first
    depths: dict[str, list[int]] = {}              # of each name the depths at which it is open
    blocks: list[int] = []                         # depths of open block-level elements

    def fenced(depth: int, fence: tuple[str, ...] | None) -> bool:
        if fence is None:
            return bool(blocks) and blocks[-1] > depth
        return any(d and d[-1] > depth for d in map(depths.get, fence))

    def close(depth: int, at: int) -> None:
        for place in stack[depth:]:
            end[place] = at
            depths[tags[place].name].pop()
        while blocks and blocks[-1] >= depth:
            blocks.pop()
        del stack[depth:]

    for i, tag in enumerate(tags):
        if tag is None:
            pass
        elif tag.start:
            name = tag.name
            for names, fence in ENDS.get(name, ()):
                depth = max([d[-1] for d in map(depths.get, names) if d], default=-1)
                # a heading or anchor is a fence of its own kind only for what lies inside it
                if depth >= 0 and not fenced(depth, fence):
                    close(depth, i)
            parent[i] = stack[-1] if stack else -1
            if not tag.leaf:
                depths.setdefault(name, []).append(len(stack))
                if name in BLOCK_LEVEL:
                    blocks.append(len(stack))
                stack.append(i)
            continue
        else:
            name = tag.name
            own = max([d[-1] for d in map(depths.get, HEADINGS if name in HEADINGS else (name,)) if d], default=-1)
            if own >= 0 and not fenced(own, FENCES.get(name)):
                ended[i] = stack[own]
                close(own, i)
        parent[i] = stack[-1] if stack else -1
    return parent, end, ended


#: A token's place: its number, the element it belongs to (block or anchor) and what is known of it.
PLACE = "array<struct<pos:int,own:int,part:int,bold:boolean,italic:boolean,tag:string,up:string>>"
_FIELDS = [("pos", pa.int32()), ("own", pa.int32()), ("part", pa.int32()), ("bold", pa.bool_()), ("italic", pa.bool_()),
           ("tag", pa.string()), ("up", pa.string())]
BLOCK_TAGS = frozenset(("p", "li", *HEADINGS, "td", "th", "blockquote", "pre"))
BOLD_TAGS, ITALIC_TAGS = frozenset(("b", "strong")), frozenset(("i", "em"))


def places(tags: list[Tag | None], strip: frozenset[str], root: str, want: str,
           parents: frozenset[str] = frozenset(("li",))) -> Iterator[tuple]:
    """The wanted tokens of a page, as rows of ``PLACE``.

    ``strip``: elements dropped with all inside them.  ``root``: ``auto`` (first ``article``, else
    ``main``, else marked ``div``, else ``body``, else the page) or ``body``.  ``want``:

    * ``kept``: all tokens outside stripped elements; ``root``: of these, those inside the root;
    * ``items``: texts inside blocks without a block as a child, with ``own`` the block, ``part``
      the block or the ``br`` right under it that comes last before the text, formats from inside
      the block, ``tag`` the block's and ``up`` its parent's; and images (``tag`` only);
    * ``links``: anchors right under one of ``parents`` (with an empty name among them: all) and the
      texts inside them (``own`` the anchor, ``up`` its parent's tag).
    """
    n = len(tags)
    parent, end, ended = enclosing(tags)
    gone = [False] * n
    first: dict[str, int] = {}
    for i, tag in enumerate(tags):
        p = parent[i]
        gone[i] = p >= 0 and gone[p]
        if tag is None:
            continue
        if not tag.start:
            gone[i] = (gone[ended[i]] if ended[i] >= 0 else gone[i]) or tag.name in strip
        elif tag.name in strip:
            gone[i] = True
        elif not gone[i]:
            kind = "marked" if tag.marked and tag.name == "div" else tag.name
            if kind in ("article", "main", "marked", "body") and kind not in first:
                first[kind] = i
    order = ("article", "main", "marked", "body") if root == "auto" else ("body",)
    top = next((first[k] for k in order if k in first), -1)
    a, b = (top + 1, end[top]) if top >= 0 else (0, n)
    if want in ("kept", "root"):
        span = range(n) if want == "kept" else range(a, b)
        for i in span:
            if not gone[i]:
                yield (i, None, None, None, None, None, None)
        return

    block, bold, italic, anchor = {top: -1, -1: -1}, {top: False, -1: False}, {top: False, -1: False}, {top: -1, -1: -1}
    container, part, text_part = set(), {}, {}
    for i in range(a, b):
        tag = tags[i]
        if gone[i]:
            continue
        p = parent[i]
        if tag is None:
            text_part[i] = part.get(block[p], block[p])
        elif tag.start:
            name = tag.name
            if name in BLOCK_TAGS:
                block[i], bold[i], italic[i] = i, False, False
                if block[p] == p and p >= 0:
                    container.add(p)
            else:
                block[i], bold[i], italic[i] = block[p], bold[p] or name in BOLD_TAGS, italic[p] or name in ITALIC_TAGS
                if name == "br" and block[p] == p and p >= 0:
                    part[p] = i
            if name == "a":
                anchor[i] = i if "" in parents or p >= 0 and tags[p].name in parents else -1
            else:
                anchor[i] = anchor[p]
    for i in range(a, b):
        tag = tags[i]
        if gone[i]:
            continue
        p = parent[i]
        if want == "items":
            if tag is None:
                own = block[p]
                if own >= 0 and own not in container:
                    up = parent[own]
                    yield (i, own, text_part[i], bold[p], italic[p], tags[own].name, tags[up].name if up >= 0 else None)
            elif tag.start and tag.name == "img":
                yield (i, None, i, None, None, "img", None)
        elif tag is None:
            own = anchor[p]
            if own >= 0:
                yield (i, own, None, None, None, None, tags[parent[own]].name if parent[own] >= 0 else None)
        elif tag.start and anchor[i] == i:
            yield (i, i, None, None, None, "a", tags[p].name if p >= 0 else None)


def place_batch(codes: pa.Array, strip: frozenset[str], root: str, want: str, parents: frozenset[str]) -> pa.Array:
    """``places`` of the pages of a batch, given as lists of tag codes (texts: empty)."""
    if isinstance(codes, pa.ChunkedArray):
        codes = codes.combine_chunks()
    words = codes.flatten().dictionary_encode()
    known = [parse_code(c) for c in words.dictionary.to_pylist()] + [None]
    numbers = words.indices.fill_null(len(known) - 1).to_pylist()
    starts = codes.offsets.to_pylist()
    first = starts[0] if starts else 0
    columns: list[list] = [[] for _ in _FIELDS]
    offsets = [0]
    add = [c.append for c in columns]
    for x, y in zip(starts[:-1], starts[1:], strict=True):
        for row in places([known[k] for k in numbers[x - first:y - first]], strip, root, want, parents):
            for put, value in zip(add, row, strict=True):
                put(value)
        offsets.append(len(columns[0]))
    structs = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS, strict=True)], [f for f, _ in _FIELDS])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)
