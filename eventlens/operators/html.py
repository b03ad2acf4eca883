"""HTML -> text over a pages table.

Dropping whole sub-trees (nested tables included) needs a real tokenizer, so
this is the one text operator that runs in Python: ``mapInPandas`` over
Arrow batches, with the standard-library ``html.parser`` tokenizer and a
small open-element stack. Spark partitions the pages; each task streams its
batches, so no page set is ever gathered in one place.

Semantics (as the reference's parser produces them):

* text comes from the first ``<document>`` element, else the first
  ``<body>``, else the whole page;
* sub-trees of the dropped tags are removed (``meta``/``link`` are void and
  never open a sub-tree); comments and doctype are not text;
* an end tag closes the most recent open element of that name (and all
  elements opened after it); a stray end tag is ignored;
* consecutive character data is one text node; an entity reference is
  decoded when its whole name is a known entity (``&amp``, ``&copy;``) and
  kept as text otherwise (``&copy2024``); a CDATA section is a text node of
  its own;
* each text node is stripped, empty ones are skipped, nodes are joined by
  newlines and whitespace-only lines are removed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from html import unescape
from html.entities import html5 as html5_entities
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the reference's for identical results.
# Tags whose sub-trees are dropped: landing step and cleaning step.
LANDING_DROP = ("script", "style", "meta", "title")
CLEANING_DROP = ("script", "style", "meta", "link", "title", "table")
EMPTY_INPUT = "N/A (Empty input)"
# ---------------------------------------------------------------------------

# HTML void elements: never have content.
VOID_TAGS = frozenset((
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
    "param", "source", "track", "wbr", "basefont", "bgsound", "command", "frame",
    "image", "isindex", "keygen", "menuitem", "nextid", "spacer"))
# Elements whose text is a special string kind that plain text extraction skips.
NON_TEXT_CONTAINERS = frozenset(("script", "style", "template", "rt", "rp"))


class _TextCollector(HTMLParser):
    def __init__(self, drop: frozenset[str]):
        # entity and character references arrive as their own tokens
        super().__init__(convert_charrefs=False)
        self.drop = drop
        self.stack: list[str] = []
        self.hidden = 0  # open elements that hide their text
        self.buf: list[str] = []
        # per root kind: [state, depth]; state 0 = not seen, 1 = open, 2 = closed
        self.roots = {"document": [0, 0], "body": [0, 0]}
        self.parts = {"document": [], "body": [], "all": []}

    def _flush(self) -> None:
        if not self.buf:
            return
        s = "".join(self.buf).strip()
        self.buf = []
        if not s or self.hidden:
            return
        self.parts["all"].append(s)
        for name, (state, _) in self.roots.items():
            if state == 1:
                self.parts[name].append(s)

    def _hides(self, tag: str) -> bool:
        return tag in self.drop or tag in NON_TEXT_CONTAINERS

    def handle_starttag(self, tag, attrs):
        self._flush()
        if tag in VOID_TAGS:
            return
        self.stack.append(tag)
        if self._hides(tag):
            self.hidden += 1
        root = self.roots.get(tag)
        if root is not None and root[0] == 0:
            root[0], root[1] = 1, len(self.stack)

    def handle_startendtag(self, tag, attrs):
        self._flush()  # self-closing: no sub-tree

    def handle_endtag(self, tag):
        self._flush()
        if tag not in self.stack:
            return
        while self.stack:
            top = self.stack.pop()
            if self._hides(top):
                self.hidden -= 1
            for root in self.roots.values():
                if root[0] == 1 and len(self.stack) < root[1]:
                    root[0] = 2
            if top == tag:
                break

    def handle_data(self, data):
        self.buf.append(data)

    def handle_entityref(self, name):
        # a known name (with or without its semicolon) is its character;
        # an unknown one stays literal text
        ch = html5_entities.get(name + ";") or html5_entities.get(name)
        self.buf.append(ch if ch is not None else "&" + name)

    def handle_charref(self, name):
        self.buf.append(unescape(f"&#{name};"))

    def handle_comment(self, data):
        self._flush()

    def handle_decl(self, decl):
        self._flush()

    def handle_pi(self, data):
        self._flush()

    def unknown_decl(self, data):
        self._flush()
        if data.upper().startswith("CDATA["):  # a CDATA section is a text node of its own
            self.buf.append(data[len("CDATA["):])
            self._flush()

    def text(self) -> str:
        self._flush()
        for name in ("document", "body"):
            if self.roots[name][0]:
                nodes = self.parts[name]
                break
        else:
            nodes = self.parts["all"]
        lines = "\n".join(nodes).split("\n")
        return "\n".join(ln for ln in lines if ln.strip())


def extract_text(html: str | None, drop: Iterable[str] = CLEANING_DROP,
                 empty_value: str | None = EMPTY_INPUT) -> str | None:
    """Text of one page (the per-row helper of :func:`html_to_text`)."""
    if not isinstance(html, str):
        return empty_value
    if not html.strip():
        return empty_value if empty_value is not None else ""
    p = _TextCollector(frozenset(drop))
    p.feed(html)
    p.close()
    return p.text()


def html_to_text(df: DataFrame, html_col: str = "html", out_col: str = "text",
                 drop: Iterable[str] = CLEANING_DROP,
                 empty_value: str | None = EMPTY_INPUT) -> DataFrame:
    """F9 as a job: appends ``out_col`` with the page text. Project the
    columns you need *before* calling it: the Python boundary is opaque to
    column pruning."""
    drop = tuple(drop)
    fields = [f for f in df.schema.fields if f.name != out_col]
    schema = T.StructType(fields + [T.StructField(out_col, T.StringType())])
    names = [f.name for f in fields]

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            out = pdf[names].copy()
            out[out_col] = [extract_text(h, drop, empty_value) for h in pdf[html_col]]
            yield out

    return df.mapInPandas(run, schema)
