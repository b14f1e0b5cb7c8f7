"""A forgiving HTML reader: block elements as a tree, and the text blocks in page order."""

from __future__ import annotations

import html
import re

# Elements of HTML by role.
RAW = ("script", "style", "textarea", "title")  # without an end tag they go on to the end of the page
SOFT = ("noscript", "template", "svg", "iframe", "object", "math", "select", "datalist", "canvas", "audio", "video")  # without one only the tag goes
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output picture q ruby rb rt rp s samp small source span strike strong sub sup time track tt u var wbr input param embed area map slot".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr basefont frame".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li dt dd tr td th tbody thead tfoot".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
BOUND = frozenset("ul ol table div section article body blockquote td th nav main aside header footer dl form figure".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW) + r")\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*+>|\Z)"
    r"|<(?P<soft>" + "|".join(SOFT) + r")\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>[^<]*+(?:<(?!/?(?P=soft)\b)[^<]*+)*+</(?P=soft)\s*+>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^<>]*+)(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPACE = re.compile(r"\s+")


class Page:
    """Nodes in page order; tags[0] is the root. blocks: (node, text). Lists of equal length: tags, attrs, parent, words, linked, depth."""

    __slots__ = ("tags", "attrs", "parent", "depth", "blocks", "chars", "linked", "has_children")

    def __init__(self, text: str | None):
        self.tags, self.attrs, self.parent, self.depth = ["#root"], [""], [-1], [0]
        self.blocks: list[tuple[int, str]] = []
        self.chars, self.linked, self.has_children = [0], [0], [False]
        if text:
            self._read(text)
        self._split_mixed()

    def _node(self, tag: str, attrs: str, parent: int) -> int:
        self.tags.append(tag)
        self.attrs.append(attrs)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.chars.append(0)
        self.linked.append(0)
        self.has_children.append(False)
        self.has_children[parent] = True
        return len(self.tags) - 1

    def _read(self, text: str) -> None:
        stack = [0]
        parts: list[str] = []
        link, linked, at, tags = 0, 0, 0, self.tags

        def flush() -> None:
            nonlocal linked
            if parts:
                block = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
                parts.clear()
                if block:
                    node = stack[-1]
                    self.blocks.append((node, block))
                    self.chars[node] += len(block)
                    self.linked[node] += min(linked, len(block))
            linked = 0

        for m in _TOKEN.finditer(text):
            if m.start() > at:
                parts.append(piece := text[at : m.start()])
                if link:
                    linked += len(piece.strip())
            at = m.end()
            name = m[4] or m[7]
            if name is None:
                continue
            name = name.lower()
            closing = bool(m[3] or m[6])
            if name in SOFT:  # its end tag is absent, or this is one alone
                continue
            if name == "br":
                parts.append(" ")
            elif name in INLINE:
                if name == "a":
                    link = 0 if closing else 1
                elif name in ("img", "input") and not closing:
                    parts.append(" ")
            elif closing:
                flush()
                link = 0
                for i in range(len(stack) - 1, 0, -1):
                    if tags[stack[i]] == name:
                        del stack[i:]
                        break
                    if tags[stack[i]] in ("td", "th", "table") and name in ("div", "section", "p", "article"):
                        break
            elif name in ("html", "head", "body", "meta", "link", "base"):  # the end tag of a head may be absent: no node, only what never shows is skipped
                flush()
                if name == "body":
                    attrs = m[5] or m[8] or ""
                    if not any(tags[s] == "body" for s in stack):
                        stack.append(self._node("body", attrs if "=" in attrs else "", stack[-1]))
            else:
                flush()
                link = 0
                if name in CLOSES_P:
                    for i in range(len(stack) - 1, 0, -1):
                        t = tags[stack[i]]
                        if t == "p":
                            del stack[i:]
                            break
                        if t in BOUND:
                            break
                if name in SAME:
                    for i in range(len(stack) - 1, 0, -1):
                        t = tags[stack[i]]
                        if t in SAME[name]:
                            del stack[i:]
                        elif t in BOUND or t == "tbody":
                            break
                attrs = m[5] or m[8] or ""
                if name not in VOID:
                    node = self._node(name, " ".join(f"{a[0].lower()}={a[1] or a[2] or a[3]}" for a in _ATTR.findall(attrs)) if attrs and len(attrs) > 4 else "", stack[-1])
                    if not attrs.endswith("/"):
                        stack.append(node)
        if at < len(text):
            parts.append(text[at:])
        flush()

    def _split_mixed(self) -> None:
        """Text that stands beside block elements gets a node of its own."""
        for i, (node, block) in enumerate(self.blocks):
            if self.has_children[node] and self.tags[node] != "#text":
                share = self.linked[node] / max(1, self.chars[node])
                self.has_children[node] = True
                new = self._node("#text", "", node)
                self.chars[new], self.linked[new] = len(block), round(share * len(block))
                self.blocks[i] = (new, block)
        for node in range(len(self.tags)):
            if self.has_children[node]:
                self.chars[node] = self.linked[node] = 0
