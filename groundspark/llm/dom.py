"""A small HTML reader: elements and text runs of a page in document order, and the blocks they form."""

from __future__ import annotations

import html
import re
from collections import Counter

#: Fixed values from the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body button caption html legend option summary tbody td tfoot th thead tr".split())
#: What a start tag closes, and what keeps it from looking further up.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)), "tfoot": (("thead", "tbody", "tfoot"), ("table",)), "option": (("option",), ("select",)),
}
#: Elements whose content is never shown as text of the page.
UNSEEN = frozenset("script style title noscript noframes template iframe object svg foreignobject annotation annotation-xml select textarea canvas audio video".split())
#: What can stand in a head; any other start tag, and text, ends one that is open.
HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
#: Elements that a slash at the end of their start tag closes, as it does for all of a formula or drawing.
MATH = frozenset(
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose mfenced msub msup msubsup munder mover munderover "
    "mmultiscripts mprescripts none mtable mtr mtd mlabeledtr maction semantics mglyph maligngroup malignmark".split()
)
DRAWN = MATH | {"svg", "foreignobject", "annotation", "annotation-xml"}
#: Start tags that end a drawing left open.
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong "
    "strike sub sup table tt u ul var".split()
)
RAW = {"script": None, "style": None, "textarea": None, "title": None, "iframe": None, "noscript": None, "noframes": None}
RAW = {k: re.compile(rf"</{k}(?=[\s/>])", re.I) for k in RAW}

#: In a tag quotes delimit only directly after "=" (and only if they are closed at all); elsewhere they are letters.
VALUE = r"(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+)"
MARKUP = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+{VALUE})?+)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
#: The slash at the end is part of a value without quotes.
VALUED = re.compile(r"=\s*[^\s\"'>]+/\Z")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
TOKEN = re.compile(r"[a-z]+")


class Page:
    """Nodes in document order: tag ("#text" for a run), parent (-1: none), attribute tokens, text, and a run's block number."""

    __slots__ = ("tag", "parent", "tokens", "text", "block", "_stack", "_block", "_gap")

    def __init__(self, source: str | None):
        self.tag: list[str] = []
        self.parent: list[int] = []
        self.tokens: list[tuple[str, ...]] = []
        self.text: list[str] = []
        self.block: list[int] = []
        self._stack: list[int] = []
        self._block = 0
        self._gap = False  # white space between the run before and the next one, which belongs to neither's element
        self._read(source or "")

    def _node(self, tag: str, tokens: tuple[str, ...] = (), text: str = "") -> int:
        self.tag.append(tag)
        self.parent.append(self._stack[-1] if self._stack else -1)
        self.tokens.append(tokens)
        self.text.append(text)
        self.block.append(self._block)
        return len(self.tag) - 1

    def _close(self, tags: tuple[str, ...], stops: tuple[str, ...] | frozenset[str]) -> None:
        for k in range(len(self._stack) - 1, -1, -1):
            name = self.tag[self._stack[k]]
            if name in tags:
                del self._stack[k:]
                self._block += name in BLOCK
                return
            if name in stops:
                return

    def _read(self, source: str) -> None:
        at, head = 0, False
        unseen: list[str] = []
        among = Counter()
        last_end: dict[str, int] = {}
        while at < len(source):
            m = MARKUP.search(source, at)
            start = m.start() if m else len(source)
            if start > at and not unseen:
                raw = source[at:start]
                if raw.isspace():
                    self._gap |= not head
                else:
                    head = False
                    self._node("#text", (), " " * self._gap + (html.unescape(raw) if "&" in raw else raw))
                    self._gap = False
            if not m:
                return
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:  # an end tag
                if name == "head":
                    head = False
                elif among[name]:
                    last = ""
                    while last != name:
                        last = unseen.pop()
                        among[last] -= 1
                if name == "head" or name in UNSEEN:
                    continue
                if unseen or name in VOID:
                    self._gap |= name == "br"
                    continue
                stops = frozenset() if name in BLOCK else BLOCK
                self._close((name,), stops)
                if name in BLOCK:
                    self._block += 1
                continue
            closed = m[3].endswith("/") and not VALUED.search(m[3])
            if unseen and unseen[-1] == "svg" and name in BREAKOUT:
                among[unseen.pop()] -= 1
            if name in RAW:
                end = RAW[name].search(source, at)
                if closed and (not end or among["svg"]):
                    continue
                at = len(source) if not end else (source.find(">", end.end()) + 1 or len(source))
                continue
            if name in DRAWN and closed:
                continue
            if name in UNSEEN:
                head &= name in HEAD
                if name not in last_end:
                    last_end[name] = max((e.start() for e in re.finditer(rf"</{name}(?=[\s/>])", source, re.I)), default=-1)
                if last_end[name] >= at or name == "svg":  # one that is never closed hides nothing, but for a drawing up to the next text element
                    unseen.append(name)
                    among[name] += 1
                continue
            if name == "body":
                unseen.clear()
                among.clear()
            if unseen:
                continue
            if name == "head":
                head = True
                continue
            head &= name in HEAD
            if name in VOID:
                self._gap |= name == "br"
                if name == "hr":
                    self._block += 1
                continue
            if name in CLOSES_P:
                self._close(("p",), ("td", "th", "button", "table", "body"))
            if name in IMPLIED:
                self._close(*IMPLIED[name])
            if name in BLOCK:
                self._block += 1
            tokens: list[str] = []
            if m[3]:
                for a in ATTRIBUTE.finditer(m[3]):
                    key, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
                    if key == "style":
                        tokens += ["hidden"] * ("display:none" in value.replace(" ", ""))
                    elif key in ("hidden", "aria-hidden"):
                        tokens += ["hidden"] * (value != "false")
                    else:
                        tokens += TOKEN.findall(value)
            self._stack.append(self._node(name, tuple(tokens)))

    def blocks(self, kept: list[bool]) -> str:
        """The kept runs, one block for each block number, white space collapsed, joined by an empty line."""
        out: dict[int, list[str]] = {}
        for k, tag in enumerate(self.tag):
            if tag == "#text" and kept[k]:
                out.setdefault(self.block[k], []).append(self.text[k])
        return "\n\n".join(b for b in (" ".join("".join(runs).split()) for runs in out.values()) if b)
