"""HTML as a tree: a small reader that forgives what browsers forgive."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Elements that stand on lines of their own; text on either side of them is not one word.
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend "
                  "li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body br caption html legend option optgroup select tbody td tfoot th thead tr dd dt li".split()) | {"li", "dd", "dt"}
#: A start tag ends an open element of the second set, unless one of the third was opened since.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
CLOSES_P_SCOPE = frozenset("table td th button".split())
DEPTH = 200            # deeper elements become children of the element at this depth; nothing is lost
NAME = re.compile(r"/?[A-Za-z][^\s/>]*")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
END_OF = {name: re.compile(f"</{name}", re.I) for name in RAW}


class Node:
    __slots__ = ("tag", "attributes", "kids")

    def __init__(self, tag: str, attributes: str) -> None:
        self.tag, self.attributes, self.kids = tag, attributes, []

    def attribute_values(self) -> dict[str, str]:
        return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(self.attributes)} if self.attributes.strip() else {}


class Tag(NamedTuple):
    name: str
    attributes: str
    end: int


def tag_at(text: str, at: int) -> Tag | None:
    """The tag that starts at a '<', or None if none does. A quoted attribute may hold a '>'."""
    m = NAME.match(text, at + 1)
    if m is None:
        return None
    stop = text.find(">", m.end())
    if stop < 0:
        return Tag(m.group().lower(), "", len(text))  # cut off inside a tag
    if "=" in text[m.end():stop]:
        quote, k = "", m.end()
        while True:
            piece = text[k:stop]
            for c in re.findall("[\"']", piece):
                quote = c if not quote else "" if c == quote else quote
            if not quote:
                break
            k, after = stop, text.find(quote, stop)
            if after < 0:  # an open quote: the first '>' ends the tag
                stop = text.find(">", m.end())
                break
            nxt = text.find(">", after)
            if nxt < 0:
                break
            stop = nxt
    return Tag(m.group().lower(), text[m.end():stop], stop + 1)


def tree(text: str) -> Node:
    """The element tree; text nodes are strings with character references decoded."""
    root = Node("#root", "")
    stack, opened = [root], {}

    def shut(k: int) -> None:
        for node in stack[k:]:
            opened[node.tag] -= 1
        del stack[k:]

    def shut_nearest(names: set | frozenset, unless: set | frozenset) -> None:
        if any(opened.get(n) for n in names):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in names:
                    shut(k)
                    if len(names) == 1:
                        return
                elif stack[k].tag in unless:
                    return

    def say(piece: str) -> None:
        if piece:
            stack[-1].kids.append(html.unescape(piece) if "&" in piece else piece)

    at = 0
    while at < len(text):
        less = text.find("<", at)
        if less < 0:
            say(text[at:])
            break
        say(text[at:less])
        if text.startswith("<!--", less):
            stop = text.find("-->", less + 4)
            at = len(text) if stop < 0 else stop + 3
            continue
        tag = tag_at(text, less)
        if tag is None:
            if text.startswith(("<!", "<?", "</"), less):
                stop = text.find(">", less)
                at = len(text) if stop < 0 else stop + 1
            else:
                say("<")
                at = less + 1
            continue
        at = tag.end
        name = tag.name
        if name[0] == "/":
            name = name[1:]
            if name == "br":
                stack[-1].kids.append(Node("br", ""))
            elif opened.get(name):
                k = len(stack) - 1
                while stack[k].tag != name:
                    k -= 1
                shut(k)
            continue
        if name in IMPLIED:
            shut_nearest(*IMPLIED[name])
        if name in CLOSES_P:
            shut_nearest({"p"}, CLOSES_P_SCOPE)
        node = Node(name, tag.attributes)
        stack[-1].kids.append(node)
        if name in RAW:
            m = END_OF[name].search(text, at)
            stop = m.start() if m else len(text)
            if name in ("title", "textarea"):
                node.kids.append(html.unescape(text[at:stop]))
            closing = text.find(">", stop)
            at = len(text) if closing < 0 else closing + 1
        elif name not in VOID and not (tag.attributes.endswith("/") and name not in BLOCK) and len(stack) < DEPTH:
            stack.append(node)
            opened[name] = opened.get(name, 0) + 1
    return root
