"""A small HTML parser: tokens, a tree built with the usual implied tags, CSS selectors, text and markup.

It follows the HTML Standard where captured pages need it: raw-text elements, implied end tags, unclosed formatting elements that go
on in the next block (at most three alike), character references, missing html, head and body. Nesting is kept on a stack, so
deep pages do no harm.
"""

from __future__ import annotations

import html as _html
import html.entities as _entities
import re
from collections.abc import Iterator

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
HEAD = frozenset("title meta link base style script noscript template".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split()
)
#: Opening the first closes the nearest of the second, unless one of the third lies between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
_SCOPE = frozenset("table td th caption button object template html".split())
_TOKEN = re.compile(r"<(?:!--(?:.*?--!?>|.*$)|[!?][^>]*>|/?[a-zA-Z][^\s/>]*(?:[^>\"']|\"[^\"]*\"|'[^']*')*>|/?[a-zA-Z][^>]*>)", re.S)
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.parent = tag, attrs or {}, parent
        self.children: list[Node | str] = []

    def get(self, name: str, default: str | None = None) -> str | None:
        return self.attrs.get(name, default)

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def walk(self) -> Iterator[Node]:
        """The elements below, in document order."""
        stack = [c for c in reversed(self.children) if not isinstance(c, str)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if not isinstance(c, str))

    def text(self) -> str:
        out: list[str] = []
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack.extend(reversed(x.children))
        return "".join(out)

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def select(self, selector: str) -> list[Node]:
        tests = compile_selector(selector)
        return [n for n in self.walk() if any(_matches(n, t) for t in tests)]

    def first(self, selector: str) -> Node | None:
        tests = compile_selector(selector)
        return next((n for n in self.walk() if any(_matches(n, t) for t in tests)), None)

    def inner(self) -> str:
        """Markup of what is inside."""
        return "".join(_markup(list(reversed(self.children))))

    def outer(self) -> str:
        return "".join(_markup([self]))


class _End(str):
    """An end tag that is still to be written."""

    __slots__ = ()


def _markup(stack: list[Node | str]) -> Iterator[str]:
    while stack:
        x = stack.pop()
        if isinstance(x, _End):
            yield str(x)
        elif isinstance(x, str):
            yield _html.escape(x, quote=False)
        else:
            attrs = "".join(f' {k}="{_html.escape(v)}"' for k, v in x.attrs.items())
            yield f"<{x.tag}{attrs}>"
            if x.tag in VOID:
                continue
            stack.append(_End(f"</{x.tag}>"))
            stack.extend(_End(c) if isinstance(c, str) and x.tag in ("script", "style") else c for c in reversed(x.children))


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(source):
        value = a or b or c
        out.setdefault(name.lower(), _html.unescape(value) if "&" in value else value)
    return out


_CLOSED = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def unescape_closed(text: str) -> str:
    """text with the character references decoded that a semicolon closes. Others, which HTML decodes for old names (&amp, &copy), stay as they stand:
    they are what is left where a text was cut within a reference."""
    return _CLOSED.sub(lambda m: _html.unescape(m[0]) if m[1][0] == "#" or m[1] + ";" in _entities.html5 else m[0], text)


def parse(source: str | None, closed: bool = False) -> Node:
    """The html element of a page; it always has a head and a body. closed: texts keep character references that no semicolon closes."""
    unescape = unescape_closed if closed else _html.unescape
    root = Node("html")
    head, body = Node("head", None, root), Node("body", None, root)
    root.children = [head, body]
    source = source or ""
    stack: list[Node] = [root, head]
    active: list[Node] = []  # formatting elements that go on until their end tag
    in_body = False
    at, n = 0, len(source)

    def open_body() -> None:
        nonlocal in_body
        in_body = True
        stack[:] = [root, body]

    def put_text(text: str) -> None:
        if not text:
            return
        if not in_body:
            if not text.strip():
                return
            open_body()
        if active:
            reconstruct()
        stack[-1].children.append(unescape(text) if "&" in text else text)

    def reconstruct() -> None:
        for i, f in enumerate(active):
            if f not in stack:
                again = Node(f.tag, dict(f.attrs), stack[-1])
                stack[-1].children.append(again)
                stack.append(again)
                active[i] = again

    def pop_to(names: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> None:
        for i in range(len(stack) - 1, 1, -1):
            if stack[i].tag in names:
                del stack[i:]
                return
            if stack[i].tag in stop:
                return

    while at < n:
        m = _TOKEN.search(source, at)
        if m is None:
            put_text(source[at:])
            break
        if m.start() > at:
            put_text(source[at : m.start()])
        at = m.end()
        token = m[0]
        name = _NAME.match(token)
        if name is None:
            continue
        tag = name[2].lower()
        if name[1]:
            if tag in ("html", "body", "head"):
                continue
            if tag in FORMATTING:
                mine = next((f for f in reversed(active) if f.tag == tag), None)
                if mine is not None:
                    active.remove(mine)
                    if mine in stack:
                        del stack[stack.index(mine) :]
                continue
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                pop_to({"h1", "h2", "h3", "h4", "h5", "h6"}, _SCOPE)
            elif tag in ("table", "caption", "tbody", "thead", "tfoot", "tr", "td", "th"):
                pop_to({tag}, {"table", "template"} - {tag})
            else:
                pop_to({tag}, _SCOPE - {tag} if tag != "p" else _SCOPE)
            continue
        attrs = attributes(token[name.end() : -1]) if len(token) > name.end() + 1 else {}
        if tag == "html":
            root.attrs = attrs | root.attrs
            continue
        if tag == "head":
            head.attrs = attrs | head.attrs
            continue
        if tag == "body":
            body.attrs = attrs | body.attrs
            if not in_body:
                open_body()
            continue
        if not in_body and tag not in HEAD:
            open_body()
        if tag in CLOSES_P:
            pop_to({"p"}, _SCOPE)
        if tag in CLOSES:
            pop_to(*CLOSES[tag])
            if tag in ("tr", "tbody", "thead", "tfoot"):
                pop_to({"tr"}, {"table"})
        if tag in FORMATTING or tag not in CLOSES_P and tag not in HEAD:
            if tag == "a":
                old = next((f for f in reversed(active) if f.tag == "a"), None)
                if old is not None:
                    active.remove(old)
                    if old in stack:
                        del stack[stack.index(old) :]
            if active:
                reconstruct()
        node = Node(tag, attrs, stack[-1])
        stack[-1].children.append(node)
        if tag in VOID or (token.endswith("/>") and tag in ("path", "circle", "rect", "use", "g", "line", "polygon")):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
            raw = source[at : end.start() if end else n]
            if raw:
                node.children.append(unescape(raw) if tag in ("title", "textarea") else raw)
            at = end.end() if end else n
            continue
        stack.append(node)
        if tag in FORMATTING:
            alike = [f for f in active if f.tag == tag and f.attrs == attrs]
            if len(alike) >= 3:
                active.remove(alike[0])
            active.append(node)
    return root


_SIMPLE = re.compile(r"""([a-zA-Z][\w-]*|\*)|\#([\w-]+)|\.([\w-]+)|\[\s*([\w:-]+)\s*(?:([*^$~]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+))\s*(i)?\s*)?\]""")
_COMPILED: dict[str, list] = {}


def compile_selector(selector: str) -> list:
    """Commas, descendants, tag, #id, .class, [a], [a=v], [a*=v], [a^=v], [a$=v], [a~=v] and the i flag."""
    if selector not in _COMPILED:
        out = []
        for one in re.split(r",(?![^\[]*\])", selector):
            steps = []
            for part in re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", one.strip()):
                steps.append([(t.lower(), i, c, a.lower(), op, x or y or z, bool(flag)) for t, i, c, a, op, x, y, z, flag in _SIMPLE.findall(part)])
            out.append(steps)
        _COMPILED[selector] = out
    return _COMPILED[selector]


def _simple(node: Node, tests: list) -> bool:
    for tag, id_, class_, attr, op, value, fold in tests:
        if tag:
            if tag not in ("*", node.tag):
                return False
        elif id_:
            if node.get("id") != id_:
                return False
        elif class_:
            if class_ not in node.classes:
                return False
        else:
            have = node.get(attr)
            if have is None:
                return False
            if op:
                have, value = (have.lower(), value.lower()) if fold else (have, value)
                ok = {"=": have == value, "*=": value in have, "^=": have.startswith(value), "$=": have.endswith(value), "~=": value in have.split()}[op]
                if not ok or not value:
                    return False
    return True


def any_match(node: Node, selector: str) -> bool:
    return any(_matches(node, t) for t in compile_selector(selector))


def _matches(node: Node, steps: list) -> bool:
    if not _simple(node, steps[-1]):
        return False
    i, above = len(steps) - 2, node.parent
    while i >= 0 and above is not None:
        if _simple(above, steps[i]):
            i -= 1
        above = above.parent
    return i < 0
