"""One HTML page -> its fields and readable text, on the standard library's tokenizer."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from lorekeep.functions.text import SPACE
from lorekeep.functions.urls import punycode_url

# Elements without content, page furniture, content containers and block elements.
VOID = frozenset("area base basefont br col command embed frame hr img input isindex keygen link meta param source track wbr".split())
CHROME_TAGS = frozenset("script style noscript template svg iframe form nav header footer aside".split())
CHROME_ROLES = frozenset("navigation banner contentinfo search".split())
BLOCKS = frozenset("p div section li tr td th dt dd blockquote pre figcaption br hr table ul ol dl".split())
HEADINGS = {f"h{n}": n for n in range(1, 7)}
CONTAINERS = (
    lambda n: n.tag == "main",
    lambda n: n.attrs.get("role") == "main",
    lambda n: n.tag == "article",
    lambda n: n.attrs.get("id") == "content",
    lambda n: "content" in n.classes(),
    lambda n: n.tag == "body",
)
# Which open elements a start tag ends, when one of them is innermost.
_P_ENDERS = (
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main nav ol p pre section table ul"
).split()
_FORM = frozenset("input option optgroup select button datalist textarea".split())
ENDS = {tag: frozenset({"p"}) for tag in _P_ENDERS} | {
    "tr": frozenset("tr th td".split()),
    "th": frozenset({"th"}),
    "td": frozenset("thead th td".split()),
    "body": frozenset("head link script".split()),
    "li": frozenset({"li"}),
    "option": frozenset({"option"}),
    "optgroup": frozenset("optgroup option".split()),
    "dd": frozenset("dt dd".split()),
    "dt": frozenset("dt dd".split()),
    "select": _FORM,
    "input": _FORM,
    "output": _FORM,
    "button": _FORM,
    "datalist": _FORM,
    "textarea": _FORM,
    "tbody": frozenset("thead tbody".split()),
    "tfoot": frozenset("thead tbody".split()),
}

_SPACES = re.compile(f"[{SPACE}]+")
_EDGES = re.compile(f"^[{SPACE}]+|[{SPACE}]+$")


def trim(text: str) -> str:
    return _EDGES.sub("", text)


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def walk(self):
        """Elements below this one in document order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self) -> str:
        parts, todo = [], list(reversed(self.children))
        while todo:
            item = todo.pop()
            if isinstance(item, str):
                parts.append(item)
            else:
                todo.extend(reversed(item.children))
        return "".join(parts)

    def is_chrome(self) -> bool:
        return (
            self.tag in CHROME_TAGS
            or self.attrs.get("aria-hidden") == "true"
            or self.attrs.get("role") in CHROME_ROLES
            or (self.tag == "section" and "delivery-returns" in self.classes())
        )


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        ended = ENDS.get(tag)
        while ended and self.open[-1].tag in ended:
            self.open.pop()
        named: dict = {}
        for key, value in attrs:
            named.setdefault(key, value or "")
        node = Node(tag, named)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        # a slash closes nothing but void elements and drawings, where it makes no difference to the text
        self.handle_starttag(tag, attrs)
        if tag not in VOID and any(n.tag == "svg" for n in self.open):
            self.open.pop()

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                del self.open[depth:]
                return
        if tag == "p":
            self.open[-1].children.append(Node("p", {}))
        elif tag == "br":
            self.open[-1].children.append(Node("br", {}))

    def handle_data(self, data):
        self.open[-1].children.append(data)


def _without_chrome(node: Node) -> None:
    todo = [node]
    while todo:
        current = todo.pop()
        current.children = [c for c in current.children if isinstance(c, str) or not c.is_chrome()]
        todo.extend(c for c in current.children if isinstance(c, Node))


def _content_lines(container: Node) -> list[str]:
    lines: list[str] = []
    todo: list = list(reversed(container.children))
    while todo:
        item = todo.pop()
        if item is None:
            lines.append("")
        elif isinstance(item, str):
            run = _SPACES.sub(" ", item)
            if trim(run) == "":
                continue
            last = lines[-1] if lines else ""
            if last and not last.startswith(("#", "- ")):
                lines[-1] = _SPACES.sub(" ", last + run)
            else:
                lines.append(run.lstrip(" "))
        elif item.tag in HEADINGS:
            lines += ["", "#" * HEADINGS[item.tag] + " " + trim(item.text()), ""]
        elif item.tag == "li":
            lines.append("- " + trim(_SPACES.sub(" ", item.text())))
        else:
            if item.tag in BLOCKS:
                todo.append(None)
            todo.extend(reversed(item.children))
    return lines


def parse_page(html: str) -> dict:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    root = builder.root
    first: dict = {}
    links = []

    def note(key, value):
        if key not in first and value is not None:
            first[key] = value

    for node in root.walk():
        attrs = node.attrs
        if node.tag == "a" and attrs.get("href"):
            links.append(punycode_url(attrs["href"]))
        elif node.tag == "link" and attrs.get("rel") == "canonical":
            note("canonical", punycode_url(attrs.get("href", "")))
        elif node.tag == "meta":
            if attrs.get("name") in ("description", "robots", "googlebot"):
                note(attrs["name"], attrs.get("content", ""))
            elif attrs.get("property") == "og:title":
                note("og", attrs.get("content", ""))
        elif node.tag in ("html", "h1", "title"):
            note(node.tag, attrs.get("lang", "") if node.tag == "html" else node.text())

    titles = (trim(first.get(k, "")) for k in ("h1", "og", "title"))
    noindex = any("noindex" in first.get(k, "").lower() for k in ("robots", "googlebot"))
    _without_chrome(root)
    container = next((n for fits in CONTAINERS for n in root.walk() if fits(n)), None)
    return {
        "title": next((t for t in titles if t), ""),
        "text": "" if container is None else "\n".join(_content_lines(container)),
        "canonical": trim(first.get("canonical", "")) or None,
        "locale": trim(first.get("html", "")) or None,
        "noindex": noindex,
        "description": trim(first.get("description", "")) or None,
        "links": links,
    }
