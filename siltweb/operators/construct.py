"""One page's tree as browsers build it: a state machine over tags and text, by the public HTML standard's tree construction.

Only the tree of a single page is made here; `tree.rows` turns pages into rows, and all else is work on these rows. Frames,
the modes of templates and the integration points of foreign content are left out: their tags nest as others do.
"""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser


def _set(names: str) -> frozenset[str]:
    return frozenset(names.split())


# The standard's classes of elements.
VOID = _set("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr")
FORMATTING = _set("a b big code em font i nobr s small strike strong tt u")
HEADINGS = _set("h1 h2 h3 h4 h5 h6")
CLOSE_P = _set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul listing pre")
ENDED_IN_SCOPE = CLOSE_P - {"p"} | {"button"}
SPECIAL = CLOSE_P | HEADINGS | VOID | _set("applet body button caption colgroup dd dt form frameset head html iframe li marquee noembed noframes noscript object plaintext script select style table tbody td template textarea tfoot th thead title tr xmp")
SCOPE = _set("applet caption html table td th marquee object template")
IN_HEAD = _set("base basefont bgsound link meta noframes script style template title")
RAW = _set("iframe noembed noframes noscript xmp")
IMPLIED = _set("dd dt li optgroup option p rb rp rt rtc")
BODIES, CELLS = _set("tbody tfoot thead"), _set("td th")
TABLE_PARTS = BODIES | CELLS | _set("caption col colgroup tr")
IGNORED_IN_BODY = TABLE_PARTS | {"frame", "frameset", "head"}
BREAK_OUT = CLOSE_P | HEADINGS | _set("b big body br code dd dt em embed head hr i img li meta nobr ruby s small span strong strike sub sup table tt u var")
#: Elements of text with references; newer tokenizers of the standard library read them so themselves.
TEXT = frozenset() if hasattr(HTMLParser, "RCDATA_CONTENT_ELEMENTS") else _set("textarea title")
#: Elements whose text isn't the page's.
UNREAD = frozenset(("script", "style", "template"))
#: What is opened below so many elements stays empty, and what follows goes beside it: a page's work stays in proportion to its length.
DEEPEST = 512
#: No token passes through more modes than there are.
MODES = 20
_BLANK = re.compile(r"[\t\n\f\r ]*")


class Node:
    """``own``: a start tag of the page made it; others are implied, or copies of formatting that goes on."""

    __slots__ = ("tag", "attrs", "children", "parent", "foreign", "own")

    def __init__(self, tag: str, attrs: dict[str, str], foreign: bool = False, own: bool = False):
        self.tag, self.attrs, self.foreign, self.own = tag, attrs, foreign, own
        self.children: list[Node | str] = []
        self.parent: Node | None = None


class Found(Exception):
    """What a page is read for can't change by what follows."""


class Builder(HTMLParser):
    """``root`` is the page's html element once ``close`` has run.

    With ``until``, a heading's tag, `Found` is raised when the first such element of the page is settled: one is made, none is
    open, and no table is, before which elements could still be put. All that follows goes behind it then.
    """

    def __init__(self, until: str | None = None):
        super().__init__(convert_charrefs=True)
        self.until, self.met = until, False
        self.root: Node | None = None
        self.stack: list[Node] = []
        self.active: list[Node | None] = []  # open formatting, None where a cell, caption or the like begins
        self.mode, self.quirks, self.foster, self.skip_newline = "before html", True, False, False
        self.head: Node | None = None
        self.form: Node | None = None
        self.token: str | None = None  # the start tag that has no element yet

    def updatepos(self, i: int, j: int) -> int:
        """Lines aren't counted: nobody asks where a tag stood."""
        return j

    # -- where nodes go

    @property
    def current(self) -> Node:
        return self.stack[-1]

    def place(self, item: Node | str, target: Node | None = None) -> None:
        """Append to ``target``; while a table can't hold it, put it before the table."""
        target = target or self.current
        before = None
        if self.foster and target.tag in BODIES | {"table", "tr"}:
            k = next((k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k].tag == "table"), 0)
            table = self.stack[k]
            target, before = (table.parent, table) if table.parent and k else (self.stack[max(0, k - 1)], None)
        at = len(target.children)
        if before is not None:
            at -= 1
            while target.children[at] is not before:
                at -= 1
        if isinstance(item, Node):
            item.parent = target
        elif at and isinstance(target.children[at - 1], str):
            target.children[at - 1] += item
            return
        target.children.insert(at, item)

    def detach(self, node: Node) -> None:
        if node.parent:
            held = node.parent.children
            held.pop(next(k for k in range(len(held) - 1, -1, -1) if held[k] is node))
            node.parent = None

    def insert(self, tag: str, attrs: dict[str, str], foreign: bool = False) -> Node:
        node = Node(tag, attrs, foreign, tag == self.token)
        if node.own:
            self.token = None
        self.place(node)
        self.met |= tag == self.until
        if (foreign or tag not in VOID) and len(self.stack) < DEEPEST:
            self.stack.append(node)
        return node

    # -- the stack of open elements

    def scope(self, tags: frozenset[str] | set[str], more: frozenset[str] | set[str] = frozenset(), only: frozenset[str] | set[str] | None = None) -> bool:
        stop = only if only is not None else SCOPE | more
        for node in reversed(self.stack):
            if node.tag in tags and not node.foreign:
                return True
            if node.tag in stop:
                return False
        return False

    def table_scope(self, *tags: str) -> bool:
        return self.scope(set(tags), only={"html", "table", "template"})

    def pop(self) -> None:
        if len(self.stack) > 1:
            self.stack.pop()

    def pop_until(self, tags: frozenset[str] | set[str]) -> None:
        while len(self.stack) > 1 and self.stack.pop().tag not in tags:
            pass

    def clear_to(self, tags: frozenset[str] | set[str]) -> None:
        while len(self.stack) > 1 and self.current.tag not in tags | {"html", "template"}:
            self.pop()

    def imply_ends(self, but: str = "") -> None:
        while self.current.tag in IMPLIED and self.current.tag != but:
            self.pop()

    def close_p(self) -> None:
        if self.scope({"p"}, {"button"}):
            self.imply_ends("p")
            self.pop_until({"p"})

    # -- formatting that goes on across blocks

    def to_marker(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def format(self, tag: str, attrs: dict[str, str]) -> None:
        same = []
        for k in range(len(self.active) - 1, -1, -1):
            if self.active[k] is None:
                break
            if self.active[k].tag == tag and self.active[k].attrs == attrs:
                same.append(k)
        if len(same) >= 3:
            del self.active[same[-1]]
        self.active.append(self.insert(tag, attrs))

    def reconstruct(self) -> None:
        k = len(self.active)
        while k and self.active[k - 1] is not None and not any(n is self.active[k - 1] for n in reversed(self.stack)):
            k -= 1
        token, self.token = self.token, None
        for k in range(k, len(self.active)):
            self.active[k] = self.insert(self.active[k].tag, dict(self.active[k].attrs))
        self.token = token

    def adopt(self, tag: str) -> None:
        """The standard's adoption agency: an end tag of formatting that blocks were opened in."""
        if self.current.tag == tag and not any(n is self.current for n in self.active):
            self.pop()
            return
        for _ in range(8):
            chosen = None
            for node in reversed(self.active):
                if node is None:
                    break
                if node.tag == tag:
                    chosen = node
                    break
            if chosen is None:
                return self.other_end(tag)
            if chosen not in self.stack:
                self.active.remove(chosen)
                return
            if not self.scope({tag}):
                return
            at = self.stack.index(chosen)
            block = next((k for k in range(at + 1, len(self.stack)) if self.stack[k].tag in SPECIAL), None)
            if block is None:
                del self.stack[at:]
                self.active.remove(chosen)
                return
            furthest, above, mark = self.stack[block], self.stack[at - 1], self.active.index(chosen)
            last, k, passed = furthest, block, 0
            while True:
                k -= 1
                node = self.stack[k]
                if node is chosen:
                    break
                passed += 1
                if node in self.active and passed > 3:
                    if self.active.index(node) < mark:
                        mark -= 1
                    self.active.remove(node)
                if node not in self.active:
                    del self.stack[k]
                    continue
                copy = Node(node.tag, dict(node.attrs))
                place = self.active.index(node)
                self.active[place] = self.stack[k] = copy
                if last is furthest:
                    mark = place + 1
                self.detach(last)
                self.place(last, copy)
                last = copy
            self.detach(last)
            foster, self.foster = self.foster, True
            self.place(last, above)
            self.foster = foster
            copy = Node(chosen.tag, dict(chosen.attrs))
            copy.children, furthest.children = furthest.children, []
            for child in copy.children:
                if isinstance(child, Node):
                    child.parent = copy
            self.place(copy, furthest)
            old = self.active.index(chosen)
            self.active.insert(mark, copy)
            del self.active[old + (old >= mark)]
            self.stack.remove(chosen)
            self.stack.insert(self.stack.index(furthest) + 1, copy)

    def other_end(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                self.imply_ends(tag)
                del self.stack[k:]
                return
            if self.stack[k].tag in SPECIAL and not self.stack[k].foreign:
                return

    # -- tokens

    def handle_decl(self, decl: str) -> None:
        if self.mode == "before html":
            self.quirks = not re.match(r"(?i)doctype\s+html\b(?!\s+public\s+[\"']-//(w3c//dtd html [34]|ietf))", decl)

    def handle_starttag(self, tag: str, given: list[tuple[str, str | None]]) -> None:
        self.open(tag, given, False)
        self.settle()

    def handle_startendtag(self, tag: str, given: list[tuple[str, str | None]]) -> None:
        self.open(tag, given, True)
        self.settle()

    def settle(self) -> None:
        if self.met and not any(n.tag in (self.until, "table") for n in self.stack):
            raise Found

    def open(self, tag: str, given: list[tuple[str, str | None]], closed: bool) -> None:
        attrs: dict[str, str] = {}
        for name, value in given:
            attrs.setdefault(name, value or "")
        self.skip_newline, self.token = False, tag
        if self.stack and self.current.foreign:
            if tag not in BREAK_OUT and not (tag == "font" and attrs.keys() & {"color", "face", "size"}):
                self.insert(tag, attrs, True)
                if closed:
                    self.pop()
                return
            while self.current.foreign:
                self.pop()
        for _ in range(MODES):
            if not self.start(tag, attrs):
                break
        self.token = None
        if self.stack and closed and self.current.foreign and self.current.tag == tag:
            self.pop()
        if tag in RAW | TEXT and self.stack and self.current.tag == tag and not self.current.foreign:
            self.set_cdata_mode(tag)

    def handle_endtag(self, tag: str) -> None:
        self.skip_newline = False
        if self.stack and self.current.foreign:
            for k in range(len(self.stack) - 1, 0, -1):
                if not self.stack[k].foreign:
                    break
                if self.stack[k].tag == tag:
                    del self.stack[k:]
                    return
        for _ in range(MODES):
            if not self.end(tag):
                break
        self.settle()

    def handle_data(self, data: str) -> None:
        if self.cdata_elem in TEXT:
            data = unescape(data)
        if self.skip_newline and data.startswith("\n"):
            data = data[1:]
        self.skip_newline = False
        blank = _BLANK.match(data).end()
        if self.mode in ("before html", "before head"):
            data = data[blank:]
        elif self.mode in ("in head", "after head") and self.current.tag not in ("script", "style", "title", "noscript", "noframes", "template") and blank:
            self.place(data[:blank])
            data = data[blank:]
        if not data:
            return
        if self.mode in ("before html", "before head", "after head") or self.mode == "in head" and self.current.tag == "head":
            self.begin_body()
        if self.mode == "after body" and blank < len(data):
            self.mode = "in body"
        if self.mode == "in column group" and blank < len(data):
            if blank:
                self.place(data[:blank])
            data = data[blank:]
            self.pop()
            self.mode = "in table"
        if self.current.tag in BODIES | {"table", "tr"}:
            if blank == len(data):
                return self.place(data)
            self.foster = True
            self.reconstruct()
            self.place(data)
            self.foster = False
            return
        if self.mode not in ("in head", "in select", "in column group") and not self.current.foreign and self.current.tag not in RAW and self.current.tag not in ("script", "style", "textarea", "title"):
            self.reconstruct()
        self.place(data)

    def close(self) -> None:
        super().close()
        if self.rawdata and self.cdata_elem:
            left, self.rawdata = self.rawdata, ""
            self.handle_data(left)
        if self.mode in ("before html", "before head", "in head", "after head"):
            self.begin_body()

    # -- modes; a step returns True when its token is to be processed again

    def begin_html(self, attrs: dict[str, str] | None = None) -> None:
        self.root = Node("html", attrs or {}, own=self.token == "html")
        self.stack = [self.root]
        self.mode = "before head"

    def begin_head(self, attrs: dict[str, str] | None = None) -> None:
        if self.mode == "before html":
            self.begin_html()
        self.head = self.insert("head", attrs or {})
        self.mode = "in head"

    def end_head(self) -> None:
        if self.mode in ("before html", "before head"):
            self.begin_head()
        if self.mode == "in head":
            del self.stack[1:]
            self.mode = "after head"

    def begin_body(self, attrs: dict[str, str] | None = None) -> None:
        self.end_head()
        del self.stack[1:]
        self.insert("body", attrs or {})
        self.mode = "in body"

    def start(self, tag: str, attrs: dict[str, str]) -> bool:
        if tag == "html":
            if self.mode == "before html":
                self.begin_html(attrs)
            else:
                self.root.attrs = attrs | self.root.attrs
            return False
        if self.mode in ("before html", "before head", "in head", "after head"):
            return self.start_outside(tag, attrs)
        if self.mode == "after body":
            self.mode = "in body"
        if self.mode == "in select":
            return self.start_in_select(tag, attrs)
        if self.mode in ("in table", "in table body", "in row", "in cell", "in caption", "in column group"):
            return self.start_in_table(tag, attrs)
        return self.start_in_body(tag, attrs)

    def start_outside(self, tag: str, attrs: dict[str, str]) -> bool:
        if tag == "head":
            if self.mode in ("before html", "before head"):
                self.begin_head(attrs)
            return False
        if tag in IN_HEAD or tag == "noscript" and self.mode != "after head":
            if self.mode == "after head":
                self.stack.append(self.head)
                self.insert(tag, attrs)
                self.stack.remove(self.head)
                return False
            if self.mode != "in head":
                self.begin_head()
            self.insert(tag, attrs)
            return False
        if tag == "body":
            self.begin_body(attrs)
            return False
        self.begin_body()
        return True

    def start_in_body(self, tag: str, attrs: dict[str, str]) -> bool:
        if tag == "body":
            body = next((c for c in self.root.children if isinstance(c, Node) and c.tag == "body"), None)
            if body:
                body.attrs = attrs | body.attrs
        elif tag in IGNORED_IN_BODY:
            pass
        elif tag in IN_HEAD:
            self.insert(tag, attrs)
            if tag == "template":
                self.active.append(None)
        elif tag in CLOSE_P or tag in ("plaintext", "hr", "xmp"):
            self.close_p()
            self.insert(tag, attrs)
            self.skip_newline = tag in ("pre", "listing")
        elif tag in HEADINGS:
            self.close_p()
            if self.current.tag in HEADINGS:
                self.pop()
            self.insert(tag, attrs)
        elif tag == "form":
            if self.form is None:
                self.close_p()
                self.form = self.insert(tag, attrs)
        elif tag in ("li", "dd", "dt"):
            ends = {"li"} if tag == "li" else {"dd", "dt"}
            for node in reversed(self.stack):
                if node.tag in ends:
                    self.imply_ends(node.tag)
                    self.pop_until({node.tag})
                    break
                if node.tag in SPECIAL and node.tag not in ("address", "div", "p"):
                    break
            self.close_p()
            self.insert(tag, attrs)
        elif tag == "button":
            if self.scope({"button"}):
                self.imply_ends()
                self.pop_until({"button"})
            self.reconstruct()
            self.insert(tag, attrs)
        elif tag == "a":
            for node in reversed(self.active):
                if node is None:
                    break
                if node.tag == "a":
                    self.adopt("a")
                    self.active = [n for n in self.active if n is not node]
                    self.stack = [n for n in self.stack if n is not node]
                    break
            self.reconstruct()
            self.format(tag, attrs)
        elif tag in FORMATTING:
            self.reconstruct()
            if tag == "nobr" and self.scope({"nobr"}):
                self.adopt("nobr")
                self.reconstruct()
            self.format(tag, attrs)
        elif tag in ("applet", "marquee", "object"):
            self.reconstruct()
            self.insert(tag, attrs)
            self.active.append(None)
        elif tag == "table":
            if not self.quirks:
                self.close_p()
            self.insert(tag, attrs)
            self.mode = "in table"
        elif tag == "image":
            return self.start_in_body("img", attrs)
        elif tag in ("param", "source", "track", "iframe", "noembed", "noscript"):
            self.insert(tag, attrs)
        elif tag == "textarea":
            self.insert(tag, attrs)
            self.skip_newline = True
        elif tag == "select":
            self.reconstruct()
            self.insert(tag, attrs)
            self.mode = "in select"
        elif tag in ("optgroup", "option"):
            if self.current.tag == "option":
                self.pop()
            self.reconstruct()
            self.insert(tag, attrs)
        elif tag in ("rb", "rtc", "rp", "rt"):
            if self.scope({"ruby"}):
                self.imply_ends("rtc" if tag in ("rp", "rt") else "")
            self.insert(tag, attrs)
        else:
            self.reconstruct()
            self.insert(tag, attrs, tag in ("math", "svg"))
        return False

    def start_in_table(self, tag: str, attrs: dict[str, str]) -> bool:
        mode = self.mode
        if mode == "in cell":
            if tag not in TABLE_PARTS:
                return self.start_in_body(tag, attrs)
            if self.table_scope("td", "th"):
                self.close_cell()
                return True
            return False
        if mode == "in caption":
            if tag not in TABLE_PARTS:
                return self.start_in_body(tag, attrs)
            return self.end("caption") or self.mode != mode
        if mode == "in column group":
            if tag == "col":
                self.insert(tag, attrs)
                return False
            self.pop()
            self.mode = "in table"
            return True
        if mode == "in row":
            if tag in CELLS:
                self.clear_to({"tr"})
                self.insert(tag, attrs)
                self.mode = "in cell"
                self.active.append(None)
                return False
            if tag in TABLE_PARTS:
                self.end("tr")
                return self.mode != mode
        elif mode == "in table body":
            if tag in CELLS or tag == "tr":
                self.clear_to(BODIES)
                self.insert("tr", attrs if tag == "tr" else {})
                self.mode = "in row"
                return tag != "tr"
            if tag in TABLE_PARTS:
                if not self.table_scope(*BODIES):
                    return False
                self.clear_to(BODIES)
                self.pop()
                self.mode = "in table"
                return True
        elif tag in TABLE_PARTS:
            self.clear_to({"table"})
            if tag == "caption":
                self.active.append(None)
                self.insert(tag, attrs)
                self.mode = "in caption"
            elif tag in ("col", "colgroup"):
                self.insert("colgroup", attrs if tag == "colgroup" else {})
                self.mode = "in column group"
                return tag == "col"
            else:
                self.insert(tag if tag in BODIES else "tbody", attrs if tag in BODIES else {})
                self.mode = "in table body"
                return tag not in BODIES
            return False
        if tag == "table":
            return self.end("table") or self.mode != mode
        if tag in ("style", "script", "template") or tag == "input" and attrs.get("type", "").lower() == "hidden":
            self.insert(tag, attrs)
            return False
        if tag == "form":
            if self.form is None:
                self.form = self.insert(tag, attrs)
                self.pop()
            return False
        self.foster = True
        again = self.start_in_body(tag, attrs)
        self.foster = False
        return again

    def start_in_select(self, tag: str, attrs: dict[str, str]) -> bool:
        if tag in ("option", "optgroup", "hr"):
            if self.current.tag == "option":
                self.pop()
            if tag != "option" and self.current.tag == "optgroup":
                self.pop()
            self.insert(tag, attrs)
        elif tag in ("script", "template"):
            self.insert(tag, attrs)
        elif tag in TABLE_PARTS and self.scope({"table"}, only={"html", "template"}) or tag in ("select", "input", "keygen", "textarea", "table"):
            self.end("select")
            return tag != "select"
        return False

    def close_cell(self) -> None:
        self.imply_ends()
        self.pop_until(CELLS)
        self.to_marker()
        self.mode = "in row"

    def pick_mode(self) -> None:
        """The mode that the open elements call for."""
        names = {"td": "in cell", "th": "in cell", "tr": "in row", "tbody": "in table body", "thead": "in table body", "tfoot": "in table body", "caption": "in caption", "colgroup": "in column group", "table": "in table", "select": "in select"}
        self.mode = next((names[n.tag] for n in reversed(self.stack) if n.tag in names), "in body")

    def end(self, tag: str) -> bool:
        mode = self.mode
        if mode in ("before html", "before head", "in head", "after head"):
            if mode == "in head" and len(self.stack) > 2:
                if self.current.tag == tag:
                    self.pop()
            elif tag == "head":
                self.end_head()
            elif mode == "after head" and self.stack and self.current.tag == tag and len(self.stack) > 1:
                self.pop()
            elif tag in ("body", "html", "br"):
                self.begin_body()
                return True
            return False
        if mode == "in select":
            if tag == "optgroup" and self.current.tag == "option" and self.stack[-2].tag == "optgroup":
                self.pop()
            if tag in ("option", "optgroup", "script", "template"):
                if self.current.tag == tag:
                    self.pop()
            elif tag == "select" or tag in TABLE_PARTS | {"table"} and self.table_scope(tag):
                if self.scope({"select"}, only={"html", "table"}):
                    self.pop_until({"select"})
                self.pick_mode()
                return tag != "select"
            return False
        if mode == "in cell":
            if tag in CELLS:
                if self.table_scope(tag):
                    self.close_cell()
                return False
            if tag in BODIES | {"table", "tr"}:
                if self.table_scope(tag):
                    self.close_cell()
                    return True
                return False
            return tag not in ("body", "caption", "col", "colgroup", "html") and self.end_in_body(tag)
        if mode == "in caption":
            if tag in ("caption", "table"):
                if not self.table_scope("caption"):
                    return False
                self.imply_ends()
                self.pop_until({"caption"})
                self.to_marker()
                self.mode = "in table"
                return tag == "table"
            return tag not in TABLE_PARTS | {"body", "html"} and self.end_in_body(tag)
        if mode == "in column group":
            if tag == "col":
                return False
            self.pop()
            self.mode = "in table"
            return tag != "colgroup"
        if mode == "in row":
            if tag == "tr" or tag in BODIES | {"table"}:
                if self.table_scope("tr") and self.table_scope(tag):
                    self.clear_to({"tr"})
                    self.pop()
                    self.mode = "in table body"
                    return tag != "tr"
                return False
        if mode == "in table body":
            if tag in BODIES | {"table"}:
                if self.table_scope(*BODIES) and self.table_scope(tag):
                    self.clear_to(BODIES)
                    self.pop()
                    self.mode = "in table"
                    return tag == "table"
                return False
        if mode in ("in table", "in row", "in table body"):
            if tag == "table" and mode == "in table":
                if self.table_scope("table"):
                    self.pop_until({"table"})
                    self.pick_mode()
                return False
            if tag in TABLE_PARTS | {"body", "html"}:
                return False
            self.foster = True
            again = self.end_in_body(tag)
            self.foster = False
            return again
        return self.end_in_body(tag)

    def end_in_body(self, tag: str) -> bool:
        if tag in ("body", "html"):
            if self.mode == "in body" and self.scope({"body"}):
                self.mode = "after body"
        elif tag in ENDED_IN_SCOPE:
            if self.scope({tag}):
                self.imply_ends()
                self.pop_until({tag})
        elif tag == "form":
            node, self.form = self.form, None
            if node and node in self.stack and self.scope({"form"}):
                self.imply_ends()
                self.stack.remove(node)
        elif tag == "p":
            if not self.scope({"p"}, {"button"}):
                self.insert("p", {})
            self.close_p()
        elif tag in ("li", "dd", "dt"):
            if self.scope({tag}, {"ol", "ul"} if tag == "li" else frozenset()):
                self.imply_ends(tag)
                self.pop_until({tag})
        elif tag in HEADINGS:
            if self.scope(HEADINGS):
                self.imply_ends()
                self.pop_until(HEADINGS)
        elif tag in FORMATTING:
            self.adopt(tag)
        elif tag in ("applet", "marquee", "object", "template"):
            if self.scope({tag}):
                self.imply_ends()
                self.pop_until({tag})
                self.to_marker()
        elif tag == "br":
            self.start_in_body("br", {})
        else:
            self.other_end(tag)
        return False


def build(html: str, until: str | None = None) -> Node:
    """The html element of a page; every page has one, with a head and a body. With ``until``, a heading's tag, its tree up to where the first such element is settled."""
    builder = Builder(until)
    try:
        builder.feed(html.replace("\r\n", "\n").replace("\r", "\n"))
        builder.close()
    except Found:
        pass
    return builder.root


def first_text(html: str, tag: str) -> str | None:
    """The text of a page's first heading of ``tag``, its pieces joined by blanks, without that of scripts, styles and templates; null if there is none."""
    below = [build(html, tag)]
    while below:
        node = below.pop()
        if node.tag == tag:
            break
        below += [c for c in reversed(node.children) if isinstance(c, Node)]
    else:
        return None
    above, below, texts = node, [node], []
    while above:
        if above.tag in UNREAD:
            return ""
        above = above.parent
    while below:
        node = below.pop()
        if isinstance(node, str):
            texts.append(node)
        elif node.tag not in UNREAD:
            below += reversed(node.children)
    return " ".join(texts)
