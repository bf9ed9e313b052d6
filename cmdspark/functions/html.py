"""Fields of a manual page from its HTML in one pass: a stack of open elements and the texts of the fields that they belong to."""

from __future__ import annotations

from html.parser import HTMLParser

PAGE = (
    "struct<toc_path:string,title:string,short:string,paragraphs:array<string>,syntax_graph:array<string>,"
    "arguments:array<struct<dt:string,dd:string>>,first_dl:array<struct<dt:string,dd:string>>,first_ul:array<string>,"
    "description:string,examples_graph:string,examples_flat:string,hrefs:array<string>,error:string>"
)
#: Elements without content, and those whose start ends an open one of the same set (implied end tags).
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Elements that an implied end doesn't reach out of, and those whose text belongs to no field.
CLOSED = frozenset("ul ol dl table div article section nav body".split())
DROPPED = frozenset(("script", "style"))


class Text:
    """Text nodes of an element, as they come."""

    __slots__ = ("nodes",)

    def __init__(self):
        self.nodes: list[str] = []

    def joined(self, sep: str = " ") -> str:
        """Stripped text nodes joined; blank ones left out."""
        return sep.join(filter(None, (s.strip() for s in self.nodes)))


class Section:
    """What is kept of a section while it is open: its text, its first ``pre``, its terms and the first lists of terms and of items."""

    def __init__(self, itself_pre: bool):
        self.text = Text()
        self.pre = self.text if itself_pre else None
        self.terms: list[Term] = []
        self.first_terms: list[Term] = []
        self.items: list[Text] = []
        self.lists: dict[str, Element] = {}  # the first dl and ul


class Term:
    """A ``dt`` with the next ``dd`` among its later siblings, which several terms may share."""

    __slots__ = ("term", "text")

    def __init__(self):
        self.term, self.text = Text(), None

    def pair(self, raw: bool) -> dict:
        return {"dt": "".join(self.term.nodes).strip() if raw else self.term.joined(), "dd": self.text.joined() if self.text else ""}


class Element:
    """An open element: the texts that its text nodes go to, the sections and first lists that it lies in, and terms among its children that have no ``dd`` yet."""

    __slots__ = ("tag", "texts", "sections", "waiting", "dropped", "nav")

    def __init__(self, tag: str, parent: Element | None):
        self.tag = tag
        self.texts: list[Text] = list(parent.texts) if parent else []
        self.sections: list[tuple[Section, frozenset[str]]] = parent.sections if parent else []
        self.dropped: bool = parent.dropped if parent else False
        self.nav: list[list[str]] = parent.nav if parent else []
        self.waiting: list[Term] = []


#: The sections of a page; each is the first ``div`` whose class contains ``name-section``, else the first element that has the class ``name`` itself.
SECTIONS = ("syntax", "arguments", "options", "description", "example")


class Page(HTMLParser):
    """The stack machine. Scripts, styles and navigation give no text; links of navigation are read as they pass."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = [Element("", None)]
        self.toc_path: str | None = None
        self.seen_html = False
        self.title: Text | None = None
        self.short: Text | None = None
        self.paragraphs: list[Text] = []
        self.by_class: dict[str, Section] = {}
        self.by_name: dict[str, Section] = {}
        self.navs: list[tuple[bool, list[str]]] = []

    def section(self, name: str) -> Section | None:
        return self.by_class.get(name) or self.by_name.get(name)

    def handle_starttag(self, tag, attrs):
        self._imply_ends(tag)
        parent, attrs = self.stack[-1], {k: v or "" for k, v in attrs}
        element = Element(tag, parent)
        if tag == "nav":
            links: list[str] = []
            self.navs.append(("related-links" in attrs.get("class", "").split(), links))
            element.nav = [*parent.nav, links]
            element.dropped = True
        elif tag in DROPPED:
            element.dropped = True
        if tag == "a" and attrs.get("href"):
            for links in element.nav:
                links.append(attrs["href"])
        if element.dropped:
            element.texts = []
        else:
            self._open_fields(element, parent, attrs)
        if tag not in VOID:
            self.stack.append(element)

    def _imply_ends(self, tag: str) -> None:
        ends = ENDS.get(tag, set()) | ({"p"} if tag in BLOCKS else set())
        for k in range(len(self.stack) - 1, 0, -1):
            if not ends or self.stack[k].tag in CLOSED:
                return
            if self.stack[k].tag in ends:
                del self.stack[k:]
                return

    def _open_fields(self, element: Element, parent: Element, attrs: dict[str, str]) -> None:
        tag, classes = element.tag, attrs.get("class", "")
        if tag == "html" and not self.seen_html:
            self.seen_html, self.toc_path = True, attrs.get("data-mc-toc-path")
        if tag == "h1" and self.title is None:
            element.texts.append(self._text("title"))
        if tag == "div" and "short-description" in classes and self.short is None:
            element.texts.append(self._text("short"))
        if tag == "p":
            self.paragraphs.append(Text())
            element.texts.append(self.paragraphs[-1])
        self._in_sections(element, parent)
        if classes:
            names = classes.split()
            for name in SECTIONS:
                for known, fits in ((self.by_class, tag == "div" and f"{name}-section" in classes), (self.by_name, name in names)):
                    if fits and name not in known:
                        known[name] = Section(tag == "pre")
                        element.texts.append(known[name].text)
                        element.sections = [*element.sections, (known[name], frozenset())]

    def _text(self, field: str) -> Text:
        setattr(self, field, Text())
        return getattr(self, field)

    def _in_sections(self, element: Element, parent: Element) -> None:
        """Fields inside the sections that are open."""
        tag, inside = element.tag, []
        if tag == "dd":
            definition = Text()
            for term in parent.waiting:
                term.text = definition
            if parent.waiting:
                element.texts.append(definition)
            parent.waiting = []
        for section, lists in parent.sections:
            if tag == "pre" and section.pre is None:
                section.pre = Text()
                element.texts.append(section.pre)
            if tag in ("dl", "ul") and tag not in section.lists:
                section.lists[tag] = element
                lists = lists | {tag}
            if tag == "dt":
                term = Term()
                element.texts.append(term.term)
                parent.waiting.append(term)
                section.terms.append(term)
                if "dl" in lists:
                    section.first_terms.append(term)
            if tag == "li" and "ul" in lists:
                section.items.append(Text())
                element.texts.append(section.items[-1])
            inside.append((section, lists))
        element.sections = inside

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                del self.stack[k:]
                return

    def handle_data(self, data):
        for text in self.stack[-1].texts:
            text.nodes.append(data)


def page_fields(html: str | None) -> dict:
    """M1, M4 to M12 of one page. ``error`` says why a page could not be read; others are not affected."""
    out: dict = {k: None for k in ("toc_path", "title", "short", "description", "examples_graph", "examples_flat", "error")}
    out |= {k: [] for k in ("paragraphs", "syntax_graph", "arguments", "first_dl", "first_ul", "hrefs")}
    if html is None:
        return out | {"error": "no page"}
    page = Page()
    try:
        page.feed(html)
        page.close()
    except (ValueError, AssertionError, RecursionError) as e:
        return out | {"error": f"{type(e).__name__}: {e}"}
    related = [links for own, links in page.navs if own] or [links for _, links in page.navs]
    out |= {"hrefs": [h for links in related for h in links], "toc_path": page.toc_path, "title": page.title.joined() if page.title else "", "short": page.short.joined() if page.short else ""}
    out["paragraphs"] = [p.joined() for p in page.paragraphs]
    syntax, arguments, described, examples = page.section("syntax"), page.section("arguments") or page.section("options"), page.section("description"), page.section("example")
    if syntax and syntax.pre:
        out["syntax_graph"] = syntax.pre.nodes
    if arguments:
        out["arguments"] = [t.pair(raw=True) for t in arguments.terms]
        out["first_dl"], out["first_ul"] = [t.pair(raw=False) for t in arguments.first_terms], [x.joined() for x in arguments.items]
    out["description"] = described.text.joined() if described else ""
    if examples:
        out["examples_graph"] = examples.text.joined("\n")
        out["examples_flat"] = examples.pre.joined("\n") if examples.pre else ""
    return out


def read_pages(pages: list[str | None]) -> list[dict]:
    return [page_fields(x) for x in pages]
