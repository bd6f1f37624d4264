"""Main text of web pages: a template for each host from classes of tokens with equal occurrence vectors."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.common import stage

#: A class needs so many tokens, and must occur on so many pages and on such a share of the host's pages.
LEAST_TOKENS, LEAST_PAGES, LEAST_SHARE = 2, 3, 0.5

#: Modulus of the products that stand for occurrence vectors.
PRIME = (1 << 31) - 1

#: Elements without content of their own, those whose content is never shown as text, and inline ones.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|iframe|svg|math|object|select|title"
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp "
                   "small span strike strong sub sup time tt u var wbr".split())

#: Elements, roles and words in class or id that mark what is not the article.
ASIDE = frozenset("nav aside footer form button dialog menu head".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
_ASIDE = (
    r"(?:ad|ads|adv|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|promotion|"
    r"nav|navbar|navigation|menu|breadcrumb|breadcrumbs|sidebar|side|aside|widget|footer|cookie|cookies|consent|gdpr|"
    r"notice|notices|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|"
    r"recommended|comment|comments|disqus|reply|replies|respond|pagination|pager|toolbar|skip|masthead|copyright|"
    r"legal|disclaimer)")

#: A class or id counts as a whole: such a word, or several of them and words of place in a row (``site-footer``).
_PLACE = r"(?:site|page|main|global|top|bottom|left|right|primary|secondary|box|block|bar|list)"
ASIDE_WORDS = re.compile(rf"(?<!\S)(?:{_PLACE}[_-])*{_ASIDE}(?:[_-](?:{_PLACE}|{_ASIDE}))*(?!\S)")

#: Words that count as a part of a name too (``post-comments``, ``ad-slot``), unless another part says that the name tells
#: of the layout or of what is absent (``has-sidebar``, ``side-by-side``).
ASIDE_PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation "
    "menu breadcrumb breadcrumbs sidebar widget widgets footer cookie cookies consent gdpr popup modal newsletter subscribe "
    "signup share sharing social related recommended comment comments commentlist commentform comentarios commentaires "
    "kommentare disqus respond replies pagination pager masthead".split())
LAYOUT_PARTS = frozenset("has no not with without by is hide hidden off free".split())
_PARTS = re.compile(r"[^\W_]+")


def says_aside(label: str) -> bool:
    """Whether a class or id among the names of ``label`` marks what is not the article."""
    if ASIDE_WORDS.search(label):
        return True
    for name in label.split():
        parts = set(_PARTS.findall(name))
        if not parts.isdisjoint(ASIDE_PARTS) and parts.isdisjoint(LAYOUT_PARTS):
            return True
    return False


#: Elements that end an open p, and those that end an open element of their own kind.
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr "
                   "main nav ol p pre section table ul".split())
ENDS_OWN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:svg|math)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*/>"
    rf"|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>"
    r"|<[!?][^>]*>", re.DOTALL | re.IGNORECASE)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_BLANKS = re.compile(r"\s+")


class Element:
    """An open element: its path, whether it is part of an article, and what sets it aside.

    ``aside`` holds for what its tag, its role or an ancestor's says, ``label`` for what
    its own class or id says.
    """

    __slots__ = ("parent", "name", "path", "main", "article", "aside", "label")

    def __init__(self, parent, name, path, main, article, aside, label):
        self.parent, self.name, self.path, self.main = parent, name, path, main
        self.article, self.aside, self.label = article, aside, label

    def around(self) -> Iterator[Element]:
        """The element and those around it."""
        element = self
        while element is not None:
            yield element
            element = element.parent


def _open(parent: Element, name: str, attributes: str) -> Element:
    marks = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(attributes)}
    label = f"{marks.get('class', '')} {marks.get('id', '')}".strip()
    article = parent.article or name in ("article", "main") or marks.get("role") in ("main", "article") or \
        "articlebody" in marks.get("itemprop", "")
    aside = (parent.aside or name in ASIDE or marks.get("role") in ASIDE_ROLES
             or (name == "header" and not parent.article))
    named = name not in ("html", "body", "article", "main") and bool(label) and says_aside(label)
    main = parent.main or name == "main" or marks.get("role") == "main"
    return Element(parent, name, f"{parent.path}/{name}.{label}" if label else f"{parent.path}/{name}", main, article,
                   aside, named)


def tokens(page: str) -> Iterator[tuple[str, str, Element, str]]:
    """(kind, role, element, text) in page order: kind is ``open``, ``close`` or ``text``.

    A token's role is what it is and where: its tag, or its text, with the path of
    elements around it, so that equal tags in different places differ. Inline tags
    make no path. Elements left open are closed by what may not stand inside them.
    """
    stack = [Element(None, "", "", False, False, False, False)]
    at = 0

    def text(raw):
        shown = html.unescape(raw)
        return ("text", f"{stack[-1].path}|{_BLANKS.sub(' ', shown).strip()}", stack[-1], shown)

    for found in _TOKEN.finditer(page):
        if found.start() > at:
            yield text(page[at:found.start()])
        at = found.end()
        name = (found[3] or "").lower()
        if not name:
            continue
        if name in INLINE:
            if name == "br":
                yield "text", "", stack[-1], " "
            continue
        if found[2]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), 0)
            if depth:
                yield "close", f"/{stack[depth].path}", stack[depth], ""
                del stack[depth:]
            continue
        if name in ENDS_P and stack[-1].name == "p":
            stack.pop()
        elif stack[-1].name in ENDS_OWN.get(name, ()):
            stack.pop()
        element = _open(stack[-1], name, found[4] or "")
        yield "open", element.path, element, ""
        if name not in VOID and not (found[4] or "").endswith("/"):
            stack.append(element)
    if at < len(page):
        yield text(page[at:])


def _role(kind: str, role: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{kind}{role}") - (1 << 63)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host and token role: pages, occurrences, and two weighted sums that stand for the occurrence vector.

    The vector of a role has its count on each page. Its products with two fixed
    random vectors (one number per page) are kept instead, modulo a prime of 31 bits, so that
    sums over thousands of millions of tasks fit; they add up over any split of the pages, and
    equal vectors have equal products.
    """
    for batch in batches:
        sums: dict[tuple[str, int], list[int]] = defaultdict(lambda: [0, 0, 0, 0])
        for host, key, page in zip(*(batch.column(c).to_pylist() for c in ("host", "key", "html")), strict=True):
            counts: dict[int, int] = defaultdict(int)
            for kind, role, _, shown in tokens(page or ""):
                if kind != "text" or shown.strip():
                    counts[_role(kind, role)] += 1
            one, two = key & 0x7FFFFFFF, (key >> 32) & 0x7FFFFFFF
            for role, n in counts.items():
                row = sums[host, role]
                row[0] += 1
                row[1] += n
                row[2] = (row[2] + n * one) % PRIME
                row[3] = (row[3] + n * two) % PRIME
        rows = [(h, r, *v) for (h, r), v in sums.items()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = [pa.string(), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                         ["host", "role", "pages", "total", "one", "two"])


def templates(pages: DataFrame) -> DataFrame:
    """Per host: the roles of its large and frequent classes, one array for each class, the most frequent first.

    ``pages`` has host, key (a number per page) and html. Roles are counted per task
    and again per host and role, so that no task sees all pages of a hot host.
    """
    roles = (pages.mapInArrow(_counted, "host string, role long, pages long, total long, one long, two long")
             .groupBy("host", "role").agg(*[F.sum(c).alias(c) for c in ("pages", "total")],
                                          *[(F.sum(c) % PRIME).alias(c) for c in ("one", "two")])
             .filter(F.col("pages") >= LEAST_PAGES))
    whole = pages.groupBy(F.col("host").alias("__host")).agg(F.count(F.lit(1)).alias("all"))
    frequent = roles.join(whole, F.col("host") == F.col("__host")).filter(F.col("pages") >= F.col("all") * LEAST_SHARE)
    classes = (frequent.groupBy("host", "pages", "total", "one", "two")
               .agg(F.sort_array(F.collect_list("role")).alias("roles")).filter(F.size("roles") >= LEAST_TOKENS))
    rank = F.struct((-F.col("pages")).alias("p"), F.col("total").alias("t"), F.col("roles").alias("roles"))
    return (classes.groupBy("host").agg(F.sort_array(F.collect_list(rank)).alias("ranked"))
            .select(F.col("host").alias("__host"), F.transform("ranked", lambda c: c["roles"]).alias("classes")))


def valid_template(page: list[tuple], classes: list[list[int]]) -> dict[int, int]:
    """Positions of the page's tokens that belong to a valid class, with the number of that class.

    A class holds on a page if it occurs there as whole rounds in one order, and is
    nested: between two of its own tokens, or inside one gap of the classes before it.
    """
    where: dict[int, list[int]] = defaultdict(list)
    for i, token in enumerate(page):
        where[token[4]].append(i)
    marked: dict[int, int] = {}
    cuts: list[int] = []
    for number, roles in enumerate(classes):
        spots = [where.get(r, []) for r in roles]
        rounds = len(spots[0])
        if not rounds or any(len(s) != rounds for s in spots):
            continue
        order = sorted(range(len(spots)), key=lambda k: spots[k][0])
        flat = [spots[k][n] for n in range(rounds) for k in order]
        if any(a >= b for a, b in zip(flat, flat[1:])):
            continue
        if rounds > 1 and cuts and sum(flat[0] < c < flat[-1] for c in cuts):
            continue
        marked.update(dict.fromkeys(flat, number))
        if rounds == 1:
            cuts += flat
    return marked


def _wrappers(blocks: list[tuple[Element, str]]) -> set[Element]:
    """Elements with half or more of the page's text, most of it in an article: a label does not set these aside."""
    total: dict[Element, int] = defaultdict(int)
    inner: dict[Element, int] = defaultdict(int)
    for home, text in blocks:
        if not home.aside:
            for element in home.around():
                total[element] += len(text)
                if home.article and not element.article:
                    inner[element] += len(text)
    whole = max(total.values(), default=0)
    return {e for e, n in total.items() if 2 * n >= whole and 2 * inner[e] > n}


def _blocks(page: list[tuple], marked: dict[int, int]) -> list[tuple[Element, str]]:
    """The texts of the slots, each with its element.

    In an article a block is template as a whole or not at all: a notice repeated as a plain
    paragraph of every article goes, a paragraph with a repeated beginning stays.
    """
    out: list[tuple[Element, str]] = []
    block: list[str] = []
    home: Element | None = None
    own = False  # whether the block has text of its own

    def close():
        text = _BLANKS.sub(" ", "".join(block)).strip()
        if text and home is not None and (own or not home.article):
            out.append((home, text))
        block.clear()

    for i, (kind, _, element, shown, _) in enumerate(page):
        if kind != "text":
            close()
            home, own = None, False
        elif i not in marked or element.article:
            if home is None or element is not home:
                close()
                home, own = element, False
            block.append(shown)
            own = own or (i not in marked and not shown.isspace())
    close()
    return out


def _picked(kept: list[tuple[Element, str]], template: bool) -> list[str]:
    """The slots that make the main text.

    Without a template, those of article and main elements, else all. With one, the
    articles are weighed against the slots outside of them: if one article has the
    most text, only articles are taken; else all slots, but without articles if these
    are several and together have less (teasers).
    """
    if not template:
        return [t for home, t in kept if home.article] or [t for _, t in kept]
    def article(home):
        """The innermost article element inside main, elsewhere the outermost element marked as article."""
        marks = [e for e in home.around() if e.name == "article" or (e.article and not home.main)]
        return (marks[0] if home.main else marks[-1]) if marks else None

    within = [(t, home.main, article(home)) for home, t in kept]
    if 2 * sum(len(t) for t, main, _ in within if main) >= sum(len(t) for t, _, _ in within):
        within = [x for x in within if x[1]] or within
    size: dict[Element | None, int] = defaultdict(int)
    for t, _, region in within:
        size[region] += len(t)
    rest = size.pop(None, 0)
    if size and max(size.values()) >= rest:
        return [t for t, _, region in within if region]
    if len(size) > 1 and sum(size.values()) < rest:
        return [t for t, _, region in within if not region]
    return [t for t, _, _ in within]


def main_text(page: str | None, classes: list[list[int]] | None) -> str:
    """Blocks of the slots that hold the article, joined by an empty line.

    Tokens of valid classes are the template. What lies between them are slots; those
    that stand aside (menus, adverts, notices, comments) are dropped, and of the others
    the main text is picked.
    A page that is all template, as a host of equal pages has it, is read without one,
    and a page whose labels set all of it aside is read without them.
    """
    page = [(*t, _role(t[0], t[1])) for t in tokens(page or "")]
    for labels in (True, False):
        for marked in ([valid_template(page, classes)] if classes else []) + [{}]:
            blocks = _blocks(page, marked)
            free = _wrappers(blocks) if labels else set()
            kept = [(home, text) for home, text in blocks if not home.aside and not (
                labels and any(e.label and e not in free for e in home.around()))]
            if kept:
                return "\n\n".join(_picked(kept, bool(marked)))
    return ""


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page, classes) for page, classes in
                 zip(batch.column("html").to_pylist(), batch.column("classes").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_pydict({
            "page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()),
            "n_chars": pa.array([len(t) for t in texts], pa.int64())})


def extract_main_text(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars. ``pages`` has page_id, url and html; other columns are left out.

    Hosts with fewer than three pages have no template, and their pages are read by
    their elements alone; so are pages without a host. A NULL or empty page has an
    empty text. Repeated rows stay and count as pages. Templates are one row per host;
    Spark sends them to all tasks if they are small, and otherwise joins by host and
    splits hot hosts.
    """
    host = F.lower(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    slim = pages.select("page_id", "url", "html", F.coalesce(host, F.lit("")).alias("host"))
    counted = slim.filter("host <> '' and html is not null").select(
        "host", F.xxhash64("page_id", "url").alias("key"), "html")
    found = stage(templates(counted), "templates")
    return (slim.join(found, F.col("host") == F.col("__host"), "left").select("page_id", "url", "html", "classes")
            .mapInArrow(_extracted, "page_id long, url string, text string, n_chars long"))
