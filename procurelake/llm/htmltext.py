"""Main text of web pages by composite text density.

Sun, Song and Liao, "DOM Based Content Extraction via Text Density" (SIGIR 2011): a node's density is its characters
per tag, adjusted for the share of link text; the node whose children's densities sum up highest holds the article,
and the least density on its path to the body is the threshold for what beside it still belongs.

Densities are summed over blocks: bold or linked words are no parts of their own.  Article and main elements only break
ties.  Parts that are marked as no article, by element or by the words of class, id and role (navigation, forms, notices,
reader comments, ...), have no density and no text, unless they frame the page's text: see ``Page.settle``.
"""

from __future__ import annotations

import re
from html import unescape
from math import e, log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurelake.llm.arrow import map_batches

# Fixed values of HTML: elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe textarea title noembed noframes xmp".split())
#: Elements whose content isn't shown as text; without an end tag they hold nothing.
FALLBACK = frozenset("template svg object canvas audio video select".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HIDDEN = RAW | FALLBACK | frozenset(["head"])
DROPPED = frozenset("nav footer aside form button menu dialog fieldset input".split())
#: Elements and words among those that drop a part that a frame around a whole page may have too.
FRAMES = frozenset("form fieldset aside header".split())
FRAME_WORDS = frozenset("sidebar sidebars side menu menus nav navbar navigation header masthead topbar toolbar modal overlay search widget widgets".split())
#: Text outside of a marked part, as a share of its own, under which it is the frame of the page.
SHARE = 0.05
#: Elements that frame other parts; class and id of headings, paragraphs and inline text say nothing.
CONTAINERS = frozenset("div section ul ol dl table tbody tr td header center figure details".split())
#: What a start tag ends: itself or its kin, up to the element that holds them.
ENDS = {
    "li": ("li", ("ul", "ol", "menu")),
    "dt": ("dt dd", ("dl",)),
    "dd": ("dt dd", ("dl",)),
    "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")),
    "tbody": ("thead tbody tfoot tr td th", ("table",)),
    "thead": ("thead tbody tfoot tr td th", ("table",)),
    "tfoot": ("thead tbody tfoot tr td th", ("table",)),
    "option": ("option", ("select",)),
}
TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.DOTALL)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
#: Words of class, id or role that mark a part as no article.
AWAY = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner banners sponsor sponsored promo promotion sidebar sidebars side menu menus nav navbar navigation breadcrumb breadcrumbs pager pagination "
    "footer foot header masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "comment comments commentlist disqus replies respond widget widgets search skip tags copyright legal disclaimer complementary contentinfo navigation banner".split()
)
#: Words beside those that say where or of what kind a part is, as in site-header, main-nav, cookie-bar or user-comments.
BESIDE = frozenset("site page web blog main global user reader readers visitor top bottom left right upper lower primary secondary sub bar box list block section area wrap wrapper container inner outer panel strip row col column group links".split())
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"\s+")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that an article has.
SHOWS = HEADINGS | frozenset(["article", "main"])


def _away(tag: str, attributes: str, inside: bool, in_form: bool) -> str:
    """Why a part is no article: ``hidden`` if it isn't shown; ``part`` by element or words, ``frame`` if a frame
    around a page may have them too; '' if nothing says so.

    ``inside`` an article its header stays for the headings; a label is part of a form only ``in_form``.
    """
    if tag in HIDDEN:
        return "hidden"
    if tag == "label" and in_form:
        return "part"
    if tag in DROPPED or tag == "header" and not inside:
        return "frame" if tag in FRAMES else "part"
    if not attributes or tag in ("html", "body", "main"):
        return ""
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if tag == "article":
            if name in ("class", "id") and "comment" in value.lower():
                return "part"
            continue
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            return "hidden"
        words: set[str] = set()
        if tag in CONTAINERS:
            for token in value.split() if name in ("class", "role") else [value] if name == "id" else []:
                own = {w.lower() for w in WORDS.findall(token)}
                # a token counts if its other words, if any, say where it is: other slugs tell of the text's subject
                if own & AWAY and own <= AWAY | BESIDE and (name != "id" or len(own & AWAY) == 1 and not any(c.isdigit() for c in value)):
                    words |= own & AWAY
        if words:
            return "frame" if words <= FRAME_WORDS else "part"
    return ""


def _density(chars: int, links: int, tags: int, link_tags: int, share: float) -> float:
    """Characters per tag, adjusted for links; ``share`` is that of link text in the whole page."""
    plain = max(chars - links, 1)
    base = log(log(chars / plain * links + share * chars + e) + 1e-9) if links or share else 0.0
    ratio = chars / max(links, 1) * max(tags, 1) / max(link_tags, 1)
    return chars / max(tags, 1) * (log(max(ratio, 1.0)) / (1 + max(base, 0.0)))


class Page:
    """Nodes by number, parents before children: tag, parent, whether dropped; and the text pieces by node."""

    def __init__(self, html: str):
        self.tags, self.parents, self.dropped, self.inside, self.why = ["body"], [-1], [False], [False], [""]
        self.pieces: list[tuple[int, str]] = []
        self.stack = [0]
        #: Places in the stack of open elements by tag, and of open blocks: the nearest one is the last.
        self.open: dict[str, list[int]] = {"body": [0]}
        self.open_blocks = [0]
        last: dict[str, int] = {}
        at, n = 0, len(html)
        while at < n:
            m = TAG.search(html, at)
            if m is None:
                self._text(html[at:])
                break
            self._text(html[at : m.start()])
            at = m.end()
            close, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if close:
                self._end(tag)
            else:
                self._start(tag, attributes)
                if tag in RAW and not attributes.endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(html, at)
                    at = end.end() if end else n
                    self._end(tag)
                elif tag in FALLBACK:
                    if tag not in last:
                        last[tag] = max((x.start() for x in re.finditer(rf"</{tag}(?=[\s/>])", html, re.IGNORECASE)), default=-1)
                    if last[tag] < at:
                        self._end(tag)

        self.settle()

    def _text(self, text: str) -> None:
        if text:
            self.pieces.append((self.stack[-1], unescape(text) if "&" in text else text))

    def _break(self) -> None:
        """A block starts or ends here."""
        self.pieces.append((-1, ""))

    def _nearest(self, names: tuple[str, ...]) -> int:
        """Place in the stack of the nearest open element of ``names``, 0 if none is open."""
        return max((self.open[k][-1] for k in names if self.open.get(k)), default=0)

    def _close(self, place: int) -> None:
        """End the open elements from a place on."""
        while len(self.stack) > place:
            tag = self.tags[self.stack.pop()]
            self.open[tag].pop()
            if tag in BLOCKS:
                self.open_blocks.pop()

    def _pop(self, names: tuple[str, ...], holders: tuple[str, ...]) -> None:
        """End the nearest open element of ``names`` that no holder shields."""
        place = self._nearest(names)
        if place and place > self._nearest(holders):
            self._close(place)

    def _start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "br":
            self._text(" ")
        if tag in BLOCKS:
            self._break()
            self._pop(("p",), ("td", "th", "button", "object", "caption", "table"))
        if tag in ENDS:
            names, holders = ENDS[tag]
            self._pop(tuple(names.split()), holders)
        parent = self.stack[-1]
        self.tags.append(tag)
        self.parents.append(parent)
        self.inside.append(self.inside[parent] or tag in ("article", "main"))
        why = _away(tag, attributes, self.inside[parent], bool(self.open.get("form") or self.open.get("fieldset")))
        self.why.append(why)
        self.dropped.append(False)
        if tag not in VOID and not attributes.endswith("/") or tag in BLOCKS and tag not in VOID:
            self.open.setdefault(tag, []).append(len(self.stack))
            if tag in BLOCKS:
                self.open_blocks.append(len(self.stack))
            self.stack.append(len(self.tags) - 1)

    def _end(self, tag: str) -> None:
        place = self._nearest((tag,))
        # the end of an inline element doesn't end blocks
        if place and (tag in BLOCKS or tag == "a" or self.open_blocks[-1] < place):
            self._close(place)
            if tag in BLOCKS:
                self._break()

    def settle(self) -> None:
        """Drop the parts that are marked, but for those that the page's text lies in.

        A part that may be a frame is one if it holds a heading, an article or a main element, and the text beside links
        outside of it, in parts that aren't marked, is under SHARE of its own: then only what is marked inside of it goes.
        """
        n = len(self.tags)
        self.linked = linked = [False] * n
        hidden = [self.why[i] == "hidden" for i in range(n)]
        for i in range(1, n):
            linked[i] = linked[self.parents[i]] or self.tags[i] == "a"
            hidden[i] = hidden[i] or hidden[self.parents[i]]
        # text beside links outside of marked parts, the same with the best frame inside, and whether an article shows
        bare, full, shows = [0] * n, [0] * n, [self.tags[i] in SHOWS and not hidden[i] for i in range(n)]
        for i, text in self.pieces:
            if i >= 0 and not linked[i] and not hidden[i]:
                bare[i] += len("".join(text.split()))
        for i in range(n - 1, -1, -1):
            p, full[i] = self.parents[i], full[i] + bare[i] if self.why[i] or not i else full[i]
            if i and not hidden[i]:
                shows[p] = shows[p] or shows[i]
                full[p] = max(full[p], full[i] if self.why[i] in ("", "frame") else 0)
                bare[p] += 0 if self.why[i] else bare[i]
        outside, holder = [0] * n, [0] * n  # text around the nearest frame, and that frame
        for i in range(1, n):
            p = self.parents[i]
            outside[i], holder[i], self.dropped[i] = outside[p], holder[p], self.dropped[p] or hidden[i]
            if self.why[i] and not self.dropped[i]:
                around = outside[p] + bare[holder[p]]
                if self.why[i] == "frame" and shows[i] and around < SHARE * full[i]:
                    outside[i], holder[i] = around, i
                else:
                    self.dropped[i] = True

    def densities(self) -> tuple[list[float], list[float], float]:
        """Composite density of every node, the sum over its children, and the share of link text in the page."""
        n = len(self.tags)
        chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        for i, text in self.pieces:
            if i >= 0 and not self.dropped[i]:
                size = len(text) - text.count(" ") - text.count("\n") if text.isspace() else len(text)
                chars[i] += size
                links[i] += size * self.linked[i]
        for i in range(n - 1, 0, -1):
            if not self.dropped[i]:
                p = self.parents[i]
                chars[p] += chars[i]
                links[p] += links[i]
                tags[p] += tags[i] + 1
                link_tags[p] += link_tags[i] + (self.tags[i] == "a")
        share = links[0] / max(chars[0], 1)
        density, sums = [0.0] * n, [0.0] * n
        for i in range(n):
            if chars[i] and not self.dropped[i]:
                density[i] = _density(chars[i], links[i], tags[i], link_tags[i], share)
                if i and self.tags[i] in BLOCKS:  # bold or linked words are no part of their own
                    sums[self.parents[i]] += density[i]
        return density, sums, share

    def chosen(self) -> tuple[set[int], set[int]]:
        """Roots of the subtrees that make up the article, and numbers of pieces beside them that belong to it.

        Text that stands on the path to the body itself is weighed stretch by stretch, as a node of its own would be.
        """
        density, sums, share = self.densities()
        best = max(range(len(sums)), key=lambda i: (sums[i], self.tags[i] in ("article", "main"), -i))
        path = [best]
        while path[-1]:
            path.append(self.parents[path[-1]])
        threshold = min(density[i] for i in path)
        roots, on_path = {best}, set(path)
        for i in range(1, len(density)):
            if self.parents[i] in on_path and i not in on_path and not self.dropped[i] and self.parents[i] != best and (density[i] >= threshold or self.tags[i] in HEADINGS):
                roots.add(i)
        block = [0] * len(density)  # the nearest block of each node
        for i in range(1, len(density)):
            block[i] = i if self.tags[i] in BLOCKS else block[self.parents[i]]
        beside, stretch = set(), []
        stray = on_path - {best}
        for k, (i, text) in enumerate([*self.pieces, (-1, "")]):
            if i >= 0 and block[i] in stray and not self.dropped[i]:
                stretch.append((k, i, text))
            elif i < 0 and stretch:
                size = sum(len(t) for _, _, t in stretch)
                links = sum(len(t) for _, i, t in stretch if self.linked[i])
                if any(t.strip() for _, _, t in stretch) and _density(size, links, 1, len({i for _, i, _ in stretch if self.linked[i]}), share) >= threshold:
                    beside |= {k for k, _, _ in stretch}
                stretch = []
        return roots, beside

    def text(self) -> str:
        """The article's blocks, one line each."""
        (roots, beside), n = self.chosen(), len(self.tags)
        kept, headed = [False] * n, [False] * n
        for i in range(n):
            p = self.parents[i]
            kept[i] = not self.dropped[i] and (i in roots or p >= 0 and kept[p])
            # of an article's own header only the headings stay
            headed[i] = (self.tags[i] == "header" or p >= 0 and headed[p]) and self.tags[i] not in HEADINGS
        lines: list[list[str]] = [[]]
        for k, (i, text) in enumerate(self.pieces):
            if i < 0:
                if lines[-1]:
                    lines.append([])
            elif (kept[i] or k in beside) and not headed[i]:
                lines[-1].append(text)
        done = [SPACE.sub(" ", "".join(x)).strip() for x in lines]
        return "\n".join(x for x in done if x)


def extract_text(html: str | None) -> str:
    """Main text of one page; '' if it has none."""
    return Page(html).text() if html else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    Null and empty html, and pages without text, give the empty text.  Rows are kept one for one; other columns are
    ignored.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    schema = T.StructType([rows.schema["page_id"], rows.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(b: dict[str, list]) -> dict[str, list]:
        texts = [extract_text(h) for h in b["html"]]
        return {"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    return map_batches(rows, run, schema)
