"""Main text of web pages by composite text density.

A page is parsed into a tree (unclosed and crossed tags are closed as browsers do).  Parts that are never article text
are cut first: scripts, styles, forms, navigation and the like by tag, by role and by their class and id, as far as a
name says nothing else: it is made of words for such parts and of words for places on a page (``site-header``, not
``related-work``).
Inside the ``article`` or ``main`` element that holds most of the text only what is unambiguous is cut: a class or id
counts as a whole name there (``ad``, not ``ad-hoc``), never on headings or in code, and lists of links stay.  Formulas
are text.
Every node then has a composite density: characters per tag, adjusted by how much of it is link text.  The subtree
with the greatest sum of child densities is the core; the least density on the way from it to the body is the threshold
at which further subtrees beside that way count as content too.

Text is read in page order; white space inside a block becomes one space, and blocks (and line breaks) are joined by one.

Defined cases: a null or empty page has empty text; text outside any tag counts as body text; repeated pages are each
extracted; extra columns are ignored; an empty table gives an empty result.  Trees are arrays and every pass is a loop,
so deeply nested or very long pages need no recursion.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlsieve.llm.common import sliced

_TOKEN = re.compile(r"""<!--.*?-->|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden|aria-label)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title noframes iframe xmp".split())
_BLOCK = set(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select "
    "summary table tbody td tfoot th thead tr ul".split())
#: What a start tag closes: open tags of these names, up to the nearest of the holders.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
           "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
           "body": ({"head"}, set())}
_CLOSES |= {t: ({"tbody", "thead", "tfoot"}, {"table"}) for t in ("tbody", "thead", "tfoot")}
_P_ENDS = _BLOCK - {"br", "body", "head", "html", "option", "tr", "td", "th", "tbody", "thead", "tfoot", "legend"}
_P_HOLDERS = _BLOCK - {"p", "br", "hr"}

_CUT_TAGS = set("head script style noscript template nav aside form footer button select textarea input iframe svg canvas object "
                "dialog menu fieldset audio video title label".split())
_CUT_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar alertdialog".split())
_CUT_WORDS = set(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer sidebar aside widget widgets ad ads adv advert adverts "
    "advertisement advertisements advertising adsense banner sponsor sponsored sponsors promo promoted cookie cookies consent gdpr notice "
    "notices alert disclaimer popup modal overlay newsletter subscribe subscription signup login search share sharing social "
    "related recommended recommendations trending comment comments reply replies respond disqus pagination pager copyright "
    "toolbar paywall form outbrain taboola".split())
#: These name readers' words, which may outweigh the article; a part with another of the words that holds most text is a wrapper.
_READERS = set("comment comments reply replies respond disqus".split())
_LISTS = set("ul ol dl div table section".split())
#: Words that may stand beside the cut words in a name without another meaning: places, containers, what is listed.
_PLACES = set(
    "site page main top bottom left right upper lower global primary secondary bar box block area container wrapper wrap inner outer section "
    "list lists link links item items button buttons icon icons unit slot thread module panel region row col column group body text title content "
    "contents floating sticky fixed mobile desktop user users reader readers post posts article articles story stories news media "
    "the js is has id class div span web blog home".split())
_HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Words that on a heading name the heading itself.
_HEADS = set("header masthead topbar banner".split())
#: Whole names that are cut inside the page's article: words that name nothing else, and words with what they are shown in.
_CUT_NAME = re.compile(
    r"ad|ads|advert|adverts|advertisement|advertisements|adsense|adsbygoogle|sponsored|nav|navbar|breadcrumb|breadcrumbs|sidebar|comment|comments|"
    r"notices?|alerts?|disclaimer|(?:site|page|legal|privacy)-(?:notice|alert|disclaimer)|"
    r"disqus(?:-thread)?|newsletter|subscribe|share|sharing|pagination|pager|paywall|outbrain|taboola|"
    r"(?:ads?|advert|advertisement|sponsored|nav|navigation|comments?|newsletter|subscribe|subscription|signup|share|sharing|social|cookies?|consent|gdpr|"
    r"paywall|related|recommended)-(?:bar|banner|box|buttons?|container|form|icons?|links?|list|modal|notice|overlay|popup|signup|slot|thread|unit|widget|wrapper)|"
    r"social-(?:share|sharing|media)|(?:related|recommended|trending|popular)-(?:articles|posts|stories|news)")
_READERS_NAME = re.compile(r"comments?|comment-(?:box|container|form|list|thread|wrapper)|comments-(?:box|container|form|list|thread|wrapper)|replies|respond|disqus(?:-thread)?")


def _only(name: str, words: set[str]) -> bool:
    """Whether a class or id is made of ``words`` (one at least) and words for places."""
    parts = [w.lower() for w in _WORD.findall(name)]
    return any(w in words for w in parts) and all(w in words or w in _CUT_WORDS or w in _PLACES for w in parts)


class Page:
    """The tree of one page: parallel arrays in page order."""

    def __init__(self, html: str):
        self.tag, self.parent, self.attrs = ["#root"], [-1], [""]
        self.texts: list[tuple[int, str, bool]] = []  # (node, text, a block edge lies before it)
        stack, at, gap, open_tags = [0], 0, True, Counter()

        def close(names: set[str], holders: set[str]) -> None:
            if not any(open_tags[x] for x in names):
                return
            for k in range(len(stack) - 1, 0, -1):
                name = self.tag[stack[k]]
                if name in names:
                    open_tags.subtract(self.tag[i] for i in stack[k:])
                    del stack[k:]
                    return
                if name in holders:
                    return

        last = html.rfind(">")
        while at < len(html):
            found = _TOKEN.search(html, at, last + 1) if at <= last else None
            if not found and (cut := re.compile("<[a-zA-Z/!?]").search(html, at)):  # a tag that never ends
                html = html[: cut.start()]
            text = html[at : found.start()] if found else html[at:]
            if text:
                self.texts.append((stack[-1], unescape(text), gap))
                gap = False
            if not found:
                break
            at = found.end()
            name = (found[2] or found[5] or "").lower()
            if not name:
                continue
            if name in _BLOCK:
                gap = True
            if found[1] or found[4]:
                if name not in _VOID:
                    close({name}, {"table"} if name not in ("table", "body", "html") and name not in _P_ENDS else set())
                continue
            if name in ("html", "body") and open_tags[name]:
                continue
            if name in _P_ENDS:
                close({"p"}, _P_HOLDERS)
            if name in _CLOSES:
                close(*_CLOSES[name])
            self.tag.append(name)
            self.parent.append(stack[-1])
            self.attrs.append(found[3] or found[6] or "")
            if name in _RAW:
                end = re.compile(rf"</{name}\b[^>]*>|\Z", re.I).search(html, at)
                at = end.end()  # its content is never article text
            elif name not in _VOID and not self.attrs[-1].endswith("/"):
                stack.append(len(self.tag) - 1)
                open_tags[name] += 1

    def cut(self, article: int = 0) -> list[bool]:
        """Whether each node is, or lies in, a part that is not article text; below ``article``, the element that the page
        marks as its article (0: none), only what is unambiguous."""
        n, tag, parent = len(self.tag), self.tag, self.parent
        chars, links, anchors, below, holds, linked, heads = [0] * n, [0] * n, [0] * n, [0] * n, [False] * n, [False] * n, [False] * n
        for i in range(1, n):
            linked[i] = linked[parent[i]] or tag[i] == "a"
        for node, text, _ in self.texts:
            size = len("".join(text.split()))
            chars[node] += size
            links[node] += size * linked[node]
        for i in range(n - 1, 0, -1):
            chars[parent[i]] += chars[i]
            links[parent[i]] += links[i]
            below[parent[i]] += below[i] + 1
            anchors[parent[i]] += anchors[i] + (tag[i] == "a")
            holds[parent[i]] |= holds[i] or tag[i] in ("article", "main", "h1", "body")
            heads[parent[i]] |= heads[i] or tag[i] in _HEADINGS or tag[i] == "p"
        out, inside, within, code = [False] * n, [False] * n, [False] * n, [False] * n
        for i in range(1, n):
            out[i], inside[i] = out[parent[i]], inside[parent[i]] or tag[i] in ("article", "main")
            within[i], code[i] = within[parent[i]] or i == article, code[parent[i]] or tag[i] in ("pre", "code")
            sure = within[parent[i]]
            if out[i] or tag[i] in ("html", "body"):
                continue
            if tag[i] in _CUT_TAGS and not (tag[i] in ("form", "aside", "fieldset") and holds[i] or sure and tag[i] == "label"):
                out[i] = not (sure and tag[i] == "footer" and tag[parent[i]] == "blockquote")  # a quotation's source
            elif tag[i] in ("annotation", "annotation-xml"):
                out[i] = tag[parent[i]] == "semantics"  # not shown: the formula before it, in another notation
            elif tag[i] == "header":
                out[i] = not (heads[i] if sure else holds[i] and (inside[parent[i]] or tag[parent[i]] != "body"))
            elif not sure and tag[i] in _LISTS and anchors[i] >= 3 and links[i] >= 0.8 * chars[i]:
                out[i] = not holds[i]
            elif self.attrs[i] and not holds[i]:
                most = below[i] > 2 and 2 * (chars[i] - links[i]) > chars[0] - links[0]
                if not sure:
                    words = _READERS if most or tag[i] in ("article", "main") else _CUT_WORDS
                    words = words - _HEADS if tag[i] in _HEADINGS else words
                    out[i] = self._named(i, lambda names: any(_only(x, words) for x in names), str.split, fold=False)
                elif tag[i] in _HEADINGS or code[i]:
                    out[i] = self._named(i, None, str.split)
                else:
                    name = _READERS_NAME if most or tag[i] in ("article", "main") else _CUT_NAME
                    out[i] = self._named(i, lambda names: any(name.fullmatch(x.replace("_", "-")) for x in names), str.split)
        return out

    def _named(self, i: int, cuts: Callable | None, split: Callable[[str], list[str]], fold: bool = True) -> bool:
        """Whether a node is hidden, has a role that is not text, or a class or id of which ``cuts`` holds."""
        for name, *values in _ATTR.findall(self.attrs[i]):
            name, value = name.lower(), next((v for v in values if v), "")
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True
            if name == "role" and value.lower() in _CUT_ROLES:
                return True
            if cuts and name in ("class", "id") and cuts([w.lower() if fold else w for w in split(value)]):
                return True
        return False

    def text(self) -> str:
        gone, root = self._gone()
        n, tag, parent = len(self.tag), self.tag, self.parent
        chars, links, tags, anchors = [0] * n, [0] * n, [0] * n, [0] * n
        inside, formula = [False] * n, [False] * n
        for i in range(1, n):
            inside[i] = inside[parent[i]] or tag[i] == "a"
            formula[i] = formula[parent[i]] or tag[i] == "math"
        all_chars = all_links = 0
        for node, text, _ in self.texts:
            size = len("".join(text.split()))
            all_chars, all_links = all_chars + size, all_links + size * inside[node]
            if not gone[node]:
                chars[node] += size
                links[node] += size * inside[node]
        for i in range(n - 1, 0, -1):
            if not gone[i]:
                p = parent[i]
                chars[p] += chars[i]
                links[p] += links[i]
                tags[p] += tags[i] + (not formula[p])  # a formula is one tag
                anchors[p] += anchors[i] + (tag[i] == "a")
        share = all_links / max(all_chars, 1)
        density, total, best = [0.0] * n, [0.0] * n, list(range(n))
        for i in range(n - 1, -1, -1):
            if gone[i]:
                continue
            c, t, lc, lt = chars[i], max(tags[i], 1), links[i], anchors[i]
            if c:
                base = log(c / max(c - lc, 1) * lc + share * c + e)
                density[i] = c / t * log(max(c / max(lc, 1) * t / max(lt, 1), 1.0)) / max(log(max(base, 1.0)), 0.1)
            if i:
                p = parent[i]
                total[p] += density[i]
        for i in range(n - 1, 0, -1):
            if not gone[i] and total[best[i]] > total[best[parent[i]]]:
                best[parent[i]] = best[i]
        threshold, i = density[best[root]], best[root]
        while i != root:
            i = parent[i]
            threshold = min(threshold, density[i])
        if tag[root] in ("article", "main"):
            threshold = 0.0  # the page itself says where its article is
        state = [0] * n  # 1: looked into, 2: content as a whole
        state[root] = 2 if best[root] == root else 1
        for i in range(root + 1, n):
            p = parent[i]
            if gone[i] or not state[p]:
                continue
            if state[p] == 2 or best[i] == best[p] or density[i] >= threshold:
                state[i] = 2 if state[p] == 2 or best[i] == i else 1
        out, gap = [], False
        for node, text, edge in self.texts:
            gap |= edge
            if state[node]:
                out += [" ", text] if gap else [text]
                gap = False
        return " ".join("".join(out).split())

    def _gone(self) -> tuple[list[bool], int]:
        """What is cut, and the node to look in."""
        gone = self.cut()
        root = self._root(gone)
        if self.tag[root] not in ("article", "main"):  # an article may be little more than what only its mark can keep
            for i in self._marked(gone)[:1]:
                loose = self.cut(i)
                if self._root(loose) == i:
                    return loose, i
            return gone, root
        return self.cut(root), root

    def _whole(self, gone: list[bool]) -> list[int]:
        whole = [0] * len(self.tag)
        for node, text, _ in self.texts:
            if not gone[node]:
                whole[node] += len("".join(text.split()))
        for i in range(len(whole) - 1, 0, -1):
            if not gone[i]:
                whole[self.parent[i]] += whole[i]
        return whole

    def _marked(self, gone: list[bool]) -> list[int]:
        """Article and main elements, that with most text first, before any is cut from it."""
        whole = self._whole([False] * len(self.tag))
        return sorted((i for i, t in enumerate(self.tag) if t in ("article", "main") and not gone[i]), key=lambda i: (-whole[i], i))

    def _root(self, gone: list[bool]) -> int:
        """The article or main element that holds most of the text, else the body, else the whole page."""
        whole, n = self._whole(gone), len(self.tag)
        marked = [i for i in range(n) if self.tag[i] in ("article", "main") and not gone[i]]
        top = max(marked, key=lambda i: (whole[i], -i), default=0)
        if whole[top] * 2 >= whole[0]:
            return top
        return next((i for i in range(n) if self.tag[i] == "body" and whole[i] == whole[0]), 0)


def main_text(html: str | None) -> str:
    return Page(html).text() if html else ""


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) per page."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    found = source.mapInArrow(rows, f"id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
