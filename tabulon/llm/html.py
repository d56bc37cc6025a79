"""Main text of web pages by tag-path ratios.

A page's text nodes are grouped by their path of tags (with classes) from the root. For each path the
length and punctuation of its text against the number of its nodes and links are summed; both ratios
are smoothed over neighbouring paths in page order, fused by their product, and paths above a share of
the page's weighted mean are content. Paths through menus, forms, notices and the like never are; where only a class or id
says so, that holds for elements with the minor part of the page's text weighted by these ratios.
Blocks under the nearest common ancestor of content paths that hold plain text, headings or lists
belong to the article too.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

from pyspark.sql import DataFrame

_DECLARED = r"<!--.*?(?:-->|$)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|$)|<[!?][^>]*>?"
_TOKEN = re.compile(_DECLARED + r"|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)>", re.S)
_TAIL = re.compile(_DECLARED + "|(?P<tag>(?!))", re.S)  # behind the last ">" there are no tags
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|style|aria-hidden|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg annotation annotation-xml canvas object select option xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup mover munder munderover mspace mstyle semantics".split())
OUTSIDE = frozenset("nav footer aside form button dialog menu head fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
P_CLOSERS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
NOT_CONTENT = re.compile(
    r"(?:^|[\s_-])(?<!\bhas[_-])(?<!\bwith[_-])(?<!\bwithout[_-])(?<!\bno[_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumb\w*|side-?bar\w*|rail|footer\w*|site-?header|masthead|topbar|"
    r"cookie\w*|consent\w*|gdpr|notice\w*|alert|popup|modal|newsletter|subscri\w*|signup|login|comment\w*|disqus\w*|respon(?:d|se)\w*|repl(?:y|ies)|discussion|"
    r"share\w*|sharing|social\w*|related\w*|recommend\w*|widget\w*|pagination|pager|copyright|legal|disclaimer|hidden|skip\w*|search\w*|form|toolbar|tags?|"
    r"author-?bio|outbrain|taboola)(?:$|[\s_-])",
    re.I,
)
_COMMENTS = re.compile(r"(?:^|[\s_-])(?:comment\w*|repl(?:y|ies)|respon(?:d|se)\w*|discussion|disqus\w*)(?:$|[\s_-])", re.I)
_PUNCT = re.compile(r"[.,;:!?…。、，！？；：]")
_SPACE = re.compile(r"[ \t\n\r\f\v   -     　\x1c-\x1f\x85]+")
_LONG_NUMBER = re.compile(r"&#0*+[0-9]{8,}+;?")
THRESHOLD = 0.25
#: Elements nested deeper count to the path of the one at this depth.
MOST_DEPTH = 512


class _Block:
    __slots__ = ("path", "parts", "linked", "barred", "named", "inside")

    def __init__(self, path, barred, named, inside):
        self.path, self.parts, self.linked, self.barred, self.named, self.inside = path, [], 0, barred, named, inside


def _decoded(raw: str) -> str:
    """Character references decoded; numbers too long to be a code point are U+FFFD."""
    return unescape(_LONG_NUMBER.sub("\ufffd", raw) if "&#" in raw else raw)


def _attributes(text: str) -> dict:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTR.finditer(text)}


def _bars(tag: str, attrs: dict, inside: bool) -> bool:
    """Whether an element is set apart from the article by its tag, role or style."""
    if tag in OUTSIDE or tag == "header" and not inside or attrs.get("role", "").lower() in ROLES:
        return True
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        return True
    return False


def _named(tag: str, attrs: dict) -> bool:
    """Whether an element's class or id sounds as if it were set apart."""
    if tag in ("html", "body", "main"):
        return False
    words = _COMMENTS if tag == "article" else NOT_CONTENT
    return any(words.search(f"{attrs.get(k, '')}") for k in ("class", "id"))


def blocks(html: str) -> tuple[list[_Block], list[int]]:
    """The text blocks of a page in order, each with its tag path, and for each element barred by name the one around it (-1: none).

    A block's *named* is the innermost such element around it.
    """
    out, stack, at = [], [], 0  # stack: (tag, path of block elements down to it, barred, block-level, depth of that path, named)
    current, open_tags, open_barred, open_main = None, Counter(), 0, 0  # open_main: article and main elements that aren't named
    around, open_named = [], []

    def say(raw: str) -> None:
        nonlocal current
        if not raw:
            return
        if current is None:
            if not raw.strip():
                return
            current = _Block(stack[-1][1] if stack else "", open_barred > 0, open_named[-1] if open_named else -1, open_main > 0)
            out.append(current)
        text = _decoded(raw)
        current.parts.append(text)
        if open_tags["a"]:
            current.linked += len(text.strip())

    def pop_to(k: int) -> None:
        nonlocal current, open_barred, open_main
        for s in stack[k:]:
            open_tags[s[0]] -= 1
            open_barred -= s[2]
            open_main -= s[0] in ("article", "main") and not s[5]
            if s[5]:
                open_named.pop()
            if s[3] or s[2] or s[5]:
                current = None
        del stack[k:]

    end, last = len(html), html.rfind(">")
    while at < end:
        m = (_TOKEN if at <= last else _TAIL).search(html, at)
        if not m:
            say(html[at:])
            break
        say(html[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            say(m["cdata"])
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if m["close"]:
            if not open_tags[tag]:
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag in INLINE and any(s[3] for s in stack[k + 1 :]):  # misnested: only the inline element ends
                        if not stack[k][2] and not stack[k][5]:
                            open_tags[tag] -= 1
                            del stack[k]
                        break
                    pop_to(k)
                    break
            continue
        if tag in RAW:
            if not m["attrs"].rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = close.end() if close else end
            if tag not in ("title", "script", "style", "template", "noscript"):
                current = None
            continue
        if tag in VOID:
            if tag == "br":
                say(" ")
            elif tag == "hr":
                current = None
            continue
        if tag in P_CLOSERS and open_tags["p"]:  # an open paragraph ends here, and with it what is open inside it
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    pop_to(k)
                    break
                if stack[k][0] in ("div", "article", "section", "td", "li", "blockquote", "body", "main"):
                    break
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            same = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, ())
            for k in range(len(stack) - 1, -1, -1) if any(open_tags[t] for t in same) else ():
                if stack[k][0] in same:
                    pop_to(k)
                    break
                if stack[k][0] in ("ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "menu"):
                    break
        attrs = _attributes(m["attrs"]) if m["attrs"].strip(" /") else {}
        inside = open_main > 0
        block = tag not in INLINE
        barred = _bars(tag, attrs, inside) if block or attrs else False
        named = not barred and _named(tag, attrs)
        if block or barred or named:
            current = None
        name = tag + "".join(f".{c}" for c in sorted(attrs.get("class", "").replace("/", "|").split()))
        if not m["attrs"].rstrip().endswith("/") or block:
            path, depth = (stack[-1][1], stack[-1][4]) if stack else ("", 0)
            if block and depth < MOST_DEPTH:
                path, depth = f"{path}/{name}" if depth else name, depth + 1
            stack.append((tag, path, barred, block, depth, named))
            if named:
                around.append(open_named[-1] if open_named else -1)
                open_named.append(len(around) - 1)
            open_tags[tag] += 1
            open_barred += barred
            open_main += tag in ("article", "main") and not named
    return out, around


def _smoothed(values: list[float]) -> list[float]:
    return [(values[max(0, i - 1)] + 2 * v + values[min(len(values) - 1, i + 1)]) / 4 for i, v in enumerate(values)]


def main_text(html: str | None, threshold: float = THRESHOLD) -> str:
    """The article of a page, blocks joined by one newline; empty if there is none."""
    if not html:
        return ""
    if not isinstance(html, str):
        html = str(html)
    kept, (found, around) = [], blocks(html)
    for b in found:
        text = _SPACE.sub(" ", "".join(b.parts)).strip()
        if text and not b.barred:
            kept.append((b, text))
    if around and kept:
        apart = _apart(kept, around)
        kept = [(b, text) for b, text in kept if b.named < 0 or not apart[b.named]]
    if not kept:
        return ""
    sums, fused = _ratios(kept)
    paths = list(sums)
    weight = sum(s[0] for s in sums.values())
    bar = threshold * sum(fused[p] * sums[p][0] for p in paths) / weight
    chosen = {p for p in paths if fused[p] >= bar and sums[p][3] <= 0.6 * sums[p][0]}
    root = _article({p: sums[p][0] for p in paths if p in chosen})
    under = {p: _under(p, root) for p in paths}
    return "\n".join(text for b, text in kept if under[b.path] and (b.path in chosen or _belongs(b, text, root)))


def _ratios(kept: list[tuple[_Block, str]]) -> tuple[dict[str, list[float]], dict[str, float]]:
    """Sums of each path (characters, points, blocks, linked characters) and its fused ratio."""
    sums: dict[str, list[float]] = {}
    for b, text in kept:
        s = sums.setdefault(b.path, [0, 0, 0, 0])
        for k, v in enumerate((len(text), len(_PUNCT.findall(text)), 1, b.linked)):
            s[k] += v
    paths = list(sums)
    lengths = _smoothed([(s[0] - s[3]) / s[2] for s in sums.values()])
    points = _smoothed([(1 + s[1]) / s[2] for s in sums.values()])
    fused = {p: (max(0.0, a) * b) ** 0.5 for p, a, b in zip(paths, lengths, points)}
    return sums, fused


def _apart(kept: list[tuple[_Block, str]], around: list[int]) -> list[bool]:
    """For each element barred by name whether it, or one around it, stays so: those that hold most of the page don't.

    Text counts by its ratio; where there is text in an article or main element, only that counts.
    """
    _, fused = _ratios(kept)
    weigh = [fused[b.path] * len(text) for b, text in kept]
    marked = [w if b.inside else 0.0 for (b, _), w in zip(kept, weigh)]
    weigh = marked if any(marked) else weigh
    held = [0.0] * len(around)
    for (b, _), w in zip(kept, weigh):
        if b.named >= 0:
            held[b.named] += w
    for k in range(len(around) - 1, -1, -1):  # an element stands behind the one around it
        if around[k] >= 0:
            held[around[k]] += held[k]
    apart, total = [], sum(weigh)
    for k, up in enumerate(around):
        apart.append(held[k] <= 0.5 * total or up >= 0 and apart[up])
    return apart


def _under(path: str, root: tuple[str, ...]) -> bool:
    return tuple(path.split("/"))[: len(root)] == root


def _article(chosen: dict[str, int]) -> tuple[str, ...]:
    """The path of the element that holds the content: an article or main element if one holds most of it, else the common ancestor."""
    weigh: dict[tuple[str, ...], int] = {}
    total = sum(chosen.values())
    for path, chars in chosen.items():
        parts = tuple(path.split("/"))
        for k in range(1, len(parts) + 1):
            weigh[parts[:k]] = weigh.get(parts[:k], 0) + chars
    marked = [p for p, w in weigh.items() if p[-1].split(".")[0] in ("article", "main") and w > 0.5 * total]
    if marked:
        return max(marked, key=lambda p: (p[-1].split(".")[0] == "article", len(p)))
    whole = [p for p, w in weigh.items() if w >= 0.9 * total]
    best = max(whole, key=len, default=())
    return best[:-1] if best and best[-1].split(".")[0] in ("p", "li", "blockquote", "pre") else best


def _belongs(b: _Block, text: str, root: tuple[str, ...]) -> bool:
    """Short blocks under an article's element, such as headings and list items, whatever their ratio."""
    if not root or root[-1].split(".")[0] not in ("article", "main", "div", "section", "td"):
        return False
    return b.linked <= 0.6 * len(text)


def extract(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, url, text of each row of *pages* (page_id, url, html); a null html gives an empty text.

    Repeated rows are read each, other columns are ignored, an empty table gives an empty one.
    """

    def texts(batches):
        import pyarrow as pa

        for b in batches:
            found = [main_text(h.as_py(), threshold) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string())], ["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(texts, "page_id long, url string, text string")
