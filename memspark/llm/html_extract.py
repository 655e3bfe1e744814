"""HTML extraction by minimum-cut labelling: content and boilerplate are the two sides of a cut through a page's blocks."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import clean_columns, pieces, put, tune
from .maxflow import min_cut

# Elements whose content is raw text or no text of the page, elements that make blocks, and names that tell a part's role.
RAW = "script style noscript textarea iframe title xmp noembed noframes"
UNSEEN = frozenset("template object svg math canvas audio video select button".split())
#: A block that begins ends these, as they hold none.
NARROW = frozenset("svg math select button".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html"
    " legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the second kind ends where one of the first kind begins.
ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog search head".split())
CONTENT_TAGS = frozenset("article main".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense breadcrumb breadcrumbs comments commentlist consent cookie cookies copyright disqus dropdown gdpr hidden login masthead"
    " menu modal nav navbar navigation newsletter overlay pager pagination paywall popup promo promotion recommended related replies respond share sharing sidebar signup skip social"
    " sponsor sponsored subscribe subscription tagcloud toolbar topbar widgets".split()
)
#: Names that an article's own parts have too.
DOUBTFUL_NAMES = frozenset("banner byline comment disclaimer footer header legal notice notices notification reply widget".split())
CONTENT_NAMES = frozenset("article articlebody body content entry main maincontent post postbody story text".split())
#: A name with one of these tells how a part is laid out, not what it is.
STATES = frozenset("has no with without layout".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW.replace(' ', '|')})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>",
    re.S | re.I,
)
_ATTR = re.compile(r"(?<![\w-])(class|id|role|hidden|style|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What reads like a line of rights, and like the head of readers' comments.
_RIGHTS = re.compile(r"^\W*(?:©|\(c\)\s|copyright\b)|\ball rights reserved\b", re.I)
_COMMENTS = re.compile(r"^(?:\d+ (?:comments?|responses?|replies|reply|thoughts on\b.*)|(?:comments?|responses|replies|discussion|leave a (?:comment|reply))(?: ?\(\d+\))?)\W*$", re.I)

#: Weights of the linear classifier (content is positive): of a part, for each block in it, and of a block's own text.
CONTENT, BOILERPLATE, NAMED_CONTENT, DOUBTFUL = 4.0, -8.0, 2.0, -5.0
PER_WORD, MOST_WORDS, LINKS, SENTENCE, BASE = 0.08, 3.0, -2.5, 0.6, -0.9
#: Of a short line of rights; of a part, for each block in it, that begins with the head of comments.
RIGHTS, MOST_RIGHTS, REMARKS, MOST_HEAD = -4.0, 200, -5.0, 60
#: What is left of a name's weight where it names a wrapper: a part with more than this share of the page's text, outside of which nothing looks like content.
WRAPPER, WRAPPER_SHARE = 0.05, 0.6
#: Capacities of the smoothness edges: between a heading and the block it stands over, between neighbours, and in the tree, there for each block below where some part around has a role.
OVER = 2.0
NEXT_SAME, NEXT_SIBLING, NEXT_OTHER, CHILD, PARENT, IN_ROLE = 0.8, 0.6, 0.2, 0.7, 0.3, 3.0


class _Part:
    """An open or closed element: a block, or an inline element with a role. cue: weight for each block in it; named: the cue is from a name; nest: open elements of its kind within."""

    __slots__ = ("tag", "up", "cue", "named", "unseen", "nest", "blocks", "chars", "role")

    def __init__(self, tag: str, up: int, cue: float = 0.0, named: bool = False, unseen: bool = False):
        self.tag, self.up, self.cue, self.named, self.unseen, self.nest = tag, up, cue, named, unseen, 0
        self.blocks, self.chars, self.role = 0, 0, False


def _role(tag: str, attrs: str, in_content: bool, in_boilerplate: bool) -> tuple[float, bool, bool]:
    """(weight, whether it comes from a name, never seen) of an element by its tag and attributes."""
    cue, good, unseen = 0.0, 0.0, tag in UNSEEN
    if tag in BOILERPLATE_TAGS or tag == "header" and not in_content:
        cue = BOILERPLATE
    elif tag in CONTENT_TAGS:
        good = CONTENT
    by_name = 0.0
    for m in _ATTR.finditer(attrs) if attrs and not attrs.isspace() else ():
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        low = value.lower()
        if key == "hidden" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", low):
            unseen = True
        elif key == "aria-hidden" and low == "true":
            cue = BOILERPLATE
        elif key == "role":
            cue = BOILERPLATE if low in BOILERPLATE_ROLES else cue
            good = CONTENT if low in ("main", "article") else good
        elif key == "itemprop":
            good = CONTENT if low == "articlebody" else good
        elif key in ("class", "id") and tag not in ("html", "body"):
            for name in value.split():
                parts = {x.lower() for x in _NAME.findall(name)} | {name.lower()}
                if parts & STATES:
                    continue
                if parts & BOILERPLATE_NAMES:
                    by_name = BOILERPLATE
                elif parts & DOUBTFUL_NAMES and not (in_content and tag in ("header", "h1", "h2", "p")):
                    by_name = min(by_name, DOUBTFUL)
                elif parts & CONTENT_NAMES:
                    good = max(good, NAMED_CONTENT)
    if by_name and good < CONTENT or in_boilerplate:
        good = 0.0
    total = min(cue, by_name) + good
    return total, bool(by_name) and not cue, unseen


def blocks(page: str) -> tuple[list[tuple[str, int, int]], list[_Part]]:
    """The page's blocks in order, as (text, part, characters in links), and its parts. Text that is never seen is left out."""
    parts = [_Part("", -1)]
    stack, out = [0], []
    buf: list[str] = []
    linked = links = unseen = 0

    def flush() -> None:
        nonlocal linked
        if buf:
            text = "" if unseen else " ".join("".join(buf).split())
            if text:
                out.append((text, stack[-1], linked))
            buf.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        t = html.unescape(raw) if "&" in raw else raw
        buf.append(t)
        if links and not t.isspace():
            linked += len(t)

    def push(tag: str, cue: float, named: bool, hide: bool) -> None:
        nonlocal unseen
        parts.append(_Part(tag, stack[-1], cue, named, hide))
        stack.append(len(parts) - 1)
        unseen += hide

    def cut(k: int) -> None:
        """Closes the open elements from place k on."""
        nonlocal unseen
        for p in stack[k:]:
            unseen -= parts[p].unseen
        del stack[k:]

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[3] or m[6]
        if not tag:
            continue
        tag, closing, attrs = tag.lower(), bool(m[2] or m[5]), m[4] or m[7] or ""
        if tag == "a":
            links = 0 if closing else 1
        if tag == "br":
            buf.append(" ")
        elif tag in BLOCKS:
            flush()
            if tag == "hr":
                continue
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if parts[stack[k]].tag == tag:
                        cut(k)
                        break
                    if tag == "p" and parts[stack[k]].tag != "p" and parts[stack[k]].tag in BLOCKS:
                        break
                continue
            while parts[stack[-1]].tag in NARROW:
                cut(len(stack) - 1)
            ends = ENDS.get(tag, {"p"})
            while parts[stack[-1]].tag in ends:
                ended = parts[stack[-1]].tag
                cut(len(stack) - 1)
                if ended == tag:
                    break
            around = [parts[k] for k in stack]
            push(tag, *_role(tag, attrs, any(p.tag in CONTENT_TAGS for p in around), any(p.tag in BOILERPLATE_TAGS and p.tag != "form" for p in around)))
        elif closing:
            for k in range(len(stack) - 1, 0, -1):  # an inline element ends within its block
                p = parts[stack[k]]
                if p.tag in BLOCKS:
                    break
                if p.tag == tag:
                    if p.nest:
                        p.nest -= 1
                    else:
                        flush()
                        cut(k)
                    break
        elif tag not in VOID and not (attrs.endswith("/") and (tag in NARROW or parts[stack[-1]].tag in NARROW)):
            if parts[stack[-1]].tag == tag and tag not in NARROW:
                parts[stack[-1]].nest += 1
                continue
            cue, named, hide = _role(tag, attrs, True, True) if tag in UNSEEN or attrs and not attrs.isspace() else (0.0, False, False)
            if hide or cue < 0 and tag != "a":
                flush()
                push(tag, cue, named, hide)
    if at < len(page):
        add(page[at:])
    flush()
    return out, parts


def costs(found: list[tuple[str, int, int]], parts: list[_Part]) -> tuple[list[float], dict[int, int], list[tuple[int, int, float]]]:
    """(terminal capacities of blocks and then of parts, node of each part, smoothness edges)."""
    for text, k, _ in found:
        while k >= 0:
            parts[k].blocks += 1
            parts[k].chars += len(text)
            k = parts[k].up
    first: dict[int, int] = {}
    for i, (text, k, _) in enumerate(found):
        at = k
        while at >= 0 and at not in first:
            first[at], at = i, parts[at].up
        if len(text) <= MOST_HEAD and _COMMENTS.match(text):
            around = parts[k].up if parts[k].tag in HEADINGS | {"p", "div"} and parts[k].blocks == 1 else k
            if around > 0 and first[around] == i and parts[around].cue == 0 and parts[around].tag not in ("body", "html"):
                parts[around].cue = REMARKS
    whole = parts[0].chars
    for k, p in enumerate(parts):  # a part comes after the part around it
        if p.cue < 0 and (p.named or p.tag == "form") and p.chars > WRAPPER_SHARE * whole:
            within = [False] * len(parts)
            within[k] = True
            for j in range(k + 1, len(parts)):
                within[j] = within[parts[j].up]
            if not any(q.cue > 0 and q.blocks and not within[j] for j, q in enumerate(parts)):
                p.cue *= WRAPPER
        p.role = p.cue != 0 or p.up >= 0 and parts[p.up].role
    gain = []
    for text, k, linked in found:
        g = BASE + min(MOST_WORDS, PER_WORD * (text.count(" ") + 1)) + LINKS * min(1.0, linked / len(text))
        g += SENTENCE if text[-1] in ".!?…:\"”»" else 0.0
        rights = len(text) <= MOST_RIGHTS and _RIGHTS.search(text) is not None
        while rights and k >= 0:  # within what is marked as content, such a line is content
            rights, k = parts[k].cue <= 0, parts[k].up
        gain.append(g + RIGHTS if rights else g)
    if max(gain) <= 0 and not any(p.cue > 0 and p.blocks for p in parts):  # short texts only: what no link speaks against is content
        gain = [g - BASE for g in gain]
    n, node, edges = len(found), {}, []
    for k, p in enumerate(parts):
        if p.blocks:
            node[k] = n + len(node)
            gain.append(p.cue * p.blocks)
            if p.up >= 0:
                edges.append((node[k], node[p.up], IN_ROLE * p.blocks if parts[p.up].role else PARENT))
    for i, (_, k, _) in enumerate(found):
        edges.append((i, node[k], IN_ROLE if parts[k].role else CHILD))
        if i:
            last = found[i - 1][1]
            near = NEXT_SAME if last == k else NEXT_SIBLING if parts[last].up == parts[k].up else NEXT_OTHER
            edges.append((i - 1, i, max(near, OVER) if parts[last].tag in HEADINGS and parts[k].tag not in HEADINGS else near))
    return gain, node, edges


def content(page: str | None) -> tuple[str, int, int]:
    """(main text, blocks, blocks of content) of a page."""
    found, parts = blocks(page or "")
    if not found:
        return "", 0, 0
    gain, _, edges = costs(found, parts)
    label = min_cut(gain, edges)
    kept = [t for (t, _, _), on in zip(found, label, strict=False) if on]
    return " ".join(kept), len(found), len(kept)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The input's rows and columns without the html, and text, n_chars, n_blocks, n_content.

    Nodes are the blocks and the parts (elements) of the whole page. A linear classifier's weights are their capacities to
    one of two terminals: length, links, sentence ends and lines of rights of a block's own text, tag, role and names of a
    part, and whether it begins with the head of readers' comments.
    Neighbours in page order, a heading and what it stands over, a block and its part, and a part and the part around it are tied by smoothness edges, and
    the minimum cut tells content from boilerplate: a short line follows the article it stands in, a long advert the box
    around it, and an article is not lost in a misnamed wrapper. Character references are decoded, white space inside a
    block becomes one space, content blocks are joined in page order by one space; nothing is cut off. Text that is never
    seen (scripts, hidden elements) is no block. A null or empty page, or one of boilerplate only, has an empty text; ties
    of the cut are boilerplate. Pages of any length are taken whole. Input columns named like a result column are
    replaced; repeated rows are extracted each; an empty table gives no rows.
    """
    tune(pages.sparkSession)
    rows = clean_columns(pages, *({"text", "n_chars", "n_blocks", "n_content"} - {html_col}))
    names = [f for f in rows.schema if f.name != html_col]

    def run(batches):
        for p in pieces(batches, html_col):
            got = [content(h) for h in p.column(p.schema.get_field_index(html_col)).to_pylist()]
            rest = p.select([f.name for f in names])
            yield put(rest, text=pa.array([g[0] for g in got], pa.string()), n_chars=pa.array([len(g[0]) for g in got], pa.int64()), n_blocks=pa.array([g[1] for g in got], pa.int64()), n_content=pa.array([g[2] for g in got], pa.int64()))

    made = [T.StructField("text", T.StringType())] + [T.StructField(c, T.LongType()) for c in ("n_chars", "n_blocks", "n_content")]
    return rows.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in names] + made))
