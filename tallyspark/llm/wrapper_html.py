"""HTML main text by wrapper induction.

Pages of a host are parsed into DOM trees and each is aligned with the page before it by simple tree matching. What
matched nodes show is counted for each host over all its alignments: a text that recurs in matched nodes of most pages that
have its path is template; nodes whose text varies are slots. Slots that lie in regions of other roles (menus, notices, forms, comments
...) are not content. A page's content is the smallest element that holds most of the varying text; an article or main
element around it, or articles that hold most of it, say where it begins and ends. Pages that copy each other (most text equal) say nothing about their template.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import release, stash

#: A host's pages are dealt over buckets of about FEW_PAGES, up to so many buckets; beyond that, of BUCKET_PAGES at most. Alignments stay within a bucket.
FEW_PAGES, BUCKETS, BUCKET_PAGES = 128, 64, 4096
#: A text is template if it matched in this share of the alignments of pages in which its path matched, and this many at least.
SHARE, LEAST = 0.6, 3
#: Pairs of children that are compared by dynamic programming; longer lists between equal children are matched in order.
CELLS = 1 << 16

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCKS - {"body", "html", "tbody", "td", "tfoot", "th", "thead", "tr", "caption", "legend", "dd", "dt", "li", "summary"} | {"li", "dd", "dt"}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCES = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
NOT_CONTENT = frozenset("nav footer aside form script style noscript template iframe object embed svg math canvas select option button input textarea label fieldset menu dialog head title audio video map search noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
HINTS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside footer foot masthead comment comments disqus respond reply replies discussion newsletter subscribe subscription signup login related recommended recommendations share sharing social widget widgets toolbar pagination pager skip hidden".split())
HEADERS = frozenset("header head topbar top-bar site-header page-header".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME = re.compile(r"[a-z]+(?:-[a-z]+)*")


class Node:
    __slots__ = ("tag", "kids", "sign", "out", "up")

    def __init__(self, tag: str, sign: str, out: bool, up):
        self.tag, self.sign, self.out, self.up = tag, sign, out, up
        self.kids: list = []


def _role(tag: str, attrs: str) -> tuple[str, bool]:
    """A node's sign (tag and classes), and whether it can't hold content."""
    if not attrs or not attrs.strip(" /"):
        return tag, tag in NOT_CONTENT
    out, sign = tag in NOT_CONTENT, tag
    for name, a, b, c in _ATTR.findall(attrs):
        value, name = (a or b or c).lower(), name.lower()
        if name == "class":
            sign += "." + ".".join(value.split()[:3])
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            for word in value.split():
                parts = _NAME.findall(word.replace("_", "-"))
                flat = {p for x in parts for p in x.split("-")}
                if flat & HINTS or word in HEADERS or tag == "header" and flat & {"site", "page", "top"}:
                    out = True
        elif name == "role":
            out |= value.strip() in ROLES
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            out = True
    return sign, out


def parse(page: str) -> Node:
    """A tree for any text: unclosed and misplaced tags are mended as far as HTML's rules for paragraphs, lists and tables say."""
    root = top = Node("#root", "#root", False, None)
    pos, end, find = 0, len(page), _TAG.search
    while pos < end:
        m = find(page, pos)
        if not m:
            top.kids.append(page[pos:])
            break
        if m.start() > pos:
            top.kids.append(page[pos : m.start()])
        pos = m.end()
        tag = m[2] or m[5]
        if not tag:
            if page.startswith("<![CDATA[", m.start()):
                top.kids.append(html.escape(page[m.start() + 9 : pos].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            node = top
            while node.up is not None and node.tag != tag:
                node = node.up
            if node.up is not None:
                top = node.up
            elif tag == "p":
                top.kids.append(Node("p", "p", False, top))
            continue
        attrs = m[3] if m[2] else m[6]
        if tag in CLOSES_P:
            node = top
            while node.up is not None and node.tag not in BLOCKS:
                node = node.up
            if node.tag == "p":
                top = node.up
        if tag in SIBLINGS:
            node = top
            while node.up is not None and node.tag not in SIBLINGS[tag] and node.tag not in FENCES[tag]:
                node = node.up
            if node.tag in SIBLINGS[tag]:
                top = node.up
                if tag == "tr" and node.tag != "tr":
                    while top.up is not None and top.tag in ("tr", "td", "th"):
                        top = top.up
        sign, out = _role(tag, attrs)
        new = Node(tag, sign, out, top)
        top.kids.append(new)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>|\Z", re.I).search(page, pos)
            pos = close.end()
        elif tag not in VOID:
            top = new
    return root


def _below(path: str, sign: str) -> str:
    """The path of a child; a long one is told by its hash."""
    path = f"{path}/{sign}"
    return path if len(path) <= 1024 else f"#{xxhash.xxh3_128_hexdigest(path)}"


def blocks(root: Node) -> list[tuple[str, bool, str, Node]]:
    """(path, whether it is in a region without content, text, element) of each block of text, in page order."""
    found: list[tuple[str, bool, str, Node]] = []
    run: list[str] = []
    # what is open: (its block's path, whether it is in such a region, its block, whether its text is left out, its children left)
    here = ("", False, root)

    def flush():
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            found.append((here[0], here[1], text, here[2]))
        run.clear()

    stack = [(here, False, iter(root.kids))]
    while stack:
        own, hidden, kids = stack[-1]
        if own is not here:
            here = own
        k = next(kids, None)
        if k is None:
            stack.pop()
            if not stack or stack[-1][0] is not own:
                flush()
                here = stack[-1][0] if stack else here
        elif isinstance(k, str):
            if not hidden:
                run.append(k)
        elif k.tag in BLOCKS or k.out and not hidden:
            flush()
            here = (_below(own[0], k.sign), own[1] or hidden or k.out or k.tag == "header" and not _within(k, ("article", "main")), k)
            stack.append((here, False, iter(k.kids)))
        elif k.tag == "br":
            run.append(" ")
        else:
            stack.append((own, hidden, iter(k.kids)))
    return found


def _within(n: Node, tags: tuple[str, ...]) -> bool:
    while n is not None and n.tag not in tags:
        n = n.up
    return n is not None


def _prints(root: Node, found: dict[int, int]) -> None:
    """Hashes of all there is in a node and those below."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack += [k for k in n.kids if not isinstance(k, str)]
    for n in reversed(order):
        found[id(n)] = hash((n.sign, *[k if isinstance(k, str) else found[id(k)] for k in n.kids]))


def _rising(at: list[int]) -> list[int]:
    """Positions of a longest ascending subsequence."""
    tops: list[int] = []
    last: list[int] = []
    before = []
    for i, x in enumerate(at):
        k = bisect_left(tops, x)
        before.append(last[k - 1] if k else -1)
        tops[k : k + 1], last[k : k + 1] = [x], [i]
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Tree matching, as matched pairs: equal children at both ends and those found once in each list are matched first,
    between them the order-keeping match of equal signs with the most nodes."""
    prints: dict[int, int] = {}
    _prints(a, prints)
    _prints(b, prints)
    memo: dict[tuple[int, int], int] = {}
    inner: dict[int, list] = {}

    def of(n):
        k = inner.get(id(n))
        if k is None:
            k = inner[id(n)] = [x for x in n.kids if not isinstance(x, str)]
        return k

    def parts(xs, ys):
        """Pairs of equal children, and the lists between them."""
        same, between = [], []
        n = min(len(xs), len(ys))
        i = 0
        while i < n and prints[id(xs[i])] == prints[id(ys[i])]:
            same.append((xs[i], ys[i]))
            i += 1
        j = 0
        while j < n - i and prints[id(xs[-1 - j])] == prints[id(ys[-1 - j])]:
            same.append((xs[-1 - j], ys[-1 - j]))
            j += 1
        xs, ys = xs[i : len(xs) - j], ys[i : len(ys) - j]
        if xs and ys:
            p, q = [prints[id(x)] for x in xs], [prints[id(y)] for y in ys]
            many_p, many_q = Counter(p), Counter(q)
            place = {h: k for k, h in enumerate(q)}
            once = [k for k, h in enumerate(p) if many_p[h] == 1 == many_q[h]]
            anchors = [(once[k], place[p[once[k]]]) for k in _rising([place[p[k]] for k in once])]
            i = j = 0
            for k, m in [*anchors, (len(xs), len(ys))]:
                if i < k and j < m:
                    between.append((xs[i:k], ys[j:m]))
                if k < len(xs):
                    same.append((xs[k], ys[m]))
                i, j = k + 1, m + 1
        return same, between

    def table(xs, ys):
        """Best matches of beginnings of two lists; asks for the sizes of pairs, one after the other."""
        m = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        for i, x in enumerate(xs, 1):
            row, above = m[i], m[i - 1]
            for j, y in enumerate(ys, 1):
                best = above[j] if above[j] >= row[j - 1] else row[j - 1]
                if x.sign == y.sign:
                    v = memo.get((id(x), id(y)))
                    if v is None:
                        v = yield x, y
                    if above[j - 1] + v > best:
                        best = above[j - 1] + v
                row[j] = best
        return m

    def in_order(xs, ys):
        """Each child with the next one of its sign."""
        places = defaultdict(list)
        for j, y in enumerate(ys):
            places[y.sign].append(j)
        out, at = [], 0
        for x in xs:
            found = places[x.sign]
            k = bisect_left(found, at)
            if k < len(found):
                out.append((x, ys[found[k]]))
                at = found[k] + 1
        return out

    def size(x, y):
        """Nodes in the best match of two trees; asks for those of pairs below."""
        xs, ys = of(x), of(y)
        if not xs or not ys:
            return 1
        same, between = parts(xs, ys)
        total = 1
        for p, q in between:
            if len(p) * len(q) <= CELLS:
                total += (yield from table(p, q))[-1][-1]
            else:
                same = same + in_order(p, q)
        for p, q in same:
            v = memo.get((id(p), id(q)))
            total += (yield p, q) if v is None else v
        return total

    def solved(first):
        """The result of size or table: what they ask for is worked off a list, so that no depth of a tree is too much."""
        asked, value = [(None, first)], None
        while True:
            key, work = asked[-1]
            try:
                x, y = work.send(value)
            except StopIteration as end:
                asked.pop()
                value = end.value
                if not asked:
                    return value
                memo[key] = value
            else:
                asked.append(((id(x), id(y)), size(x, y)))
                value = None

    pairs: list[tuple[Node, Node]] = []
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        pairs.append((x, y))
        same, between = parts(of(x), of(y))
        stack += same
        for xs, ys in between:
            if len(xs) * len(ys) > CELLS:
                stack += in_order(xs, ys)
                continue
            m, i, j = solved(table(xs, ys)), len(xs), len(ys)
            while i and j:
                if m[i][j] == m[i - 1][j]:
                    i -= 1
                elif m[i][j] == m[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    stack.append((xs[i], ys[j]))
    return pairs


def _key(path: str, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{path}\x00{text}") - 2**63


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows host, bucket, html, a bucket's next to each other: (host, node path, text key or null, matches, varying, alignments of pages)."""
    now, last = None, None
    seen: dict[tuple, list[int]] = defaultdict(lambda: [0, 0, 0])

    def counted():
        keys = [*seen]
        out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.int64()), pa.array([seen[k][0] for k in keys], pa.int64()), pa.array([seen[k][1] for k in keys], pa.int64()), pa.array([seen[k][2] for k in keys], pa.int64())], names=["host", "path", "text", "met", "varied", "aligned"])
        seen.clear()
        return out

    for b in batches:
        for h, bucket, page in zip(*(c.to_pylist() for c in b.columns), strict=True):
            root = parse(page or "")
            held = defaultdict(list)
            for path, _, text, node in blocks(root):
                held[id(node)].append((path, text))
            if (h, bucket) != now:
                now, last = (h, bucket), None
            if last is not None:
                total = same = 0
                votes = []
                for x, y in align(last[0], root):
                    for (p, s), (_, t) in zip(last[1].get(id(x), ()), held.get(id(y), ()), strict=False):
                        total += len(t)
                        same += len(t) * (s == t)
                        votes.append((p, t, s == t))
                if 2 * same < total:  # else a copy
                    for p, _, equal in votes:
                        own = seen[h, p, None]
                        own[0] += 1
                        own[1] += not equal
                    for p in {p for p, _, _ in votes}:
                        seen[h, p, None][2] += 1
                    for p, t in {(p, t) for p, t, equal in votes if equal}:
                        seen[h, p, _key(p, t)][0] += 1
            last = (root, held)
        if len(seen) > 50_000:
            yield counted()
        release()
    yield counted()


def induce(pages: DataFrame) -> DataFrame:
    """host, wrapper: JSON of the host's slots (path -> share of varying text) and keys of its template texts."""
    rows = pages.select(_host().alias("host"), "page_id", "html")
    # hosts that need more than one bucket: at most one for each FEW_PAGES rows of the table
    large = rows.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > min(FEW_PAGES, BUCKET_PAGES))
    large = large.select("host", F.expr(f"CAST(greatest(ceil(n / {BUCKET_PAGES}), least({BUCKETS}, ceil(n / {FEW_PAGES}))) AS BIGINT)").alias("buckets"))
    rows = rows.join(F.broadcast(large), "host", "left")
    rows = rows.select("host", F.pmod(F.xxhash64("page_id"), F.coalesce("buckets", F.lit(1))).alias("bucket"), "page_id", "html")
    rows = rows.repartition("host", "bucket").sortWithinPartitions("host", "bucket", "page_id", "html")
    seen = rows.select("host", "bucket", "html").mapInArrow(_evidence, "host string, path string, text long, met long, varied long, aligned long")
    seen = stash(seen.groupBy("host", "path", "text").agg(*[F.sum(c).alias(c) for c in ("met", "varied", "aligned")]), "wrappers")
    slot = seen.where("text IS NULL").select("host", "path", F.col("met").alias("all"), "varied", F.col("aligned").alias("pages"))
    same = seen.where(f"text IS NOT NULL AND met >= {LEAST}").join(slot.select("host", "path", "pages"), ["host", "path"]).where(F.col("met") >= SHARE * F.col("pages"))
    texts = same.groupBy("host").agg(F.collect_set("text").alias("texts"))
    slots = slot.where(f"all >= {LEAST}").groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("path", F.round(F.col("varied") / F.col("all"), 3)))).alias("slots"))
    both = slots.join(texts, "host", "left")
    return both.select("host", F.to_json(F.struct("slots", F.coalesce("texts", F.array().cast("array<long>")).alias("texts"))).alias("wrapper"))


def _host():
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def extract(page: str | None, wrapper: dict | None = None) -> str:
    """The main text of a whole page, given its host's wrapper."""
    slots, texts = (wrapper["slots"], frozenset(wrapper["texts"])) if wrapper else ({}, frozenset())
    all_blocks = [x for x in blocks(parse(page or "")) if not x[1] and _key(x[0], x[2]) not in texts]
    if not all_blocks:
        return ""
    # the smallest element with most of the varying text
    weights = [len(text) * slots.get(path, 1.0) for path, _, text, _ in all_blocks]
    if not any(weights):
        weights = [len(text) for _, _, text, _ in all_blocks]
    weight: dict[int, float] = defaultdict(float)
    total, nodes = sum(weights), {}
    for w, (_, _, _, node) in zip(weights, all_blocks, strict=True):
        while node is not None:
            weight[id(node)] += w
            nodes[id(node)] = node
            node = node.up

    def depth(n: Node) -> int:
        d = 0
        while n.up is not None:
            n, d = n.up, d + 1
        return d

    holders = [nodes[k] for k, w in weight.items() if 2 * w > total and nodes[k].tag not in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6")]
    best = max(holders, key=depth)
    whole = _outermost(best, "article")
    if whole is None:
        marked = [(w, x) for w, x in zip(weights, all_blocks, strict=True) if _within(x[3], ("article",)) and _inside(x[3], best)]
        if 2 * sum(w for w, _ in marked) > weight[id(best)]:
            return "\n".join(x[2] for _, x in marked)
        whole = _outermost(best, "main")
        if whole is not None and any(_inside(x[3], whole) and not _inside(x[3], best) and _within(x[3], ("article",)) for x in all_blocks):
            whole = None  # it also holds articles of its own
    return "\n".join(t for _, _, t, n in all_blocks if _inside(n, whole or best))


def _outermost(n: Node, tag: str) -> Node | None:
    found = None
    while n is not None:
        found = n if n.tag == tag else found
        n = n.up
    return found


def _inside(n: Node, top: Node) -> bool:
    while n is not None and n is not top:
        n = n.up
    return n is not None


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, dict] = {}
    for b in batches:
        out = []
        for page, w in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            if w is not None and w not in known:
                if len(known) >= 64:
                    known.clear()
                known[w] = json.loads(w)
            out.append(extract(page, known[w] if w is not None else None))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])
        release()


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, a row for each row of pages.

    Null or empty html gives an empty text. Null or relative urls are one host. Rows that repeat a page are each returned.
    A host with fewer than LEAST alignments has no wrapper; its pages go by the roles of their elements alone. Ties between
    elements go to the first. Other columns are not read. An empty table gives an empty result.
    """
    rows = pages.select("page_id", "url", "html")
    wrappers = stash(induce(rows), "wrappers")
    both = rows.withColumn("host", _host()).join(wrappers, "host", "left")
    return both.select("page_id", "url", "html", "wrapper").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
