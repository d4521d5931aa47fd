"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page's token stream becomes a tree of block elements. A wrapper is such a tree whose sequences of children are
regular expressions without unions: an item stands once, optionally (`?`), repeatedly (`+`) or both (`*`), and groups
repeat. A page alone gives a wrapper in which neighbouring repeats are folded to repeated items and groups. Two
wrappers are aligned from left to right; a mismatch is resolved by looking for either side's next item further on in
the other: what is skipped is optional, and repeats that come to meet are folded. Sequences longer than WIDE become a
repeated group of optional items, one for each label. Each element has a text slot that says whether its text is the
same on all pages, and how much of it there is, in and out of links.

Wrappers are inferred from all pages: within a task for each host first, then over the tasks in rounds of FAN, so that
a host with very many pages is never in one task. MOST, DEPTH and WIDE bound a wrapper however many pages it was made
of; what lies beyond them is described more coarsely and no text of a page is lost by that. The wrapper of a host tells
which elements are the article: `article`, else `main`, else the smallest container with most of the host's text outside
links, without unrepeated elements whose text is the same on LEAST or more different pages while that of others varies.
Menus, headers, footers, sidebars, notices, adverts, forms and comments are told by tags, roles and words in class and
id; where such a word is only part of a name (`notice-board`), the wrapper tells: the element goes if its texts are the
same on LEAST pages or links for the most part. Each page is then aligned with its host's wrapper and gives the texts
of those elements; a page that has none of them is judged by the wrapper of its own.

Defined results. Null and empty html has an empty text. Pages without host share one wrapper. Unclosed and misnested
elements are closed where their container ends; text outside body counts as the body's. White space is that of Unicode,
with no-break spaces; `br` is white space. Repeated rows and null page_ids are each extracted. Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, open_folder, tidy, whole_text

WIDE, MOST, DEPTH, FAN, LEAST, SHARE, HELD = 48, 3000, 48, 16, 5, 0.6, 500

# What tags and names mean.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCKS - frozenset("body caption dd dt legend li optgroup option tbody td tfoot th thead tr".split())
ALONE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
WALLS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",), "tbody": ("table",), "tfoot": ("table",)}
GONE_TAGS = frozenset("aside button canvas datalist dialog embed footer form head input label menu nav noscript object search select svg".split())
GONE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
GONE_WORDS = frozenset("ad ads adsense advert adverts advertisement advertising aside banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr menu menus modal nav navbar navigation newsletter notice notices notification pager pagination paywall popup promo promoted promotion related replies reply respond share sharing sidebar sidebars signup social sponsor sponsored subscribe subscription teaser toolbar widget widgets".split())
HEAD_WORDS = frozenset("header masthead topbar".split())
#: Words that say where or how, not what: a class of them and words of GONE_WORDS alone is as clear as the latter.
PLACE_WORDS = frozenset("area article articles bar bottom box button buttons block container content fixed form global group header icon icons inner item items js left link links list main mini mobile outer page panel post posts primary right row secondary section site sticky top wrap wrapper".split())
MAIN_WORDS = frozenset("article articlebody entry post story".split())
CONTAINERS = frozenset("article body center div main section table tbody tr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|template|iframe|textarea|title|xmp|noembed|noframes"

TOKEN = re.compile(
    rf"<!--(?:>|->|.*?(?:--!?>|\Z))|<(?P<raw>{RAW})(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+>.*?(?:</(?P=raw)(?=[\s/>])[^>]*+>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)|(?P<text>[^<]++|<)",
    re.S | re.I,
)
NAMES = re.compile(r"""(?<![^\s"'/])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
DIGITS = re.compile(r"[0-9]+")


class Node:
    """An element of a page, or of a wrapper (`mark`: how often it stands there; `bag`: whether its kids are a repeated group of optional ones)."""

    __slots__ = ("label", "mark", "kids", "bag", "seen", "chars", "links", "same")

    def __init__(self, label: str):
        self.label, self.mark, self.kids, self.bag = label, "", [], False
        self.seen: list[int] = []  # numbers of LEAST different pages that have it, at most
        self.chars, self.links, self.same = 0, 0, None

    def flat(self) -> list:
        return [self.label, self.mark, int(self.bag), self.seen, self.chars, self.links, self.same, [k.flat() for k in self.kids]]


def from_flat(row: list) -> Node:
    out = Node(row[0])
    out.mark, out.bag, out.seen, out.chars, out.links, out.same = row[1], bool(row[2]), *row[3:7]
    out.kids = [from_flat(k) for k in row[7]]
    return out


_LABELS: dict[tuple[str, str], str] = {}


def label_of(tag: str, attrs: str) -> str:
    """`tag.names`, after `!` if the element never belongs to an article, `^` if only outside one, `%` if the wrapper has to tell."""
    found = _LABELS.get((tag, attrs))
    if found is None:
        names = {k.lower(): a or b or c for k, a, b, c in NAMES.findall(attrs)} if "=" in attrs else {}
        role = names.get("role", "").strip().lower()
        each = [{w.lower() for w in WORDS.findall(name)} for k in ("class", "id") for name in names.get(k, "").split()]
        words = set().union(*each)
        named = tag not in ("body", "html") and words & GONE_WORDS
        clear = named and any(w & GONE_WORDS and w <= GONE_WORDS | PLACE_WORDS for w in each)
        mark = "!" if tag in GONE_TAGS or role in GONE_ROLES or clear else "^" if tag == "header" or words & HEAD_WORDS else "%" if named else ""
        kind = "=" if not mark and (tag == "article" or names.get("itemprop", "").lower() == "articlebody") else "~" if not mark and (tag == "main" or role == "main") else "-" if not mark and words & MAIN_WORDS and tag in ("div", "section") else ""
        classes = "".join("." + DIGITS.sub("0", w) for w in names.get("class", "").split())
        found = mark + kind + tag + (classes if len(classes) <= 64 else "." + slot_of(None, classes))
        if len(_LABELS) > 50_000:
            _LABELS.clear()
        _LABELS[tag, attrs] = found
    return found


def slot_of(before: str | None, text: str) -> str:
    """The text slot of an element after one more block: a hash of all of them, however long."""
    import xxhash

    return xxhash.xxh3_128_hexdigest(((before or "") + "\n" + text).encode("utf-8", "surrogatepass"))


def tag_of(label: str) -> str:
    return label.lstrip("!^%=~-").partition(".")[0]


def read_page(html: str) -> tuple[Node, list[tuple[Node, str, int]]]:
    """The tree of a page and its blocks in page order: (element, text, characters in links)."""
    seen: list[int] = []  # shared by all elements
    root = Node("body")
    root.seen = seen
    stack: list[tuple[str, Node, bool, bool]] = [("body", root, False, False)]  # tag, element, whether it is gone, whether in an article
    blocks: list[tuple[Node, str, int]] = []
    pieces: list[str] = []
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                node = stack[-1][1]
                n = min(linked, len(text))
                node.chars += len(text)
                node.links += n
                node.same = slot_of(node.same, text)
                blocks.append((node, text, n))
            linked = 0

    for token in TOKEN.finditer(html):
        text = token["text"]
        if text is not None:
            if stack[-1][0] == "head" and not text.isspace():
                del stack[-1:]
            if not stack[-1][2]:
                pieces.append(text)
                if in_link:
                    linked += len(text)
            continue
        tag = token["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            in_link = not token["end"]
            if not token["end"] or not stack[-1][2]:
                continue
        if tag == "br" or tag == "wbr":
            if tag == "br":
                pieces.append(" ")
            continue
        is_block = tag in BLOCKS
        if token["end"]:
            for at in range(len(stack) - 1, 0, -1):
                if stack[at][0] == tag:
                    if is_block:
                        flush()
                        in_link = False
                    del stack[at:]
                    break
            continue
        if tag == "body" or tag == "html":
            flush()
            if tag == "body" and len(stack) > 1 and stack[1][0] == "head":
                del stack[1:]
            continue
        attrs = token["attrs"]
        if not is_block and tag not in GONE_TAGS and "=" not in attrs:
            continue  # plain inline markup
        label = label_of(tag, attrs)
        gone_inline = not is_block and label[0] == "!"
        if not is_block and not gone_inline:
            continue
        if tag in VOID:
            if is_block:
                flush()
            continue
        if is_block:
            flush()
            if stack[-1][0] == "head":  # left open
                del stack[-1:]
            if tag in ENDS_P:
                for at in range(len(stack) - 1, 0, -1):
                    if stack[at][0] == "p":
                        del stack[at:]
                        break
                    if stack[at][0] in BLOCKS:
                        break
            elif tag in ALONE:
                for at in range(len(stack) - 1, 0, -1):
                    if stack[at][0] in WALLS[tag]:
                        break
                    if stack[at][0] in ALONE[tag]:
                        del stack[at:]
                        break
        _, above, gone, inside = stack[-1]
        node = Node(label)
        node.seen = seen
        own_gone = gone or label[0] == "!" or (label[0] == "^" and not inside)
        if not gone:
            if len(stack) < DEPTH:
                above.kids.append(node)
            else:
                node = above if not own_gone else node
        stack.append((tag, node, own_gone, inside or label[0] in "=~"))
    flush()
    seen.append(int(slot_of(None, "\n".join(text for _, text, _ in blocks))[:8], 16))
    return root, blocks


def fold(kids: list[Node]) -> list[Node]:
    """Neighbours of one label become one repeated item; so do neighbouring equal groups of two or three."""
    out: list[Node] = []
    for k in kids:
        if out and out[-1].label == k.label:
            out[-1] = merge(out[-1], k)
            out[-1].mark = "+" if out[-1].mark in ("", "+") else "*"
        else:
            out.append(k)
    for size in (2, 3):
        at = 0
        while at + 2 * size <= len(out):
            if all(out[at + i].label == out[at + size + i].label for i in range(size)):
                for i in range(size):
                    out[at + i] = merge(out[at + i], out[at + size + i])
                    out[at + i].mark = "*" if "?" in out[at + i].mark or "*" in out[at + i].mark else "+"
                del out[at + size : at + 2 * size]
            else:
                at += 1
    return out


def reduced(label: str) -> str:
    return label.partition(".")[0]


def as_bag(kids: list[Node]) -> list[Node]:
    """One repeated optional item for each label; if there are too many labels, for each tag."""
    names = {k.label for k in kids}
    by: dict[str, Node] = {}
    for k in kids:
        k.label = k.label if len(names) <= WIDE else reduced(k.label)
        by[k.label] = merge(by[k.label], k) if k.label in by else k
    for k in by.values():
        k.mark = "*"
    return list(by.values())


def generalised(page: Node) -> Node:
    """The wrapper of one page."""
    for k in page.kids:
        generalised(k)
    page.kids = fold(page.kids)
    if len(page.kids) > WIDE:
        page.kids, page.bag = as_bag(page.kids), True
    return page


def _mark(a: str, b: str) -> str:
    maybe, many = any(m in ("?", "*") for m in (a, b)), any(m in ("+", "*") for m in (a, b))
    return "*" if maybe and many else "?" if maybe else "+" if many else ""


def optional(node: Node) -> Node:
    node.mark = "*" if node.mark in ("+", "*") else "?"
    return node


def merge(a: Node, b: Node) -> Node:
    """The least general wrapper that this alignment finds for two of one label."""
    a.mark = _mark(a.mark, b.mark)
    if a.seen != b.seen and len(a.seen) < LEAST:
        a.seen = sorted({*a.seen, *b.seen})[:LEAST]
    a.chars, a.links = a.chars + b.chars, a.links + b.links
    if a.same != b.same:
        a.same = ""
    if a.bag or b.bag:
        a.kids, a.bag = as_bag(a.kids + b.kids), True
        return a
    if not a.kids or not b.kids:
        a.kids = [optional(k) for k in a.kids or b.kids]
        return a
    after_a: dict[str, list[int]] = {}
    after_b: dict[str, list[int]] = {}
    for table, kids in ((after_a, a.kids), (after_b, b.kids)):
        for at in range(len(kids) - 1, -1, -1):
            table.setdefault(kids[at].label, []).append(at)

    def further(table: dict[str, list[int]], label: str, at: int) -> int:
        places = table.get(label)
        while places and places[-1] < at:
            places.pop()
        return places[-1] if places else -1

    out, i, j = [], 0, 0
    while i < len(a.kids) and j < len(b.kids):
        x, y = a.kids[i], b.kids[j]
        if x.label == y.label:
            out.append(merge(x, y))
            i, j = i + 1, j + 1
            continue
        in_b, in_a = further(after_b, x.label, j), further(after_a, y.label, i)
        if in_b >= 0 and (in_a < 0 or in_b - j <= in_a - i):
            out += [optional(k) for k in b.kids[j:in_b]]
            j = in_b
        elif in_a >= 0:
            out += [optional(k) for k in a.kids[i:in_a]]
            i = in_a
        else:
            out += [optional(x), optional(y)]
            i, j = i + 1, j + 1
    out += [optional(k) for k in a.kids[i:]] + [optional(k) for k in b.kids[j:]]
    a.kids = fold(out)
    if len(a.kids) > WIDE:
        a.kids, a.bag = as_bag(a.kids), True
    return a


def size_of(node: Node) -> int:
    return 1 + sum(map(size_of, node.kids))


def flattened(node: Node, depth: int) -> Node:
    """Without elements deeper than depth, whose texts count as those of the last one above."""
    for k in node.kids:
        flattened(k, depth - 1)
    if depth <= 0:
        for k in node.kids:
            if k.label[0] != "!":
                node.chars, node.links = node.chars + k.chars, node.links + k.links
                node.same = node.same if k.same is None else ""
        node.kids = []
    return node


def bounded(wrapper: Node) -> Node:
    depth = 8
    while size_of(wrapper) > MOST and depth > 1:
        wrapper, depth = flattened(wrapper, depth), depth - 1
    return wrapper


_KEEP = Node("(kept)")  # stands for what a wrapper lacks, below elements that stay


def constant(node: Node) -> bool:
    """Whether an element's slot is the same on LEAST different pages, copies of one another apart."""
    return bool(node.same) and len(node.seen) >= LEAST


def judge(wrapper: Node) -> set[int]:
    """The elements (by id) that are an article's root, and all in them that stay."""
    out: set[int] = {id(_KEEP)}

    def roots(kind: str) -> list[Node]:
        found, todo = [], [wrapper]
        while todo:
            node = todo.pop()
            if node.label[0] == kind:
                found.append(node)
            elif node.label[0] not in "!^":
                todo += node.kids
        return found

    def mass(node: Node) -> int:
        return 0 if node.label[0] in "!^" else max(0, node.chars - node.links) + sum(map(mass, node.kids))

    def foreign(node: Node) -> bool:
        """Whether what its names leave open is no article: the same everywhere, or links for the most part."""
        some = [n for n in _all([node]) if n.chars]
        return all(map(constant, some)) or 2 * sum(n.links for n in some) >= sum(n.chars for n in some)

    written = lambda some: [n for n in some if any(x.chars for x in _all([n]))]
    found = written(roots("=")) or written(roots("~")) or [n for n in roots("-") if mass(n) >= SHARE * mass(wrapper)]
    if not found:
        node = wrapper
        while True:
            whole = mass(node)
            best = max(node.kids, key=mass, default=None)
            if best is None or not whole or mass(best) < SHARE * whole or tag_of(best.label) not in CONTAINERS:
                break
            node = best
        found = [node]
    # text slots that vary are an article's; beside them those that don't are the host's
    varied = any(n.same == "" and not n.mark for n in _all(found))
    todo = list(found)
    while todo:
        node = todo.pop()
        if node.label[0] == "!" or (node.label[0] == "%" and foreign(node)):
            continue
        if not (varied and constant(node) and not node.kids and node.mark in ("", "?")):
            out.add(id(node))
        todo += node.kids
    return out


def _all(nodes: list[Node]) -> Iterator[Node]:
    todo = list(nodes)
    while todo:
        node = todo.pop()
        yield node
        todo += node.kids


def text_by(wrapper: Node, wanted: set[int], page: Node, blocks: list[tuple[Node, str, int]]) -> str:
    """The texts of a page's elements that align with wanted ones of the wrapper."""
    mine: set[int] = set()
    todo = [(page, wrapper)]
    while todo:
        node, like = todo.pop()
        if id(like) in wanted:
            mine.add(id(node))
        by: dict[str, list[int]] = {}
        for at, k in enumerate(like.kids):
            by.setdefault(k.label, []).append(at)
        low = 0
        for k in node.kids:
            places = by.get(k.label) or by.get(reduced(k.label))
            if not places:
                if id(like) in wanted and k.label[0] != "!":
                    todo.append((k, _KEEP))  # unknown to the wrapper: it goes with its container
                continue
            at = next((p for p in places if p >= low), places[-1])
            low = max(low, at if like.kids[at].mark in ("+", "*") else at + 1)
            todo.append((k, like.kids[at]))
    return "\n".join(text for node, text, _ in blocks if id(node) in mine)


def main_text(html: str, wrapper: Node | None = None, wanted: set[int] | None = None) -> str:
    """The main text of a page by its host's wrapper, or alone."""
    page, blocks = read_page(html)
    if not blocks:
        return ""
    if wrapper is not None:
        text = text_by(wrapper, wanted, page, blocks)
        if text:
            return text
    own, _ = read_page(html)
    own = generalised(own)
    return text_by(own, judge(own), page, blocks)


def host_of(url: str = "url") -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def infer(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For mapInPandas: (host, html) to wrappers (host, part, wrapper), one for each host of a task or more."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    known: dict[str, Node] = {}

    def out() -> pd.DataFrame:
        rows = pd.DataFrame({"host": list(known), "part": task, "wrapper": [json.dumps(w.flat()) for w in known.values()]})
        known.clear()
        return rows.astype({"part": "int64"})

    for part in parts:
        for host, html in zip(part["host"], part["html"]):
            page = generalised(read_page(html)[0])
            known[host] = bounded(merge(known[host], page)) if host in known else bounded(page)
            if len(known) >= HELD:
                yield out()
    if known:
        yield out()


def combine(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For mapInPandas: rows (host, part, wrapper) sorted by host and salt to one row for each."""
    key, now, first = None, None, 0
    for part in parts:
        rows = []
        for host, salt, no, wrapper in zip(part["host"], part["salt"], part["part"], part["wrapper"]):
            if (host, salt) != key:
                if now is not None:
                    rows.append((key[0], key[1], json.dumps(now.flat())))
                key, now, first = (host, salt), from_flat(json.loads(wrapper)), no
            else:
                now = bounded(merge(now, from_flat(json.loads(wrapper))))
        yield pd.DataFrame(rows, columns=["host", "part", "wrapper"]).astype({"part": "int64"})
    if now is not None:
        yield pd.DataFrame([(key[0], key[1], json.dumps(now.flat()))], columns=["host", "part", "wrapper"]).astype({"part": "int64"})


def wrappers(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, part, wrapper), one row for each host of pages (url, html)."""
    now = scratch.keep(pages.select(host_of().alias("host"), whole_text("html").alias("html")).mapInPandas(tidy(infer), "host string, part long, wrapper string"), "parts0")
    turn = 0
    while True:
        most = now.groupBy("host").count().agg(F.max("count")).first()[0] or 1
        if most == 1:
            return now
        turn += 1
        salts = -(-most // FAN)
        dealt = now.withColumn("salt", F.pmod("part", F.lit(salts))).repartition("host", "salt").sortWithinPartitions("host", "salt", "part", "wrapper")
        now = scratch.keep(dealt.mapInPandas(tidy(combine), "host string, part long, wrapper string"), f"parts{turn}")


def extractor(folder: str):
    """A function for mapInPandas: (page_id, url, host, html) to (page_id, url, text), by the wrappers in folder, sorted by host."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.dataset as ds

        system, path = open_folder(folder)
        table = ds.dataset(path, filesystem=system, format="parquet", exclude_invalid_files=False)
        known: OrderedDict[str, tuple[Node, set[int]]] = OrderedDict()

        def learn(hosts: list[str]) -> None:
            if "host" in table.schema.names:
                for batch in table.to_batches(columns=["host", "wrapper"], filter=ds.field("host").isin(hosts), batch_size=256):
                    for host, wrapper in zip(batch["host"].to_pylist(), batch["wrapper"].to_pylist()):
                        node = from_flat(json.loads(wrapper))
                        known[host] = node, judge(node)

        for part in parts:
            order = part["host"].to_numpy().argsort(kind="stable")
            texts: list[str] = [""] * len(part)
            hosts, htmls = part["host"].tolist(), part["html"].tolist()
            for at in range(0, len(order), HELD):
                some = order[at : at + HELD].tolist()
                lacking = sorted({hosts[i] for i in some} - known.keys())
                if lacking:
                    while len(known) > HELD:
                        known.popitem(last=False)
                    learn(lacking)
                for i in some:
                    texts[i] = main_text(htmls[i], *known.get(hosts[i], ()))
            yield pd.DataFrame({"page_id": part["page_id"].astype("Int64"), "url": part["url"], "text": texts})

    return run


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html)."""
    scratch = Scratch(pages.sparkSession, "wrappers")
    folder = scratch.path("by_host")
    wrappers(pages, scratch).select("host", "wrapper").sort("host").write.option("parquet.block.size", 4 << 20).parquet(folder)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host_of().alias("host"), whole_text("html").alias("html"))
    return rows.mapInPandas(tidy(extractor(folder)), "page_id long, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
