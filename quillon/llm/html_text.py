"""Main text of web pages: subtrees that recur on many pages of a host are its template and go.

One pass parses each page into text blocks and the element subtrees that could
be template.  A subtree's hash covers its labels and texts; its slot is the path
of labels from the page's root.  Hashes are counted per host in Spark, over
pages of different main text, so copies of a page don't make its text a
template.  A subtree that recurs on enough of them goes.  On hosts with enough
pages counts alone tell text from template: where a good part of what stands in
a slot outside of article elements recurs, all that stands there goes, the rest
is text, whatever its class is called.

Elements that HTML names as something else than text (nav, footer, form, ...)
always go, and so do readers' comments, which recur as little as the text.  Hosts
with fewer pages can't show what recurs: there only what is in article elements
is text, or in what stands for them, and elements go that are marked by class,
id or role.
"""

from __future__ import annotations

import hashlib
import re
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import arrow_uri, filesystem, quoted, read_texts, shared_dir, written

_TOKEN = re.compile(r"""<!--(?:.*?-->|.*)|<!\[CDATA\[(?:.*?\]\]>|.*)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)>|<[!?][^>]*>""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_RAW_END = {t: re.compile(rf"</{t}(?:[\s/][^>]*)?>", re.I) for t in _RAW}
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: In the article these go on more evidence only, and those never but with what they are in.
_PARAGRAPH = frozenset("p h2 h3 h4 h5 h6 li dt dd pre blockquote caption figcaption table".split())
_BOUND = frozenset("h1 td th tr tbody thead tfoot".split()) | _INLINE
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: what a start tag closes, and what keeps it from looking further up
_CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "body": ("head", "html")}
_CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _CLOSES.items()}
_DROP = frozenset("nav aside footer header form script style noscript template button select textarea input iframe dialog svg math object canvas audio video map head title menu fieldset datalist xmp noembed noframes".split())
#: Names of readers' comments, as whole classes or ids.
_COMMENTS = frozenset("comment comments comment-list commentlist comments-area disqus_thread respond".split())
#: Words for what is no text, words that say where or how something stands, and words for the page's head.
_MARKS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice notices notification alert popup modal newsletter subscribe subscription signup share sharing social related recommended recommendations sidebar menu menus navbar nav navigation breadcrumb breadcrumbs footer pagination pager skip widget widgets toolbar disclaimer".split())
_PLACES = frozenset("main top bottom left right inner outer page site global primary secondary box bar block wrapper wrap container area section slot list links items buttons icons unit panel text content post article".split())
_HEADS = frozenset("header masthead".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
_ROOT_WORDS = frozenset("article post entry story content main".split())
#: Stands for marks and article elements among what can be deleted: hosts with few pages ask for them.
FEW = 1
_OUTSIDE, _MARKED = 1, 2
#: A row's number holds its task's above so many bits.
_ROW_BITS = 33


class _Node:
    __slots__ = ("tag", "parent", "drop", "mark", "label", "parts", "hash", "slot", "root", "size", "inside", "keep", "at", "flag")

    def __init__(self, tag: str, parent: _Node | None, label: str, drop: bool, mark: int, root: int):
        self.tag, self.parent, self.label, self.drop, self.mark, self.root = tag, parent, label, drop, mark, root
        self.parts: list = []  # hashes of children and texts, in order
        self.keep = self.inside = False
        self.hash, self.slot, self.size, self.at, self.flag = 0, 0, 0, -1, 0


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): unescape((m[2] or "").strip("\"'")) for m in _ATTR.finditer(raw)} if "=" in raw or "hidden" in raw else {}


def _mark(name: str) -> int:
    """2 for a class or id all of whose words say that this is no text, or where it stands; 1 where only words for a page's head do."""
    words = set(re.split("[-_]+", name)) - {""}
    if not words <= _MARKS | _PLACES | _HEADS:
        return 0
    return 2 if words & _MARKS else 1 if words & _HEADS else 0


def parse(html: str) -> tuple[list[_Node], list[tuple[_Node, str]]]:
    """(nodes in page order, blocks of text with the element in which each began)."""
    top = _Node("#root", None, "", False, 0, 0)
    nodes, stack, blocks = [top], [top], []
    open_: dict[str, int] = {}  # elements of each tag on the stack
    text: list[str] = []
    owner = top

    def flush() -> None:
        nonlocal owner
        if text:
            block = " ".join(unescape("".join(text)).split())
            text.clear()
            if block:
                blocks.append((owner, block))
                owner.parts.append(block)

    def add(raw: str) -> None:
        nonlocal owner
        if not raw:
            return
        if not text:
            if raw.isspace():
                return
            owner = stack[-1]
            while owner.tag in _INLINE and not owner.drop and not owner.mark and owner.parent is not None:
                owner = owner.parent
        text.append(raw)

    def close(to: int) -> None:
        if any(x.tag not in _INLINE or x.drop or x.mark for x in stack[to:]):
            flush()
        for x in stack[to:]:
            open_[x.tag] -= 1
        del stack[to:]

    at = 0
    while (m := _TOKEN.search(html, at)) is not None:
        add(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if not open_.get(tag):
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if tag in _INLINE and stack[i].tag not in _INLINE:
                    break  # an inline end tag doesn't close blocks
            continue
        if tag == "br":
            add(" ") if text else None
            continue
        if tag in _ENDS_P and open_.get("p"):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag not in _INLINE:
                    break
        if tag in _CLOSES and any(open_.get(x) for x in _CLOSES[tag][0]):
            ends, stop = _CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    close(i)
                    if tag not in ("tr", "dd", "dt"):
                        break
                elif stack[i].tag in stop:
                    break
        a = _attributes(m[3])
        names = f"{a.get('class', '')} {a.get('id', '')}".lower().split()
        drop = tag in _DROP or "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")) is not None or not _COMMENTS.isdisjoint(names)
        mark = 0  # 1: by the words for a page's head only
        if tag not in ("html", "body", "main", "article", *_PARAGRAPH):
            mark = 2 if a.get("role", "").lower() in _ROLES else max(map(_mark, names), default=0)
        root = 3 if tag == "article" else 2 if tag == "main" or a.get("role") == "main" else 1 if tag in ("div", "section", "td") and not _ROOT_WORDS.isdisjoint(names) else 0
        if tag not in _INLINE or drop or mark:
            flush()
        if tag in _VOID:
            continue
        node = _Node(tag, stack[-1], " ".join([tag, *names]), drop, mark, root)
        nodes.append(node)
        stack.append(node)
        open_[tag] = open_.get(tag, 0) + 1
        if tag in _RAW and not m[3].endswith("/"):  # inside script, style, ...: only its own end tag counts
            end = _RAW_END[tag].search(html, at)
            if not drop:
                add(html[at : end.start() if end else len(html)])
            at = end.end() if end else len(html)
            close(len(stack) - 1)
    add(html[at:])
    close(1)
    flush()
    return nodes, blocks


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _roots(nodes: list[_Node], blocks: list[tuple[_Node, str]]) -> int:
    """Tells which elements are inside of the page's articles, and takes marks from the articles, what they are in and their titles.

    3 for article elements, 2 for main ones, 1 for what is named so, 0 where the whole page stands for them.
    """
    under: set[_Node] = set()
    for n in nodes[1:]:
        n.drop |= n.parent.drop
        if n.mark or n.parent in under:
            under.add(n)
    for owner, text in blocks:
        if not owner.drop:
            owner.size += len(text)
    for n in reversed(nodes[1:]):  # page order puts children after their parent
        n.parent.size += n.size
    found = [n for n in nodes if n.root and n.size and not n.drop]
    plain = [n for n in found if n not in under] or found
    best = max((n.root for n in plain), default=0)
    roots = {n for n in plain if n.root == best} or {nodes[0]}
    for n in roots:
        at = n
        while at is not None and not at.keep:
            at.keep, at.mark = True, 0
            at = at.parent
    for n in nodes:
        n.inside = n in roots or (n.parent is not None and n.parent.inside)
        if n.inside and n.mark == 1:
            n.mark = 0
        if n.inside and n.tag == "h1":  # the title's element is none of those that marks tell from the text
            at = n
            while at is not None and not at.keep:
                at.keep, at.mark = at is not n, 0
                at = at.parent
    for n in nodes:
        up = n.parent
        n.flag = (0 if n.inside else _OUTSIDE) | (_MARKED if n.mark else 0) | (up.flag & _MARKED if up is not None else 0)
    return best


def _longest_elsewhere(found: list[tuple[str, int, int]], spans: dict[_Node, list[int]]) -> dict[_Node, int]:
    """By element the hash of the longest main block that isn't in it; others come last."""
    rank = lambda x: (not x[2], len(x[0]))
    none = ("", -1, 1)
    before, after = list(accumulate(found, lambda x, y: max(x, y, key=rank), initial=none)), list(accumulate(reversed(found), lambda x, y: max(x, y, key=rank), initial=none))
    known: dict[str, int] = {}
    out = {}
    for n, (first, last) in spans.items():
        text = max(before[first], after[len(found) - 1 - last], key=rank)[0]
        if text not in known:
            known[text] = _hash(text)
        out[n] = known[text]
    return out


def read_page(html: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int, int, bool, int]], int]:
    """(blocks, subtrees, the main text's hash); work and size are linear in the page.

    A block is (text, its nearest subtree or -1, flags for hosts with few pages).
    A subtree that could be template is (hash, slot or 0 in an article, by what the pages with
    it must differ, whether it is a paragraph of the article, the subtree around it or -1).
    Paragraphs must stand beside different longest blocks: near copies of an article,
    that differ in a date, share theirs.
    """
    nodes, blocks = parse(html)
    kind = _roots(nodes, blocks)
    for n in reversed(nodes):
        if n.parts:
            n.hash = _hash("\0".join([n.label, *map(str, n.parts)]))
            if n.parent is not None:
                n.parent.parts.append(n.hash)
    paragraph = lambda n: kind and n.inside and n.tag in _PARAGRAPH
    known: list[_Node] = []
    for n in nodes[1:]:
        n.slot, n.at = _hash(f"{n.parent.slot} {n.label}"), n.parent.at
        if n.parts and not n.keep and n.tag not in ("html", "body") and not n.drop and not (kind and n.inside and n.tag in _BOUND):
            if paragraph(n):
                n.hash = ~n.hash  # the same elsewhere is no evidence
            n.at = len(known)
            known.append(n)
    found, spans = [], {}
    for owner, text in blocks:
        if owner.drop:
            continue
        if owner.at >= 0 and paragraph(known[owner.at]):
            spans.setdefault(known[owner.at], [len(found), 0])[1] = len(found)
        found.append((text, owner.at, owner.flag))
    # paragraphs that hold paragraphs: a list item with two of them
    for n in reversed(known):
        up = known[n.parent.at] if n in spans and n.parent.at >= 0 else None
        if up is not None and paragraph(up):
            mine, its = spans[n], spans.setdefault(up, list(spans[n]))
            its[0], its[1] = min(its[0], mine[0]), max(its[1], mine[1])
    own = [t for t, _, flag in found if not flag] or [t for t, _, _ in found]
    sign, beside = _hash("\n".join(own)), _longest_elsewhere(found, spans)
    subtrees = [(n.hash, 0 if n.inside and kind > 1 else n.slot, beside.get(n, sign), n in beside, n.parent.at) for n in known]
    return found, subtrees, sign


_NODE = pa.list_(pa.struct([("h", pa.int64()), ("slot", pa.int64()), ("sign", pa.int64()), ("own", pa.bool_()), ("up", pa.int32())]))
_BLOCK = pa.list_(pa.struct([("text", pa.string()), ("at", pa.int32()), ("flag", pa.int32())]))
_NODES, _BLOCKS = "array<struct<h:long,slot:long,sign:long,own:boolean,up:int>>", "array<struct<text:string,at:int,flag:int>>"


def _parse_udf(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            read = [read_page(h) for h in read_texts(part.column(2))]
            blocks = [[dict(zip(("text", "at", "flag"), b, strict=True)) for b in found] for found, _, _ in read]
            nodes = [[dict(zip(("h", "slot", "sign", "own", "up"), x, strict=True)) for x in found] for _, found, _ in read]
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(blocks, _BLOCK), pa.array(nodes, _NODE), pa.array([x for _, _, x in read], pa.int64())], ["id", "url", "blocks", "nodes", "sign"])


def kept_blocks(blocks: list[dict], nodes: list[dict], gone: set[int]) -> list[str]:
    """The texts of blocks that stand in no subtree that goes, by hash or slot; flagged ones go if ``FEW`` does."""
    dead: list[bool] = []
    for n in nodes:  # a subtree stands behind the one around it
        dead.append(n["h"] in gone or n["slot"] in gone or (n["up"] >= 0 and dead[n["up"]]))
    few = FEW in gone
    return [b["text"] for b in blocks if not (b["at"] >= 0 and dead[b["at"]]) and not (few and b["flag"])]


def _deletions(fs, folder: str, part: int) -> dict[int, set[int]]:
    """By row what goes from the pages that task ``part`` has parsed: no more than it parsed."""
    from pyarrow import dataset
    from pyarrow.fs import FileType

    folder = f"{folder}/part={part}"
    if fs.get_file_info(folder).type == FileType.NotFound:
        return {}
    found: dict[int, set[int]] = {}
    table = dataset.dataset(folder, filesystem=fs, format="parquet").to_table(columns=["row", "h"])
    for row, h in zip(table["row"].to_pylist(), table["h"].to_pylist(), strict=True):
        found.setdefault(row, set()).add(h)
    return found


def _cut_udf(uri: str):
    """(id, url, row, blocks, nodes) -> texts."""

    def run(batches):
        fs, folder = filesystem(uri)
        part, known = -1, {}
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                piece = batch.slice(at, 2000)
                kept, n = [], []
                for row, blocks, nodes in zip(*(piece.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                    if row >> _ROW_BITS != part:
                        part = row >> _ROW_BITS
                        known = _deletions(fs, folder, part)
                    gone = known.get(row)
                    found = kept_blocks(blocks, nodes, gone) if gone else [b["text"] for b in blocks]
                    kept.append("\n".join(found))
                    n.append(len(blocks) - len(found))
                yield pa.RecordBatch.from_arrays([*piece.columns[:2], pa.array(kept, pa.string()), pa.array([len(t) for t in kept], pa.int64()), pa.array(n, pa.int64())], ["id", "url", "text", "n_chars", "n_deleted"])

    return run


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = 4, min_share: float = 0.1, own_share: float = 0.5, enough_pages: int = 50, slot_share: float = 0.25) -> DataFrame:
    """One row per page: id, url, text, n_chars, n_deleted (blocks that were template or marked).

    A subtree is template if it is on at least ``min_pages`` pages of its host
    with different main texts, and on ``min_share`` of all such pages, or
    the root of their number on hosts with more than the two agree on.  A
    paragraph, list item or table of the article must be on ``own_share`` of
    them, beside different text, on hosts of any size: a line that some articles
    share is theirs.

    A host with ``enough_pages`` of them shows its slots: all that stands in a
    slot goes if ``slot_share`` of it, by pages, is on two pages or more.  Other
    text of these hosts stays, outside of article elements too.  On hosts with
    fewer pages text outside of article elements (else main, else what is named
    so) goes, and what is marked by class, id or role.

    What goes from the pages of a task is written to a folder of its own, which
    the task that reads their blocks reads too; so the texts are never shuffled.

    Null html counts as empty, malformed UTF-8 as U+FFFD; a page without main
    text has the empty string; a null or odd url puts the page in a host of its
    own kind; repeated rows are pages of equal text.  White space in a block is
    one blank, blocks are joined by a line break.
    """
    path = shared_dir(pages.sparkSession)
    arrow_uri(path)
    src = pages.select(quoted(id_col).cast("long").alias("id"), quoted(url_col).alias("url"), quoted(html_col).alias("html"))
    parsed = src.mapInArrow(_parse_udf, f"id long, url string, blocks {_BLOCKS}, nodes {_NODES}, sign long")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    parsed = written(parsed.withColumn("host", F.xxhash64(host)).withColumn("row", F.monotonically_increasing_id()), f"{path}/parsed")

    texts = parsed.select("host", "sign").distinct().groupBy("host").agg(F.count("*").alias("texts"))
    # other keys than the aggregate's give this side an exchange of its own: a host with many subtrees can be split
    texts = written(texts.select(F.bitwise_not("host").alias("t"), "texts"), f"{path}/hosts")
    seen = parsed.select("host", F.explode("nodes").alias("n")).select("host", "n.h", "n.slot", "n.sign", "n.own").distinct()
    counts = seen.groupBy("host", "h", "slot", "own").agg(F.count("*").alias("n"))
    counts = written(counts.join(texts, F.bitwise_not("host") == F.col("t")).drop("t"), f"{path}/counts")
    enough = F.when(F.col("own"), own_share * F.col("texts")).otherwise(F.least(min_share * F.col("texts"), F.sqrt("texts")))
    subtrees = counts.groupBy("host", "h", "own", "texts").agg(F.sum("n").alias("n")).where((F.col("n") >= min_pages) & (F.col("n") >= enough)).select("host", "h")
    slots = counts.where((F.col("slot") != 0) & (F.col("texts") >= enough_pages)).groupBy("host", "slot")
    slots = slots.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("again")).where(F.col("again") >= slot_share * F.col("n")).select("host", "slot")
    few = texts.where(F.col("texts") < enough_pages).select(F.bitwise_not("t"), F.lit(FEW).cast("long"))
    template = written(subtrees.union(slots).union(few).toDF("t_host", "t_h").distinct(), f"{path}/template")

    keys = F.array_distinct(F.concat(F.transform("nodes", lambda n: n["h"]), F.transform("nodes", lambda n: n["slot"]), F.when(F.exists("blocks", lambda b: b["flag"] != 0), F.array(F.lit(FEW).cast("long"))).otherwise(F.array().cast("array<long>"))))
    asked = parsed.select("row", "host", F.explode(F.array_remove(keys, 0)).alias("h"))
    hit = asked.join(template, (F.col("host") == F.col("t_host")) & (F.col("h") == F.col("t_h")), "left_semi")
    # the texts don't move: a task that reads them reads the deletions of their rows as well
    hit = hit.select("row", "h", F.shiftright("row", _ROW_BITS).alias("part")).repartition("part").sortWithinPartitions("part", "row")
    written(hit, f"{path}/deletions", "part")
    slim = F.transform("nodes", lambda n: F.struct(n["h"].alias("h"), n["slot"].alias("slot"), n["up"].alias("up"))).alias("nodes")
    return parsed.select("id", "url", "row", "blocks", slim).mapInArrow(_cut_udf(f"{path}/deletions"), "id long, url string, text string, n_chars long, n_deleted long")
