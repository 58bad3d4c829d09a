"""HTML extraction by a site style tree.

The pages of a host are merged into one tree. An element node is a tag with its
presentational attributes; a style node is the sequence of element nodes that
are the children of one, and an element node of the tree has all the style
nodes that pages have at that place. An element node that ``m`` pages have is
important if they present it in many ways (the entropy of its style nodes to
base m), or if what it holds differs: a leaf's importance is 1 less the mean
entropy, over pages, of its features (sentences, link targets, image sources).
Importance is combined from the leaves up, ``gamma`` damping by the number of
style nodes; what only one page has counts 1. A node is noise if it and all
nodes under it are below ``threshold``; those branches are cut out of each page.

The tree is never gathered: pages send hashed (place, presentation) pairs, which
are counted, and only places that two pages share, which are few, are combined,
host by host. Both passes parse a page once.
"""

from __future__ import annotations

import html as _html
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.session import checkpointed, ship

GAMMA = 0.9
THRESHOLD = 0.2
#: Noise lists of up to so many bytes in all are broadcast.
BROADCAST_BYTES = 32 << 20

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea iframe".split())
_ENDS = {t: re.compile(f"</{t}", re.I) for t in _RAW}
_DROP = frozenset("script style noscript template iframe head".split())
_LOOK = frozenset("class id style align valign width height color bgcolor border role face size".split())
_BLOCK = frozenset("address article aside blockquote body br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
#: Start tags that end an open element, up to the nearest of the third column.
_CLOSES = {"p": ({"p"}, {"div", "td", "li", "article", "section", "body", "blockquote"}), "li": ({"li"}, {"ul", "ol"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}
_CLOSES |= {t: ({"p"}, {"div", "td", "li", "article", "section", "body", "blockquote"}) for t in ("div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "article", "section", "footer", "nav", "blockquote", "pre")}
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "look", "kids", "text", "link")

    def __init__(self, tag: str, look: str = "", text: str | None = None, link: str | None = None):
        self.tag, self.look, self.text, self.link = tag, look, text, link
        self.kids: list[Node] = []


def parse(page: str) -> Node:
    """A tolerant DOM: unknown end tags are ignored, missing ones supplied."""
    root = Node("#root")
    stack = [root]
    at = 0

    def add_text(raw: str) -> None:
        if raw and not raw.isspace():
            text = _SPACE.sub(" ", _html.unescape(raw) if "&" in raw else raw)
            stack[-1].kids.append(Node("#text", text=text))

    while True:
        m = _TAG.search(page, at)
        if not m:
            add_text(page[at:])
            return root
        add_text(page[at : m.start()])
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        tag = name.lower()
        if m.group(1):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in _CLOSES:
            ends, bound = _CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    del stack[i:]
                    break
                if stack[i].tag in bound:
                    break
        look, link, raw = "", None, m.group(3)
        if raw and not raw.isspace():
            found = [(k.lower(), a or b or c) for k, a, b, c in _ATTR.findall(raw)]
            look = ";".join(sorted(f"{k}={v}" for k, v in found if k in _LOOK))
            link = next((v for k, v in found if k == ("href" if tag == "a" else "src")), None)
        node = Node(tag, look, link=link)
        stack[-1].kids.append(node)
        if tag in _RAW:
            m = _ENDS[tag].search(page, at)
            end = m.start() if m else len(page)
            if tag == "textarea":
                node.kids.append(Node("#text", text=page[at:end]))
            close = page.find(">", end)
            at = len(page) if close < 0 else close + 1
        elif tag not in _VOID and not (raw and raw.endswith("/")):
            stack.append(node)


def _hash(*parts) -> int:
    return hash(parts) & 0x7FFFFFFFFFFFFFFF


def stable(text: str) -> int:
    """A hash of a string that every process agrees on."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def walk(host: str, root: Node):
    """Yield (id, parent style id, depth, node, style id, number of children)
    for each element node of a page, parents first. Ids are hashes of ints, so
    they are the same in every process."""
    stack = [(root, stable(host), 0, 0)]
    while stack:
        node, eid, parent, depth = stack.pop()
        if node.tag in _DROP:
            continue
        kids = [k for k in node.kids if k.tag not in _DROP]
        names = [stable(k.tag + " " + k.look) for k in kids]
        sid = _hash(eid, *names) if kids else 0
        yield eid, parent, depth, node, sid, len(kids)
        for i, k in enumerate(kids):
            stack.append((k, _hash(sid, i), sid, depth + 1))


def features(node: Node) -> list[str]:
    out = _SENTENCE.split(node.text) if node.text else []
    return [s for s in out if s] + ([node.link] if node.link else [])


def host_of(url: str = "url") -> Column:
    """The host in lower case, without user, port and final dot; '' for none."""
    h = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.regexp_replace(F.lower(h), r"\.$", "")


def _observe(batches):
    """(host, node, parent, depth, child, kids, kind, n, s): for each place and
    presentation (kind 0) or feature (kind 1), pages or occurrences n, and the
    sum s of c ln c over pages with c occurrences. Summed over the task."""
    seen: dict = {}

    def flush():
        rows = list(seen.items())
        seen.clear()
        for i in range(0, len(rows), 50_000):
            part = rows[i : i + 50_000]
            cols = list(zip(*((*k, *v) for k, v in part), strict=True))
            types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["host", "node", "parent", "depth", "child", "kids", "kind", "n", "s"])

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for eid, parent, depth, node, sid, kids in walk(host, parse(page or "")):
                key = (host, eid, parent, depth, sid, kids, 0)
                got = seen.get(key)
                seen[key] = (1, 0.0) if got is None else (got[0] + 1, 0.0)
                if not kids:
                    own: dict = {}
                    for f in features(node):
                        h = stable(f)
                        own[h] = own.get(h, 0) + 1
                    for h, c in own.items():
                        key = (host, eid, 0, 0, h, 0, 1)
                        got = seen.get(key, (0, 0.0))
                        seen[key] = (got[0] + c, got[1] + c * math.log(c))
            if len(seen) > 400_000:
                yield from flush()
    yield from flush()


def importances(pdf: pd.DataFrame, gamma: float = GAMMA) -> pd.DataFrame:
    """Composite importance, and the largest under each place, of a host.

    Columns: node, parent, depth, m, styles, entropy (nats), single (share of
    pages with a style of their own), shared (pairs of style and share), leaf
    (mean of the features' entropy, in nats). Places that aren't there count 1.
    """
    pdf = pdf.sort_values("depth", ascending=False, kind="stable")
    style: dict[int, list[float]] = {}
    nodes, values, most = [], [], []
    for r in pdf.itertuples(index=False):
        base = math.log(r.m)
        if r.shared is None or not len(r.shared):
            value = 1 - min(1.0, r.leaf / base) if r.styles <= 1 and r.is_leaf else 1.0
            top = value
        else:
            own = min(1.0, r.entropy / base)
            below, top = r.single, (1.0 if r.single > 0 else 0.0)
            for sid, share, kids in r.shared:
                got = style.get(sid)
                if got is None:
                    mean, up = 1.0, 1.0
                else:
                    # Children that one page alone has don't occur in a shared style.
                    mean, up = got[0] / kids, got[1]
                below += share * mean
                top = max(top, up)
            damp = gamma**r.styles
            value = (1 - damp) * own + damp * below
            top = max(top, value)
        nodes.append(r.node)
        values.append(value)
        most.append(top)
        acc = style.setdefault(r.parent, [0.0, 0.0])
        acc[0] += value
        acc[1] = max(acc[1], top)
    return pd.DataFrame({"node": np.array(nodes, np.int64), "parent": pdf["parent"].to_numpy(np.int64), "importance": np.array(values, float), "most": np.array(most, float)})


def style_tree(pages: DataFrame, gamma: float = GAMMA) -> DataFrame:
    """(host, node, parent, importance, most) of the places that two or more
    pages of a host share."""
    ship(pages.sparkSession)
    seen = pages.select(host_of().alias("host"), "html").mapInArrow(_observe, "host string, node long, parent long, depth int, child long, kids int, kind int, n long, s double")
    # Tasks have summed already: one exchange by node serves both groupings.
    seen = seen.repartition("node").groupBy("host", "node", "kind", "child").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.max("kids").alias("kids"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    style = F.when(F.col("kind") == 0, F.col("n"))
    places = seen.groupBy("host", "node").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.sum(style).alias("m"), F.count(style).alias("styles"),
        (F.log(F.sum(style)) - F.sum(style * F.log(style)) / F.sum(style)).alias("entropy"), (F.coalesce(F.sum(F.when((style == 1) & (F.col("child") != 0), 1)), F.lit(0)) / F.sum(style)).alias("single"),
        F.max((F.col("kind") == 0) & (F.col("child") == 0)).alias("is_leaf"), F.collect_list(F.when((style > 1) & (F.col("child") != 0), F.struct(F.col("child").alias("sid"), style.cast("double").alias("n"), "kids"))).alias("shared"),
        F.avg(F.when(F.col("kind") == 1, F.log("n") - F.col("s") / F.col("n"))).alias("leaf"),
    ).where("m > 1")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(leaf=pdf["leaf"].fillna(math.inf))  # nothing in it on any page
        pdf["shared"] = [[(x["sid"], x["n"] / m, x["kids"]) for x in (s if s is not None else ())] for s, m in zip(pdf["shared"], pdf["m"], strict=True)]
        return importances(pdf, gamma).assign(host=pdf["host"].iloc[0])[["host", "node", "parent", "importance", "most"]]

    return places.groupBy("host").applyInPandas(run, "host string, node long, parent long, importance double, most double")


def text_of(host: str, page: str, noise: set[int]) -> tuple[str, int]:
    """The page's text without its noise branches, and how many those were."""
    out: list[str] = []
    cut = 0
    stack: list = [(parse(page), stable(host))]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        node, eid = item
        if node.tag in _DROP:
            continue
        if eid in noise and node.tag != "#root":
            cut += 1
            continue
        if node.text is not None:
            out.append(node.text)
            continue
        kids = [k for k in node.kids if k.tag not in _DROP]
        block = node.tag in _BLOCK
        if block:
            out.append("\n")
            stack.append("\n")
        sid = _hash(eid, *[stable(k.tag + " " + k.look) for k in kids]) if kids else 0
        for i in range(len(kids) - 1, -1, -1):
            stack.append((kids[i], _hash(sid, i)))
    return "\n".join(s for line in "".join(out).split("\n") if (s := line.strip())), cut


def extract(pages: DataFrame, threshold: float = THRESHOLD, gamma: float = GAMMA) -> DataFrame:
    """``pages`` with ``text`` (lines of the blocks that are left) and
    ``n_removed`` (branches cut out), without ``html``.

    A page whose host has no other page loses nothing. A null or empty html has
    the text '' and nothing removed; pages without a host in their url share the
    host ''. Repeated rows count as pages of their own, so what only copies of
    one page have counts as shared. Columns of these names are replaced, others
    stay. Pages of any length and depth are read whole; an empty table stays
    empty.
    """
    ship(pages.sparkSession)
    tree = checkpointed(style_tree(pages, gamma))
    low = tree.where(F.col("most") < threshold).select("host", "node")
    noise = checkpointed(low.groupBy("host").agg(F.collect_set("node").alias("_noise")).withColumnRenamed("host", "_host"))
    rest = pages.drop("text", "n_removed", "_host", "_noise", "_out").withColumn("_host", host_of())
    if (noise.agg(F.sum(F.size("_noise") * 8 + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        noise = noise.hint("broadcast")
    joined = rest.join(noise, "_host", "left")

    @F.arrow_udf("text string, n_removed int")
    def clean(hosts: pa.Array, htmls: pa.Array, lists: pa.Array) -> pa.Array:
        texts, cuts, kept = [], [], {}
        for host, page, i in zip(hosts.to_pylist(), htmls.to_pylist(), range(len(lists)), strict=True):
            if host not in kept:
                kept[host] = set(lists[i].as_py() or ())
            text, cut = text_of(host, page or "", kept[host])
            texts.append(text)
            cuts.append(cut)
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(cuts, pa.int32())], names=["text", "n_removed"])

    joined = joined.withColumn("_out", clean.asNondeterministic()("_host", "html", "_noise"))
    return joined.select(*[F.col(f"`{c}`") for c in rest.columns if c not in ("html", "_host")], "_out.*")
