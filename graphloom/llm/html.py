"""Main text of web pages by equivalence-class template deduction.

*Tokens* are container elements by their path of tags with class and id (digits as 0), held as a 64-bit hash of the path.
*Occurrence vectors*: for each host and token, a token's counts over all pages of the host go into one fingerprint, an
exclusive-or of hash(page, count), next to its support; it is aggregated over all pages, so no page set of a host meets in
one task.  *Classes*: tokens of a host with one fingerprint and support.  A class is valid if its tokens occur once on each
of its pages and every token's parent belongs to a valid class of at least its support; valid classes nest by that into the
host's template, one branch for each layout.  *Slots*: from the root the template is followed down while the slots below
hold most of the text; where it ends is a main slot.  A page's text is what its main slot holds (of several, the one that
holds most over the host), without what a token below holds on every page alike (the template's own text) and without
containers that name themselves menus, headers, footers, sidebars, notices, adverts, forms or comments.

*Marks* (``article``, ``main`` or these as a role) are hints: the way down ends at an article, and inside a slot a marked part
is preferred.  Only pages without a slot that has text (their layout is on less than ``COMMON`` of the host's pages, or
no element but the root occurs once) are read by marks alone.

Constant text needs ``OWN_PAGES`` pages.  Texts of ``script``, ``style``, ``title``, ``noscript``, ``template``, ``iframe`` and of the form
controls are no text of the page; all other elements are.  Null and empty html give an empty text, a null url is the host
"".  Repeated rows give repeated results; rows that share a page_id are counted like one page that occurs several times.
A page that ends early, or leaves elements open, is read to its end; a tag whose quotes don't close ends at the
first ">", as do all later ones of its page.  Time is linear in the page.  Only page_id, url and html are read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import stash, table

OWN_PAGES, COMMON, MOST_TEXT, BROADCAST_PATHS = 3, 0.05, 0.5, 1_000_000
_REST = r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)(%s)>|[^<]+|<"""
_TOKEN = re.compile(_REST % r"""(?:[^>"']|"[^"]*+"|'[^']*+')*+""", re.S)
_BROKEN = re.compile(_REST % "[^>]*", re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CONTAINER = frozenset("html body div section article main nav header footer aside form ul ol dl table figure blockquote details fieldset menu dialog center td".split())
_BREAK = _CONTAINER | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr th caption thead tbody tfoot pre br hr figcaption address summary legend option".split())
_RAW = frozenset("script style title textarea noscript iframe template select button".split())
_NOISE_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
_NOISE = frozenset("""ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu menus
 sidebar sidebars footer header masthead topbar breadcrumb breadcrumbs comment comments commentlist reply replies respond disqus cookie cookies consent
 gdpr notice notices alert alerts popup modal overlay share sharing social related recommended newsletter subscribe subscription signup login
 pagination pager widget widgets toolbar search contentinfo complementary form skip""".split())
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in _RAW}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SPLIT = re.compile(r"[^a-z0-9]+")
_DIGITS = re.compile(r"\d+")


class Segment(NamedTuple):
    path: int
    parent: int
    depth: int
    slot: int  # the element of ``mains`` that it is in, or 0
    scope: int  # 2 in an article, 1 in main, 0
    noise: bool
    text: str | None  # None at a block's bound
    opened: bool  # whether the container opens here


class _Open(NamedTuple):
    tag: str
    path: int
    parent: int
    depth: int
    slot: int
    scope: int
    noise: bool
    soft: bool  # ends at the next block


def _below(path: int, name: str) -> int:
    return xxhash.xxh64_intdigest(name, seed=path & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def segments(html: str, mains: frozenset[int] = frozenset()) -> Iterator[Segment]:
    """Texts and block bounds in page order, each with its container."""
    stack, count, pattern = [_Open("", 0, 0, 0, 0, 0, False, False)], Counter(), _TOKEN
    at, n, last = 0, len(html), html.rfind(">")

    def here(text: str | None, opened: bool = False) -> Segment:
        top = stack[-1]
        return Segment(top.path, top.parent, top.depth, top.slot, top.scope, top.noise, text, opened)

    def close(k: int) -> None:
        count.subtract(x.tag for x in stack[k:])
        del stack[k:]

    while at < n:
        if at > last and html[at] == "<" and (html[at + 1 : at + 2].isalpha() or html[at + 1 : at + 2] in ("/", "!", "?")) and not html.startswith("<!--", at):
            break  # a tag that never ends
        m = pattern.match(html, at)
        if m[0] == "<" and html[at + 1 : at + 2].isalpha() and pattern is _TOKEN:
            pattern = _BROKEN  # quotes that don't close
            m = pattern.match(html, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            text = m[0]
            if text[0] != "<" or text == "<":
                yield here(entities.unescape(text) if "&" in text else text)
            continue
        tag = tag.lower()
        if tag in _RAW and not m[1]:
            if not m[3].rstrip().endswith("/"):
                end = _RAW_END[tag].search(html, at)
                at = html.find(">", end.end()) + 1 if end and last >= end.end() else n
            if tag in ("select", "button", "textarea"):
                yield here(None)
            continue
        if tag in _BREAK:
            while stack[-1].soft:
                close(len(stack) - 1)
            yield here(None)
        if m[1]:
            if count[tag] > 0:
                k = next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag)
                close(k)
            continue
        top, container = stack[-1], tag in _CONTAINER
        if not container and (not m[3] or m[3].rstrip().endswith("/") or tag in _VOID):
            continue
        name, role, bad = tag, tag, container and (tag in _NOISE_TAGS or tag == "header" and top.scope < 2)
        if m[3]:
            for a in _NAMES.finditer(m[3]):
                value = (a[2] or a[3] or a[4] or "").lower()
                if a[1].lower() == "role":
                    role = value
                name += f"{'#' if a[1].lower() == 'id' else '.'}{_DIGITS.sub('0', value)}"
                if tag not in ("html", "body", "article", "main"):
                    words = set(_SPLIT.split(value))
                    bad = bad or not words.isdisjoint(_NOISE - {"header"} if top.scope == 2 else _NOISE)
        if not container:
            if bad:  # an element that names itself so, up to its end
                stack.append(top._replace(tag=tag, noise=True, soft=tag in _BREAK))
                count[tag] += 1
            continue
        scope = max(top.scope, 2 if role == "article" else 1 if role == "main" else 0)
        path = _below(top.path, name)
        stack.append(_Open(tag, path, top.path, top.depth + 1, path if path in mains else top.slot, scope, top.noise or bad, False))
        count[tag] += 1
        yield here(None, True)


def main_text(html: str, own: frozenset[int] = frozenset(), mains: list[int] | tuple[int, ...] = ()) -> str:
    """The page's text.  ``own``: paths whose text is the template's; ``mains``: the template's main slots, the largest first."""
    all_of = list(segments(html, frozenset(mains)))
    held = {x.slot for x in all_of if x.text and not x.noise and not x.text.isspace()}
    slot = next((m for m in mains if m in held), None)
    parts = all_of if slot is None else [x for x in all_of if x.slot == slot]
    best = max((x.scope for x in parts), default=0)
    return " ".join("".join(" " if x.text is None else x.text for x in parts if x.scope == best and not x.noise and x.path not in own).split())


def _host(url: str | None) -> str:
    m = re.match(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


_VECTORS = "host string, path long, parent long, depth long, support long, vector long, least long, most long, text_low long, text_high long, chars long, scope long"
_VECTOR_NAMES = [x.split()[0] for x in _VECTORS.split(", ")]
_VECTOR_SCHEMA = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in _VECTORS.split(", ")])


def vectors(pages: DataFrame) -> DataFrame:
    """For each host and token: its place, support, vector fingerprint, least and most occurrences on a page, least and greatest hash of its own text, its characters outside noise, and its scope."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[tuple[str, int], list[int]] = {}
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                host, counts, places, texts, chars = _host(url), Counter({0: 1}), {0: (0, 0, 0)}, defaultdict(list), Counter()
                for x in segments(html):
                    if x.opened:
                        counts[x.path] += 1
                        places[x.path] = x.parent, x.depth, x.scope
                    elif x.text is not None and not x.text.isspace():
                        texts[x.path].append(x.text.strip())
                        if not x.noise:
                            chars[x.path] += len(x.text)
                for path, k in counts.items():
                    v = xxhash.xxh64_intdigest(f"{page}:{k}") - (1 << 63)
                    t = xxhash.xxh64_intdigest("\n".join(texts[path])) - (1 << 63) if path in texts else 0
                    parent, depth, scope = places[path]
                    r = rows.get((host, path))
                    if r is None:
                        rows[host, path] = [parent, depth, 1, v, k, k, t, t, chars[path], scope]
                    else:
                        r[2] += 1
                        r[3] ^= v
                        r[4:] = min(r[4], k), max(r[5], k), min(r[6], t), max(r[7], t), r[8] + chars[path], max(r[9], scope)
            out = [(*k, *v) for k, v in rows.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(_VECTOR_SCHEMA)], schema=_VECTOR_SCHEMA)

    source = pages.select("page_id", "url", F.coalesce("html", F.lit("")))
    return source.mapInArrow(run, _VECTORS).groupBy("host", "path").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.sum("support").alias("support"), F.bit_xor("vector").alias("vector"), F.min("least").alias("least"),
        F.max("most").alias("most"), F.min("text_low").alias("text_low"), F.max("text_high").alias("text_high"), F.sum("chars").alias("chars"), F.max("scope").alias("scope"))


def deduce(tokens: list[dict]) -> tuple[list[int], list[int]]:
    """(paths whose text is the template's own, its main slots, the largest first) from a host's common tokens."""
    classes: dict[tuple[int, int], list[dict]] = defaultdict(list)
    for t in tokens:
        classes[t["support"], t["vector"]].append(t)
    valid: dict[int, dict] = {}
    for (support, _), members in sorted(classes.items(), key=lambda c: (-c[0][0], min(m["depth"] for m in c[1]), c[0][1])):
        names = {m["path"] for m in members}
        if all(m["least"] == m["most"] == 1 for m in members) and all(
            not m["path"] or m["parent"] in names or m["parent"] in valid and valid[m["parent"]]["support"] >= support for m in members):
            valid.update({m["path"]: m for m in members})
    constant = {p for p, m in valid.items() if p and m["support"] >= OWN_PAGES and m["text_low"] == m["text_high"] != 0}
    below: Counter = Counter()
    for everything in (False, True):  # a host that has nothing but constant text: its pages are copies
        below.clear()
        for t in sorted(tokens, key=lambda t: -t["depth"]):
            below[t["path"]] += t["chars"] if everything or t["path"] not in constant else 0
            if t["path"]:
                below[t["parent"]] += below[t["path"]]
        if below[0]:
            break
    children: dict[int, dict[tuple[int, int], list[int]]] = defaultdict(lambda: defaultdict(list))
    for p, m in valid.items():
        if p and below[p]:
            children[m["parent"]][m["support"], m["vector"]].append(p)
    todo, mains, above = [0] if 0 in valid and below[0] else [], [], {0}
    while todo:
        p = todo.pop()
        picks = []
        for group in children[p].values() if valid[p]["scope"] < 2 else ():
            top = max(group, key=lambda c: (below[c], c))
            if below[top] > MOST_TEXT * sum(below[c] for c in group):
                picks.append(top)
        if sum(below[c] for c in picks) > MOST_TEXT * below[p]:
            todo += picks
            above.add(p)
        elif p:
            mains.append(p)
    mains.sort(key=lambda p: (-below[p] / valid[p]["support"], p))
    return sorted(constant - above - set(mains)), mains


def templates(pages: DataFrame) -> DataFrame:
    """(host, own, mains) of every host."""
    v = stash(vectors(pages), "vectors")
    sizes = v.filter("path = 0").select(F.col("host").alias("h"), F.col("support").alias("pages"))
    common = v.join(sizes, F.col("host") == F.col("h")).filter(F.col("support") >= COMMON * F.col("pages"))
    # a host's common tokens are at most a page's tokens divided by COMMON
    per_host = common.groupBy("host").agg(F.collect_list(F.struct(*_VECTOR_NAMES[1:])).alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, *deduce(t)) for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())))], names=["host", "own", "mains"])

    return per_host.mapInArrow(run, "host string, own array<long>, mains array<long>")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``."""
    found = stash(templates(pages), "templates")
    if (found.agg(F.sum(20 + F.size("own") + F.size("mains"))).first()[0] or 0) <= BROADCAST_PATHS:  # 8 bytes each
        found = F.broadcast(found)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#:]*)", 1))
    # a hot host is on the streamed side of this join, which adaptive execution splits
    joined = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host")).join(found, "host", "left").select("page_id", "url", "html", "own", "mains")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, frozenset(own or ()), mains or ()) for h, own, mains in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op3_html_extraction": op3_html_extraction}
SQL: dict[str, str] = {}
