"""Main-text extraction with a site style tree.

The DOMs of a host are merged by the signatures of their branches (chains of container elements with their classes).
For every branch the tree holds how its content and its presentation - the order of its children - are spread
over the host's pages. A branch's importance is composed of the entropies of its presentation and, weighted by
text, of the contents beneath it, times a prior: what looks and reads the same on every page is boilerplate, and so is,
even where it is drawn anew for each page, what HTML itself or its whole name calls navigation, advert, form, comment
or the like. Branches of low importance are removed from each page. What an article or main element holds has the
importance 1 unless the prior is low, for a host may repeat its articles.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from cubeweave.llm.url_templates import host_of
from cubeweave.rowkeys import with_row_keys
from cubeweave.scratch import materialize
from cubeweave.workers import bounded_batches

#: On fewer pages entropies say nothing and count as 1. Branches with less importance go.
LEAST_PAGES, LEAST_IMPORTANCE = 3, 0.2
#: Weight of what is beneath a branch against its own presentation; prior of a branch that is marked as no part of an article.
GAMMA, MARKED_PRIOR = 0.9, 0.1
#: Removed branches, 8 bytes each, up to which they are broadcast; beyond, each page's own are joined to it.
BROADCAST_BRANCHES = 250_000
#: Rows a task gathers before it hands on their counts.
HELD = 50_000

RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "xmp", "noembed"}
CONTAINERS = {"html", "body", "head", "div", "section", "article", "main", "aside", "nav", "header", "footer", "form", "fieldset", "ul", "ol", "dl", "table", "figure", "details", "dialog", "menu", "center", "select"}
BLOCKS = CONTAINERS - {"select"} | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "blockquote", "pre", "address", "hr", "figcaption", "summary", "legend", "option"}
MARKED = {"head", "nav", "footer", "aside", "form", "fieldset", "dialog", "menu", "select"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "form", "menu", "menubar", "alert"}
NAMED = set(
    "nav navbar navigation menu submenu sidebar sidenav footer ad ads advert adverts advertisement advertising adslot adsense sponsor sponsored banner cookie cookies consent gdpr notice notices promo promotion"
    " comment comments commentlist disqus discussion replies reply respond share sharing social related recommended breadcrumb breadcrumbs newsletter subscribe signup login popup modal overlay widget pagination pager toolbar masthead skip".split()
)
#: Words that may stand beside those in a name: "share-buttons" is marked, "social-science" is not.
BESIDE = set(
    "a an and area areas article articles author avatar background bar bars block blocks body bottom box boxes btn button buttons center col column columns container content count desktop divider entry fixed float floating footer form frame"
    " global grid group head header heading hidden holder icon icons image images img in inner item items js label large layer layout left link links list lists main media mini mobile module more of outer page panel placeholder post posts primary"
    " reader row rows secondary section sections site slot slots small static sticky stories story tab tabs text the thread title to top unit units user users vertical view visible wrap wrapper zone horizontal right".split()
)
#: Names of parts of a page that are also given to wrappers of the whole page: an article inside counts if there is no other.
LAYOUT = set("nav navbar navigation menu sidebar sidenav footer banner toolbar masthead overlay widget notice cookie cookies".split())
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
_raw_end = {t: re.compile(f"</{t}(?=[\\s/>]|$)", re.I) for t in RAW}
_name = re.compile(r"[a-zA-Z][^\s/>]*")
_attr = re.compile(r"""(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_word = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Block:
    __slots__ = ("branch", "cut", "link", "main", "text")

    def __init__(self, branch: str, main: int, cut: int, text: str, link: int) -> None:
        """cut: 0 not, 1 by a name that layouts give whole pages, 2 for good; main: 2 in an article, 1 in a main element."""
        self.branch, self.main, self.cut, self.text, self.link = branch, main, cut, text, link


def parse(page: str) -> tuple[list[Block], dict[str, list[str]]]:
    """The text blocks of a page in order, and for each branch the tags of its children."""
    blocks: list[Block] = []
    children: dict[str, list[str]] = {}
    stack: list[tuple[str, str, int, int]] = [("", "", 0, 0)]  # tag, branch, main, cut as in Block
    texts: list[str] = []
    links = [0, 0]  # depth, characters

    def close_block() -> None:
        if texts:
            text = " ".join("".join(texts).split())
            if text:
                _, branch, main, cut = stack[-1]
                blocks.append(Block(branch, main, cut, text, links[1]))
            texts.clear()
        links[1] = 0

    at, size = 0, len(page)
    while at < size:
        i = page.find("<", at)
        if i < 0:
            i = size
        if i > at:
            texts.append(html.unescape(page[at:i]))
            if links[0]:
                links[1] += i - at
        if i >= size:
            break
        nxt = page[i + 1 : i + 2]
        if nxt == "!" or nxt == "?":
            end = page.find("-->", i + 4) + 3 if page.startswith("<!--", i) else page.find(">", i) + 1
            at = end if end > i else size
            continue
        closing = nxt == "/"
        m = _name.match(page, i + 1 + closing)
        if not m:
            if closing:
                at = page.find(">", i) + 1 or size
            else:
                texts.append("<")
                at = i + 1
            continue
        tag = m[0].lower()
        end = page.find(">", m.end())
        if end < 0:
            break
        attrs = page[m.end() : end]
        for quote in "\"'":
            if attrs.count(quote) == 1 and (q := page.find(quote, end)) > 0 and "<" not in page[end:q] and (e := page.find(">", q)) > 0:
                end, attrs = e, page[m.end() : e]
        at = end + 1
        if tag in RAW:
            if not closing and not attrs.endswith("/"):
                m = _raw_end[tag].search(page, at)
                at = page.find(">", m.end()) + 1 or size if m else size
            continue
        if tag == "a":
            links[0] = 0 if closing else 1
        if tag == "br":
            texts.append(" ")
        if tag in BLOCKS:
            close_block()
            if stack[-1][0] == "p":  # a marked paragraph ends here
                del stack[-1]
            if not closing:
                children.setdefault(stack[-1][1], []).append(tag)
        if tag == "p" and not closing and attrs:
            sig, named = _signature(tag, attrs, stack[-1][2])
            if named:
                stack.append(("p", f"{stack[-1][1]}>{sig}", 0, 2))
            continue
        if tag not in CONTAINERS or tag in VOID:
            continue
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    if tag not in BLOCKS:
                        close_block()
                    del stack[k:]
                    break
        else:
            if tag not in BLOCKS:
                close_block()
            _, branch, main, cut = stack[-1]
            sig, named = tag, 0
            if attrs:
                sig, named = _signature(tag, attrs, main)
            if tag in MARKED or tag == "header" and not main:
                named = 2
            inner = 2 if tag == "article" else max(main, 1 if tag == "main" or "#main" in sig else 0)
            stack.append((tag, f"{branch}>{sig}", inner, max(cut, named)))
    close_block()
    return blocks, children


def _signature(tag: str, attrs: str, main: int) -> tuple[str, int]:
    """Tag with classes and id, without digits; whether they mark the element as no part of an article, as in Block.cut."""
    names: list[str] = []
    marked, soft, is_main = False, False, False
    for m in _attr.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            names += value.split()
        elif key == "role":
            marked |= value.lower() in ROLES
            is_main |= value.lower() == "main"
        elif key == "style":
            marked |= "display:none" in value.replace(" ", "").lower()
        else:
            marked |= key == "hidden" or value.lower() == "true"
    for n in names:
        words = {w.lower() for w in _word.findall(n)}
        if tag not in ("html", "body") and words <= NAMED | BESIDE:
            marked |= bool(words & NAMED - LAYOUT)
            soft |= bool(words & LAYOUT) or "header" in words and tag != "article" and not main
    return tag + "".join(f".{re.sub('[0-9]+', '#', n)}" for n in sorted(set(names))) + "#main" * is_main, 2 if marked else 1 if soft else 0


def main_text(blocks: list[Block], low: Callable[[str], bool]) -> str:
    """The blocks of the article, or of the main element, or else all that is left, joined by blank lines.

    low tells whether a branch, or one above it, has too little importance by its entropies.
    """
    left = [b for b in blocks if not b.cut and (b.main or not low(b.branch))]
    best = max((b.main for b in left), default=0)
    if best:
        left = [b for b in left if b.main == best]
    elif inside := [b for b in blocks if b.cut == 1 and b.main]:
        left = inside
    else:
        left = [b for b in left if 5 * b.link < 4 * len(b.text)]
    return "\n\n".join(b.text for b in left)


def no_branch(branch: str) -> bool:
    """For hosts of which nothing is known."""
    return False


def above(branch: str) -> list[str]:
    """The branch and those above it."""
    parts = branch.split(">")
    return [">".join(parts[: i + 1]) for i in range(1, len(parts))]


def branch_key(host: str, branch: str) -> int:
    """What F.xxhash64(host, branch) is."""
    code = lambda x: x.encode("utf-8", "surrogatepass")
    x = xxh64_intdigest(code(branch), xxh64_intdigest(code(host), 42))
    return x - (1 << 64) if x >> 63 else x


class Low:
    """Whether a branch of a host, or one above it, is among removed ones; answers are kept, up to HELD."""

    def __init__(self, keys: set[int]) -> None:
        self.keys, self.known = keys, {}

    def of(self, host: str) -> Callable[[str], bool]:
        def low(branch: str) -> bool:
            if (host, branch) not in self.known:
                if len(self.known) > HELD:
                    self.known.clear()
                self.known[host, branch] = any(branch_key(host, b) in self.keys for b in above(branch))
            return self.known[host, branch]

        return low if self.keys and host else no_branch


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, branch, kind (c: content, m: that of a marked branch, p: presentation), value, n, chars: counted within the task."""
    held: dict[tuple, list[int]] = {}

    def out() -> pa.RecordBatch:
        keys = list(zip(*held, strict=True)) or [[]] * 4
        n, chars = zip(*held.values(), strict=True) if held else ((), ())
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((*keys, n, chars), kinds, strict=True)], names=["host", "branch", "kind", "value", "n", "chars"])

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            blocks, children = parse(page or "")
            texts: dict[tuple[str, str], list[str]] = {}
            for b in blocks:
                texts.setdefault((b.branch, "m" if b.cut else "c"), []).append(b.text)
            for (branch, kind), t in texts.items():
                joined = "\n".join(t)
                one = held.setdefault((host, branch, kind, _hash(joined)), [0, 0])
                one[0] += 1
                one[1] += len(joined)
            for branch, tags in children.items():
                held.setdefault((host, branch, "p", _hash(" ".join(tags))), [0, 0])[0] += 1
            if len(held) > HELD:
                yield out()
                held.clear()
    yield out()


def style_tree(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The merged tree: host, branch, n_pages, marked, importance.

    Pages without a host have nothing in common and no branches. Articles are in the tree by their entropies; that
    their branches stay is up to main_text().
    """
    rows = pages.select(host_of(F.col(url_col).cast("string")).alias("host"), F.col(html_col).cast("string").alias("html")).filter("host <> ''")
    seen = rows.mapInArrow(_features, "host string, branch string, kind string, value long, n long, chars long")
    counts = seen.groupBy("host", "branch", "kind", "value").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))
    per = counts.groupBy("host", "branch", "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("e"), F.sum("chars").alias("chars"))
    entropy = F.when(F.col("m") >= LEAST_PAGES, 1 - F.col("e") / (F.col("m") * F.log("m"))).otherwise(F.lit(1.0))
    per = materialize(per.select("host", "branch", "kind", "m", "chars", entropy.alias("h")), "style-branches")  # it is read thrice
    over = F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("branch", ">"))), lambda i: F.array_join(F.slice(F.split("branch", ">"), F.lit(1), i), ">")))
    # a marked branch lends its contents to no branch above it
    content = per.filter("kind = 'c'").select("host", over.alias("branch"), "m", "h", "chars", F.lit(False).alias("marked"))
    content = content.unionAll(per.filter("kind = 'm'").select("host", "branch", "m", "h", "chars", F.lit(True)))
    content = content.groupBy("host", "branch").agg(F.max("m").alias("n_pages"), (F.sum(F.col("h") * F.col("chars")) / F.sum("chars")).alias("below"), F.min("marked").alias("marked"))
    shown = per.filter("kind = 'p'").select("host", "branch", F.col("h").alias("own"))
    both = content.join(shown, ["host", "branch"], "left")
    importance = F.when(F.col("own").isNull(), F.col("below")).otherwise((1 - GAMMA) * F.col("own") + GAMMA * F.col("below"))
    return both.select("host", "branch", "n_pages", "marked", (importance * F.when(F.col("marked"), MARKED_PRIOR).otherwise(1.0)).alias("importance"))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page.

    Null html is empty; pages without text get an empty one. Pages without a host are judged by their own marks
    alone. Malformed and cut-off pages are read as far as they go, pages of any length whole. Rows with null or
    repeated ids are kept and count as pages of their own; extra columns are ignored; an empty table gives no rows.
    """
    bounded_batches(pages.sparkSession)
    # a marked branch is below the least importance whatever its entropy, which a page shows by itself
    low = style_tree(pages, url_col=url_col, html_col=html_col).filter(~F.col("marked") & (F.col("importance") < LEAST_IMPORTANCE) & (F.col("branch") != ""))
    low = materialize(low.select(F.xxhash64("host", "branch").alias("key")), "style-tree")
    names = pages.columns
    if low.limit(BROADCAST_BRANCHES + 1).count() <= BROADCAST_BRANCHES:
        removed = pages.sparkSession.sparkContext.broadcast(low.toArrow()["key"].to_numpy())
        rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
        return _texts(rows.withColumn("host", host_of(F.col("url"))).withColumn("low", F.lit(None).cast("array<bigint>")), removed)
    keyed = with_row_keys(pages)
    url, page = (F.col(f"c{names.index(c)}").cast("string") for c in (url_col, html_col))
    own = keyed.select(host_of(url).alias("host"), page.alias("html"), "__file", "__row").mapInArrow(_own_branches, "__file string, __row long, key long")
    own = own.join(low, "key").groupBy(F.col("__file").alias("__f"), F.col("__row").alias("__r")).agg(F.collect_list("key").alias("low"))
    met = keyed.join(own, (F.col("__file") == F.col("__f")) & (F.col("__row") == F.col("__r")), "left")
    return _texts(met.select(F.col(f"c{names.index(id_col)}").cast("long").alias("page_id"), url.alias("url"), page.alias("html"), host_of(url).alias("host"), "low"), None)


def _own_branches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of each page's branches."""
    for batch in batches:
        out: tuple[list, list, list] = ([], [], [])
        for host, page, file, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            keys = {branch_key(host, x) for b in parse(page or "")[0] for x in above(b.branch)} if host else set()
            for column, value in zip(out, ([file] * len(keys), [row] * len(keys), keys), strict=True):
                column.extend(value)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["__file", "__row", "key"])


def _texts(rows: DataFrame, removed) -> DataFrame:
    """Of rows (page_id, url, html, host, low): low has a page's own removed branches where there is no broadcast of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everywhere = Low(set(removed.value.tolist())) if removed else None
        for batch in batches:
            texts = []
            for page, host, own in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                texts.append(main_text(parse(page or "")[0], (everywhere or Low(set(own or ()))).of(host)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
