"""Main text of HTML pages: a suffix array of each host finds its boilerplate, article marks narrow what is left.

A page is read tag by tag into blocks. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are known by element, role, whole class words or id and left out, but not an element that holds the article. The token streams of all pages of a host are then laid
side by side and their suffixes sorted by their leading `RUN` tokens (the shuffle deals suffixes with equal leading tokens to
one place, so a host is never gathered in one task). A run of `RUN` tokens that lies on `SHARE` of the host's distinct pages,
and on two at least, is boilerplate; pages of equal text are one page there. Every token that such a run covers goes, and the
others stay, block by block. Where the page marks an article (`article`, `main`), only its blocks are kept of those.

Before suffixes are shuffled, those that cannot be boilerplate are left out. In each 9 neighbouring windows of 4 tokens the
one of the least hash is picked, so any two places of one run of 12 tokens have a picked window in common. Picked windows are
counted once a row, and only suffixes go on whose run holds one that enough pages of the host have; a bitmap of 8 MB says so,
which may say yes too often but never no wrongly. What is enough comes from a table of 2**18 slots, the least of a slot's hosts.

Character references are decoded, white space inside a block is one space, blocks are joined by two line feeds. `br` and
table cells part words, not blocks. Unclosed elements end as HTML has it: with the next sibling, their parent or the page. Null, empty and textless pages have the text "".
Rows that repeat a page_id are read each for itself; a null url counts as host "".
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailveil.llm import rows, words

RUN, SHARE = 12, 0.3
PICKED, BITS, SALTS, SLOTS, LEVEL, CUT = 4, 26, 16, 18, 5, 29

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?][^>]*+>|([^<]++|<)""", re.DOTALL)
_RAW = {"script", "style", "textarea", "title", "xmp"}
_OUT = {"head", "nav", "footer", "aside", "form", "noscript", "template", "iframe", "svg", "button", "select", "dialog", "menu", "annotation", "annotation-xml"}
_ARTICLE = {"article", "main"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
          "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul", "xmp"}
_SPACE = {"br", "td", "th", "caption", "option"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that end their unclosed parents, as closing tags of the others do not.
_CLOSERS = _BLOCK | {"td", "th", "caption", "option", "optgroup", "select", "button", "template", "object", "colgroup"}
#: Start tags that end an open element of these names, as far out as the last of the second set.
_IN_P = ({"p"}, {"td", "th", "caption", "table", "button", "object", "template", "html"})
_IMPLIED = dict.fromkeys(_BLOCK - {"body", "caption", "dd", "dt", "figcaption", "head", "html", "legend", "li", "tbody", "tfoot", "thead", "tr"}, _IN_P) | {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), **dict.fromkeys(("tbody", "thead", "tfoot"), ({"tbody", "thead", "tfoot", "caption"}, {"table"}))}
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion", "sidebar", "menu", "navbar", "nav", "navigation",
          "breadcrumb", "breadcrumbs", "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "overlay", "newsletter", "subscribe", "share", "sharing", "social",
          "related", "recommended", "comment", "comments", "disqus", "reply", "replies", "respond", "pagination", "pager", "login", "search", "footer", "masthead", "toolbar", "skip",
          "ad-banner", "ad-box", "ad-container", "ad-slot", "ad-unit", "ad-wrapper", "ads-container", "banner-ad", "google-ad", "cookie-banner", "cookie-bar", "cookie-notice", "cookie-consent",
          "consent-banner", "gdpr-banner", "site-footer", "page-footer", "main-footer", "site-nav", "main-nav", "main-menu", "nav-menu", "nav-bar", "primary-nav", "top-nav", "site-navigation",
          "main-navigation", "post-navigation", "page-navigation", "side-bar", "left-sidebar", "right-sidebar", "sidebar-left", "sidebar-right", "primary-sidebar", "share-buttons", "share-bar",
          "share-links", "social-share", "social-links", "social-icons", "social-media-links", "sharing-buttons", "related-posts", "related-articles", "related-links", "related-content",
          "related-stories", "recommended-posts", "recommended-articles", "comment-list", "comment-form", "comments-area", "comments-section", "comment-section", "comment-respond",
          "disqus-thread", "newsletter-signup", "newsletter-form", "subscribe-form", "subscribe-box", "login-form", "login-box", "search-form", "search-box", "search-bar", "skip-link",
          "skip-to-content", "skip-nav", "promo-box", "sponsored-content", "sponsored-links"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}


def _left_out(tag: str, attributes: str) -> bool:
    """Whether an element's attributes name it furniture: whole class words, or its id, which on a heading is only an anchor."""
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if (name == "class" or name == "id" and tag not in _HEADINGS) and not _NAMES.isdisjoint(value.replace("_", "-").split()):
            return True
        if name == "role" and value in _ROLES or name == "hidden" and m.end() == m.end(1) or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def _close(stack: list[int], tags: list[str], opened: Counter, names: set[str], scope: set[str], alone: bool = False) -> None:
    """End the innermost open element of one of `names` inside the innermost of `scope`, with all that it holds or `alone`."""
    if not any(opened[name] for name in names):
        return
    for k in range(len(stack) - 1, 0, -1):
        tag = tags[stack[k]]
        if tag in names:
            last = k + 1 if alone else len(stack)
            opened.subtract(tags[e] for e in stack[k:last])
            del stack[k:last]
            return
        if tag in scope:
            return


def blocks(page: str) -> tuple[list[str], list[bool]]:
    """The blocks of text left when furniture is out, and whether each lies in a marked article.

    An element that is known as furniture stays if the only articles of the page lie in such elements and it holds the longest.
    """
    tags, parents, furniture, articles, lengths = [""], [0], [False], [False], [0]  # the elements; the first one is the page
    stack, opened = [0], Counter()
    pieces: list[tuple[int, str | None]] = []  # an element and its text; None parts blocks
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        if not m:  # a tag that never ends
            break
        at = m.end()
        if m[4] is not None:
            pieces.append((stack[-1], m[4]))
            lengths[stack[-1]] += len(m[4])
            continue
        if not m[2]:
            continue
        tag, closing = m[2].lower(), m[1] == "/"
        if closing:
            _close(stack, tags, opened, {tag}, {"table"} if tag in ("p", "li", "dt", "dd") else set(), tag not in _CLOSERS)
        elif tag in _RAW:
            stop = re.compile(f"</{tag}[^>]*+>", re.IGNORECASE).search(page, at)
            if tag == "xmp":
                text = page[at:stop.start() if stop else end]
                pieces += [(stack[-1], None), (stack[-1], text.replace("&", "&amp;")), (stack[-1], None)]
                lengths[stack[-1]] += len(text)
            at = stop.end() if stop else end
            continue
        else:
            if tag in _IMPLIED:
                _close(stack, tags, opened, *_IMPLIED[tag])
            if tag == "body":  # an unclosed head
                _close(stack, tags, opened, {"head"}, set())
            if tag not in _VOID and not m[3].endswith("/"):
                up = stack[-1]
                own = tag in _OUT or tag == "header" and not any(articles[k] for k in stack) or tag not in ("html", "body") and bool(m[3].strip()) and _left_out(tag, m[3])
                stack.append(len(tags))
                tags.append(tag)
                opened[tag] += 1
                parents.append(up)
                furniture.append(own)
                articles.append(tag in _ARTICLE)
                lengths.append(0)
        if tag in _BLOCK:
            pieces.append((stack[-1], None))
        elif tag in _SPACE:
            pieces.append((stack[-1], " "))
    hidden, inside_of = _standing(parents, furniture, articles, lengths)
    found: list[str] = []
    inside: list[bool] = []
    text: list[str] = []
    here = False
    for element, piece in [*pieces, (0, None)]:
        if piece is not None and hidden[element]:
            continue
        if text and (piece is None or inside_of[element] != here):
            block = " ".join(html.unescape("".join(text)).split())
            if block:
                found.append(block)
                inside.append(here)
            text.clear()
        if piece is not None:
            here = inside_of[element]
            text.append(piece)
    return found, inside


def _standing(parents: list[int], furniture: list[bool], articles: list[bool], lengths: list[int]) -> tuple[list[bool], list[bool]]:
    """Whether each element is left out, and whether it is in an article."""
    hidden, inside = furniture.copy(), articles.copy()
    for k in range(1, len(parents)):  # parents come first
        hidden[k] = hidden[k] or hidden[parents[k]]
        inside[k] = inside[k] or inside[parents[k]]
    own = [k for k in range(len(parents)) if articles[k] and not furniture[k]]
    if not own or any(not hidden[k] for k in own):
        return hidden, inside
    whole = lengths.copy()
    for k in range(len(parents) - 1, 0, -1):
        whole[parents[k]] += whole[k]
    most, freed = max(own, key=lambda k: whole[k]), furniture.copy()
    k = most
    while k:
        freed[k] = False
        k = parents[k]
    hidden = freed
    for k in range(1, len(parents)):
        hidden[k] = hidden[k] or hidden[parents[k]]
    return hidden, inside


PARSED = pa.schema([("row", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("content", pa.int64()), ("blocks", pa.list_(pa.string())), ("inside", pa.list_(pa.bool_()))])
WINDOWS = pa.schema([("window", pa.int64())])
HELD = pa.schema([*PARSED, ("host", pa.int64()), ("at", pa.list_(pa.int32())), ("leads", pa.list_(pa.int64()))])
TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def parse(pages: DataFrame) -> DataFrame:
    """row, page_id, url, a hash of the page's whole text, its blocks, and which of them an article holds."""

    def work(row, page_id, url, page):
        found = [blocks(p or "") for p in page.to_pylist()]
        content = [int.from_bytes(hashlib.blake2b("\n".join(b).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True) for b, _ in found]
        return {"row": row, "page_id": page_id, "url": url, "content": content, "blocks": [b for b, _ in found], "inside": [i for _, i in found]}

    return rows.per_batch(pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), "url", "html"), PARSED, work)


def picked(hashes: np.ndarray, offsets: np.ndarray, host: np.ndarray, run: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the windows of `size` tokens that are least among the neighbours of some run; equal runs pick equally."""
    values = words.mix(words.window_hashes(hashes, size) ^ host[np.searchsorted(offsets, np.arange(max(0, len(hashes) - size + 1)), "right") - 1])
    starts = np.flatnonzero(words.within(offsets, run))
    if not len(starts):
        return starts, values[:0]
    least, at = values[starts], starts.copy()
    for k in range(1, run - size + 1):
        less = values[starts + k] < least
        least, at = np.where(less, values[starts + k], least), np.where(less, starts + k, at)
    at = np.unique(at)
    return at, values[at]


def _hosts(parsed: DataFrame) -> DataFrame:
    """The parsed pages with a hash of their host and their text in one."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    return parsed.withColumns({"host": F.xxhash64(host), "text": F.array_join("blocks", " ")})


def _as_hash(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def least_pages(streams: DataFrame, share: float) -> DataFrame:
    """host and least: on how many of its distinct pages boilerplate lies."""
    distinct = streams.where(F.size("blocks") > 0).select("host", "content").distinct()
    return distinct.groupBy("host").agg(F.greatest(F.lit(2), F.ceil(F.count("*") * F.lit(share))).alias("least"))


def met_often(streams: DataFrame, least: DataFrame, run: int) -> np.ndarray:
    """A bitmap of the picked windows that enough rows of a host hold; 35 bits of a hash tell them apart, and equal ones add up."""
    level = F.floor(F.log2(F.min("least").cast("double")) + 1e-9).cast("int")
    slots = least.groupBy(F.col("host").bitwiseAND(F.lit((1 << SLOTS) - 1)).alias("slot")).agg(level.alias("level")).toPandas()  # 2**SLOTS rows at most
    levels = np.ones(1 << SLOTS, np.uint64)
    levels[slots["slot"].to_numpy(np.int64)] = np.minimum(slots["level"].to_numpy(np.int64), (1 << LEVEL) - 1)
    levels = streams.sparkSession.sparkContext.broadcast(levels)

    def work(host, text):
        hashes, offsets = words.word_hashes(text, words.SPACED)
        at, values = picked(hashes, offsets, _as_hash(host), run, min(PICKED, run))
        owner = np.searchsorted(offsets, at, "right") - 1
        order = np.lexsort((values, owner))
        values, owner = values[order], owner[order]
        first = np.concatenate([[True], (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])]) if len(values) else np.zeros(0, bool)
        level = levels.value[_as_hash(host)[owner] & np.uint64((1 << SLOTS) - 1)]
        return {"window": (values >> np.uint64(CUT) << np.uint64(LEVEL) | level)[first].view(np.int64)}

    windows = rows.per_batch(streams.select("host", "text"), WINDOWS, work).groupBy("window").agg(F.count("*").alias("n"))
    often = windows.where(F.expr(f"n >= shiftleft(1L, cast(window & {(1 << LEVEL) - 1} as int))"))
    return rows.bitmap(streams.sparkSession, often.select(F.shiftrightunsigned("window", LEVEL).alias("window")), "window", BITS)


def suffixes(host: np.ndarray, text: pa.Array, maybe: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first token and leading tokens' hash of each suffix whose run may be on enough pages of the host."""
    size = min(PICKED, run)
    hashes, offsets = words.word_hashes(text, words.SPACED)
    at, values = picked(hashes, offsets, host, run, size)
    hot = np.zeros(len(hashes) + 1, np.int64)
    hot[at[rows.maybe_in(maybe, values >> np.uint64(CUT))] + 1] = 1
    hot = np.cumsum(hot)
    at = np.flatnonzero(words.within(offsets, run))
    at = at[hot[at + run - size + 1] > hot[at]]
    owner = np.searchsorted(offsets, at, "right") - 1
    lead = words.mix(words.window_hashes(hashes, run)[at] ^ host[owner]) if len(at) else np.zeros(0, np.uint64)
    return owner, at - offsets[owner], lead


def repeated(held: DataFrame, least: DataFrame) -> DataFrame:
    """row and the first tokens of runs that lie on `least` of the host's distinct pages."""
    found = held.select("row", "host", "content", F.explode(F.arrays_zip("at", "leads")).alias("x")).select("row", "host", "content", F.col("x.at").alias("pos"), F.col("x.leads").alias("lead"))
    lying = found.select("host", "lead", "content").distinct().groupBy("host", "lead").agg(F.count("*").alias("n")).where("n > 1")
    # A passage on every page of a large host has few leads with many rows: hosts and leads are dealt to several tasks each.
    salt, salts = lambda key: F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int").alias("salt"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    shared = lying.select("*", salt("lead")).join(least.select("*", salts), ["host", "salt"]).where(F.col("n") >= F.col("least")).select("lead", salts)
    return found.select("row", "pos", "lead", salt("row")).join(shared, ["lead", "salt"]).groupBy("row").agg(F.collect_list("pos").alias("covered"))


def unique_text(found: list[str], inside: list[bool], covered: np.ndarray, run: int = RUN) -> list[str]:
    """The blocks without the tokens that repeated runs cover, of the article if one is marked; blocks left empty go."""
    out, at = [], 0
    total = sum(len(b.split()) for b in found)
    marks = np.zeros(total + 1, np.int64)
    np.add.at(marks, covered, 1)
    np.add.at(marks, np.minimum(covered + run, total), -1)
    gone = np.cumsum(marks) > 0
    marked = any(inside)
    for block, own in zip(found, inside, strict=True):
        tokens = block.split()
        kept = [t for k, t in enumerate(tokens) if not gone[at + k]] if own or not marked else []
        at += len(tokens)
        if kept:
            out.append(" ".join(kept))
    return out


def main_text(pages: DataFrame, run: int = RUN, share: float = SHARE) -> DataFrame:
    """page_id, url, text and n_chars for every row of `pages`."""
    parsed = rows.stage(parse(pages))
    streams = _hosts(parsed)
    least = least_pages(streams, share)
    maybe = parsed.sparkSession.sparkContext.broadcast(met_often(streams, least, run))
    rows.release(parsed.sparkSession)

    def texts(page_id, url, found, inside, covered):
        out = []
        for b, i, c in zip(found.to_pylist(), inside.to_pylist(), covered, strict=True):
            out.append("\n\n".join(unique_text(b, i, np.array(c or [], np.int64), run)))
        return {"page_id": page_id, "url": url, "text": out, "n_chars": [len(t) for t in out]}

    def holding(row, page_id, url, content, found, inside, host, text):
        owner, at, lead = suffixes(_as_hash(host), text, maybe.value, run)
        kept, counts = np.unique(owner, return_counts=True)
        ends, take = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(kept, pa.int64())
        own = {f.name: column.take(take) for f, column in zip([*PARSED, HELD.field("host")], (row, page_id, url, content, found, inside, host), strict=True)}
        return own | {"at": pa.ListArray.from_arrays(ends, pa.array(at.astype(np.int32))), "leads": pa.ListArray.from_arrays(ends, pa.array(lead.view(np.int64)))}

    def others(page_id, url, found, inside, host, text):
        free = np.ones(len(host), bool)
        free[suffixes(_as_hash(host), text, maybe.value, run)[0]] = False
        take = pa.array(np.flatnonzero(free))
        return texts(page_id.take(take), url.take(take), found.take(take), inside.take(take), [None] * len(take))

    # Only pages with suffixes that may be repeated are shuffled.
    held = rows.stage(rows.per_batch(streams.select(*PARSED.names, "host", "text"), HELD, holding))
    marked = held.join(repeated(held, least), "row", "left").select("page_id", "url", "blocks", "inside", "covered")
    rest = rows.per_batch(streams.select("page_id", "url", "blocks", "inside", "host", "text"), TEXTS, others)
    return rest.unionByName(rows.per_batch(marked, TEXTS, lambda *columns: texts(*columns[:-1], columns[-1].to_pylist())))


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Every page."""
    return main_text(spark.read.parquet(f"{folder}/pages.parquet"))
