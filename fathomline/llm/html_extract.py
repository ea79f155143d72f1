"""Main text of web pages, by markup and by a suffix array over each host.

A page is cut into blocks. Elements that by name, class, id or role are menus, headers, footers, sidebars, notices, adverts,
forms or comments are left out, and so is what isn't shown. Where a page marks its main part (article or main), the blocks
in it form the page's token stream; on other pages all blocks do, also those that are left out of the text.

The streams of a host's pages, with and without a main part apart, are the suffix array's text. Its suffixes are sorted by
their first TOKENS tokens; where enough of the host's pages have the same, these TOKENS tokens are boilerplate there, and
the union of such runs is all long substrings that enough distinct pages share. What they cover goes, and the runs between
them stay, however short. Pages with equal streams count once, so a copied article isn't boilerplate, nor is a passage that
some others quote: it takes LEAST_PAGES pages and one in PART of the host's. A page that such runs cover whole stays whole.

The sort is a shuffle by hash of host and prefix, so a host's pages are never in one place, and equal suffixes are counted
before the shuffle, so a menu that all pages of a large host have is no hot key. Most suffixes are in one page only, so they
are sieved first: each takes as its anchor the ANCHOR tokens in it with the smallest hash, which equal suffixes share, and
one whose anchor isn't in as many pages can't be in as many either. Only the others are sorted. Markup is read once; the
later passes read the blocks from a table in the shared folder.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import BROADCAST_ROWS, cut, join_on_counted_key, left_join_small_or_any, text_slices, written
from fathomline.llm.url_filter import host_and_path

#: Tokens that make a repeated substring long.
TOKENS = 8
#: A run is boilerplate if so many pages have it, and of the host's pages one in so many: in main parts, and on pages without one.
LEAST_PAGES, PART = (5, 3), (2, 4)
#: Runs that cover more than so much of a page's stream are content that near-equal pages share: in a main part, and without one.
MOST_COVERED = (0.5, 0.875)
#: A form that has a block of so many words, and more text than all that stays beside it, is the page's frame.
FRAME_WORDS = 25
#: Tokens of an anchor.
ANCHOR = 3

#: Elements by what they mean here, and words of classes, ids and roles that mark what isn't main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg select".split())
LEFT_OUT = frozenset("head nav header footer aside form button dialog menu fieldset".split())
MAIN = frozenset(("article", "main"))
BLOCK = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody "
    "td tfoot th thead tr ul".split()
)
MARKED = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies consent disqus footer form header masthead menu modal nav navbar navigation "
    "newsletter notice notices popup promo related search share sharing sidebar social sponsor sponsored subscribe teaser teasers toolbar widget".split()
)
#: What a marked name may have before and after its words; with any other part it names something else (search-result, has-sidebar).
BEFORE = frozenset("bottom global left primary right secondary site top".split())
AFTER = frozenset("area bar bottom box button buttons container icons left links list right slot top unit wrapper".split())
#: Marks of what has articles of its own that aren't the page's.
OTHERS = frozenset("comment comments disqus related teaser teasers".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: An open one of these is closed by the start of a block.
IMPLIED_END = {"p": BLOCK, "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "tr": frozenset(("tr",))}
#: A quote quotes only right after the sign of equality.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s>]+))?")
SPLIT = re.compile(r"[^a-z0-9]+")
SPACE = re.compile(r"\s+")


def _marks(name: str) -> set[str]:
    """The words of MARKED in a class, id or role that as a whole names what isn't main text, else none."""
    if name in MARKED:
        return {name}
    parts = [p for p in SPLIT.split(name) if p]
    while parts and parts[0] in BEFORE:
        parts.pop(0)
    while parts and (parts[-1] in AFTER or parts[-1].isdigit()):
        parts.pop()
    return set(parts) if MARKED.issuperset(parts) else set()


def _left_out(tag: str, attributes: str, in_article: bool) -> str:
    """"" if it stays; "soft" if it is left out unless it holds the page's article or main; "hard" if it is left out."""
    marks: set[str] = set()
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        name = m[1].lower()
        if name not in ("class", "id", "role", "hidden", "style", "aria-hidden"):
            continue
        value = (m[2] or "").strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDING.search(value):
            return "hard"
        if name == "id" and tag in HEADINGS:  # names the section for links
            continue
        if name in ("class", "id", "role") and tag not in ("html", "body"):
            for word in value.split():
                marks |= _marks(word)
    if tag in LEFT_OUT and not (tag == "header" and in_article and not marks):  # an article's header has its title
        return "soft" if tag == "form" and OTHERS.isdisjoint(marks) else "hard"
    return "" if not marks else "soft" if OTHERS.isdisjoint(marks) else "hard"


def blocks_of(page: str | None) -> list[tuple[bool, bool, str]]:
    """(in the main part, left out, text) of each block with text, in page order; white space is one space.

    An element left out for its class, id or role, or as a form, stays if it holds the page's main, or its article when it has
    no other that stays. Hidden elements, asides, comments and the like have no article of the page's in them.
    """
    out, kept, held = _parsed(page or "", frozenset())
    staying: frozenset[int] = frozenset()
    for tag in MAIN:
        if not kept[tag] and (tag == "main" or not kept["main"] or len(held[tag]) == 1):
            staying = staying.union(*held[tag])
    if staying:
        return _parsed(page or "", staying)[0]
    forms = frozenset(m.start() for m in FORM.finditer(page or ""))
    if not forms or any(main for main, left, _ in out if not left):
        return out
    framed = _parsed(page or "", forms)[0]
    size = lambda blocks: sum(len(t) for _, left, t in blocks if not left)
    longest = max((t.count(" ") + 1 for (_, a, t), (_, b, _) in zip(framed, out) if b and not a), default=0) if len(framed) == len(out) else 0
    return framed if longest >= FRAME_WORDS and size(framed) > 2 * size(out) else out


def _parsed(page: str, staying: frozenset[int]) -> tuple[list[tuple[bool, bool, str]], dict[str, int], dict[str, list[set[int]]]]:
    """Blocks; how many of each tag of MAIN stay; and for each that doesn't, the places of the soft elements that hold it."""
    out: list[tuple[bool, bool, str]] = []
    stack: list[tuple[str, bool, bool, str, int]] = []  # tag, main, left out, why itself, place of its markup
    parts: list[str] = []
    kept, held = dict.fromkeys(MAIN, 0), {tag: [] for tag in MAIN}
    main = left = False

    def end_block() -> None:
        text = SPACE.sub(" ", html.unescape("".join(parts))).strip(" ") if parts else ""
        if text:
            out.append((main, left, text))
        parts.clear()

    def close(k: int) -> None:
        nonlocal main, left
        del stack[k:]
        main, left = (stack[-1][1], stack[-1][2]) if stack else (False, False)

    at = 0
    while at < len(page):
        m = MARKUP.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, ending = m[2].lower(), bool(m[1])
        if tag in RAW:
            if not ending and not m[3].endswith("/"):
                end = re.compile(rf"</{tag}\s*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in BLOCK:
            end_block()
        elif tag == "br":
            parts.append(" ")
        if tag in VOID:
            continue
        if ending:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), -1)
            # An end without its start, or across a block that isn't its own, ends nothing.
            if k >= 0 and (tag in BLOCK or not any(s[0] in BLOCK for s in stack[k:])):
                close(k)
        else:
            if tag in BLOCK:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in IMPLIED_END and tag in IMPLIED_END[stack[k][0]]:
                        close(k)
                        break
                    if stack[k][0] in BLOCK:
                        break
            if not m[3].endswith("/"):
                why = _left_out(tag, m[3], tag == "header" and any(x[0] == "article" for x in stack))
                if m.start() in staying:
                    why = ""
                out_here = left or why != ""
                main, left = main or (tag in MAIN and not out_here), out_here
                stack.append((tag, main, left, why, m.start()))
                if tag in MAIN:
                    kept[tag] += not left
                    if left and all(s[3] != "hard" for s in stack):
                        held[tag].append({s[4] for s in stack if s[3]})
    end_block()
    return out, kept, held


FORM = re.compile(r"<form(?=[\s>/])", re.I)


def streams(page: str | None) -> tuple[bool, list[str], list[bool]]:
    """Whether the page has no main part, the texts of its stream in page order, and which of them are left out of its text."""
    blocks = blocks_of(page)
    marked = [text for main, left, text in blocks if main and not left]
    if marked:
        return False, marked, [False] * len(marked)
    return True, [text for _, _, text in blocks], [left for _, left, _ in blocks]


def _parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        groups, bodies, opens, texts, lefts = [], [], [], [], []
        for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
            open_, stream, left = streams(page)
            group = xxhash.xxh3_64_intdigest(f"{open_} {host_and_path(url)[0]}")
            groups.append(group - (1 << 63))
            bodies.append(xxhash.xxh3_64_intdigest("\n".join(stream), group) - (1 << 63))
            opens.append(open_)
            texts.append(stream)
            lefts.append(left)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("row"), batch.column("page_id"), batch.column("url"), pa.array(groups, pa.int64()), pa.array(bodies, pa.int64()), pa.array(opens, pa.bool_()),
                pa.array(texts, pa.list_(pa.string())), pa.array(lefts, pa.list_(pa.bool_())),
            ],
            names=[c.split()[0] for c in PARSED.split(", ")],
        )


PARSED = "row long, page_id long, url string, group long, body long, open boolean, texts array<string>, left array<boolean>"


def _tokens(texts: list[str]) -> list[str]:
    return [token for text in texts for token in text.split(" ")]


def suffix_keys(group: int, tokens: list[str]) -> np.ndarray:
    """Hash of the host's group and the first TOKENS tokens of each suffix that has as many."""
    key = xxhash.xxh3_64_intdigest
    return np.array([key(" ".join(tokens[k : k + TOKENS]), group & MASK) for k in range(len(tokens) - TOKENS + 1)], np.uint64).view(np.int64)


MASK = (1 << 64) - 1
#: Low bits of an anchor, by which its host's bound is found; hosts that share them share the smaller bound in the sieve.
SLOTS = (1 << 24) - 1


def anchors(group: int, tokens: list[str]) -> np.ndarray:
    """For each suffix of TOKENS tokens the smallest hash of the group and ANCHOR tokens in it; its low bits are the group's."""
    key = xxhash.xxh3_64_intdigest
    grams = np.array([key(" ".join(tokens[k : k + ANCHOR]), group & MASK) for k in range(len(tokens) - ANCHOR + 1)], np.uint64).view(np.int64)
    span = TOKENS - ANCHOR + 1
    if len(grams) < span:
        return np.empty(0, np.int64)
    return np.lib.stride_tricks.sliding_window_view(grams & ~SLOTS, span).min(axis=1) | (group & SLOTS)


def _anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each anchor in a page once."""
    for batch in text_slices(batches):
        found = [np.unique(anchors(group, _tokens(texts))) for group, texts in zip(batch.column("group").to_pylist(), batch.column("texts").to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *found]))], names=["anchor"])


def _suffixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, key, group, body, at) of the suffixes of the streams."""
    for batch in text_slices(batches):
        found, keys, lengths = [np.empty(0, np.int64)], [np.empty(0, np.int64)], []
        for group, texts in zip(batch.column("group").to_pylist(), batch.column("texts").to_pylist()):
            tokens = _tokens(texts)
            found.append(anchors(group, tokens))
            keys.append(suffix_keys(group, tokens))
            lengths.append(len(keys[-1]))
        groups, bodies = (np.repeat(batch.column(c).to_numpy(), lengths) for c in ("group", "body"))
        places = np.concatenate([np.empty(0, np.int32), *(np.arange(n, dtype=np.int32) for n in lengths)])
        yield pa.RecordBatch.from_arrays([*map(pa.array, (np.concatenate(found), np.concatenate(keys), groups, bodies, places))], names=["anchor", "key", "group", "body", "at"])


def _small(df: DataFrame) -> DataFrame:
    """df for broadcast if its counted rows, of a few longs each, allow; else for a shuffled join."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def boilerplate(parsed: DataFrame) -> DataFrame | None:
    """(body, at): where runs that enough pages of the host have start in the streams; None if nowhere."""
    at = F.struct("group", "body")
    bodies = cut(parsed.groupBy("group", "body").agg(F.min("row").alias("first"), F.count("*").alias("n"), F.first("open").alias("open")))
    twins = bodies.filter("n > 1").select(at.alias("k"), "first", "n")
    once = parsed.select("group", "body", "texts")
    total = twins.agg(F.sum("n")).first()[0] or 0
    if total:
        again = join_on_counted_key(parsed.select(at.alias("k"), "row"), twins, "k", "n", parsed.count()).filter("row <> first").select("row")
        once = parsed.join(_small(cut(again)), "row", "left_anti").select("group", "body", "texts")
    least, part = (F.when(F.col("open"), b).otherwise(a) for a, b in (LEAST_PAGES, PART))
    groups = bodies.groupBy("group", "open").agg(F.count("*").alias("n_pages")).filter(F.col("n_pages") >= least)
    groups = cut(groups.select("group", F.greatest(least, F.ceil(F.col("n_pages") / part)).alias("least")))
    slot = lambda c: F.col(c).bitwiseAND(F.lit(SLOTS))
    slots = groups.groupBy(slot("group").alias("slot")).agg(F.min("least").alias("bound"))
    # A run in fewer pages than the smaller bound is nowhere boilerplate.
    counts = once.mapInArrow(_anchors, "anchor long").groupBy("anchor").count().filter(F.col("count") >= min(LEAST_PAGES))
    frequent = cut(counts.withColumn("slot", slot("anchor")).join(F.broadcast(slots) if groups.count() <= BROADCAST_ROWS else slots, "slot").filter("count >= bound").select("anchor"))
    if frequent.isEmpty():
        return None
    suffixes = once.mapInArrow(_suffixes, "anchor long, key long, group long, body long, at int").join(_small(frequent), "anchor", "left_semi")
    suffixes = written(suffixes.join(_small(groups), "group").select("key", "body", "at", "least"))
    holding = suffixes.groupBy("key", "body").agg(F.count("*").alias("n"), F.min("least").alias("least"))
    holding = holding.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("held"), F.min("least").alias("least"))
    repeated = cut(holding.filter("held >= least").select("key", "n"))
    total = repeated.agg(F.sum("n")).first()[0] or 0
    return join_on_counted_key(suffixes.select("key", "body", "at"), repeated, "key", "n", total).select("body", "at")


def uncovered(texts: list[str], places: list[int] | None, most: float = 1.0) -> list[str]:
    """For each text in a stream of texts what repeated substrings that start at places leave of it; empty if nothing.

    If they cover more than the share most of the stream's tokens they leave all.
    """
    if not places:
        return texts
    lists = [text.split(" ") for text in texts]
    n = sum(map(len, lists))
    repeated = np.zeros(n + 1, np.int64)
    starts = np.array(places)
    starts = starts[starts < n]
    np.add.at(repeated, starts, 1)
    np.add.at(repeated, np.minimum(starts + TOKENS, n), -1)
    covered = np.cumsum(repeated)[:-1] > 0
    if covered.mean() > most:
        return texts
    out, at = [], 0
    for text, tokens in zip(texts, lists):
        mine = covered[at : at + len(tokens)]
        at += len(tokens)
        out.append(" ".join(t for t, c in zip(tokens, mine.tolist()) if not c) if mine.any() else text)
    return out


def joined_text(texts: list[str], left: list[bool], places: list[int] | None = None, most: float = 1.0) -> str:
    """The text of a page from its stream, without what is left out and what repeated substrings cover."""
    found = [t for t, x in zip(uncovered(texts, places, most), left) if t and not x]
    return "\n".join(found or [t for t, x in zip(texts, left) if not x])


def main_text(page: str | None) -> str:
    """The text of a page by itself."""
    _, texts, left = streams(page)
    return joined_text(texts, left)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of pages(page_id, url, html, ...).

    text: blocks in page order, joined by one line end; inside a block character references are decoded and white space is one
    space; empty if there is none. A null html is an empty page; pages with a null or malformed url share the empty host.
    Pages with equal streams are one page to the suffix array, so a repeated row repeats nothing; runs that cover most of a page's
    stream (MOST_COVERED) are what near-equal articles share, and stay. Pages may be of any length
    and markup may break off. Other columns are ignored. Empty in, empty out.
    """
    parsed = written(pages.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", "html").mapInArrow(_parse, PARSED))
    found = boilerplate(parsed)
    if found is None:
        rows = parsed.withColumn("places", F.lit(None).cast("array<int>"))
    else:
        covered = cut(found.groupBy("body").agg(F.sort_array(F.collect_set("at")).alias("places")))
        size = covered.agg(F.sum(F.size("places"))).first()[0] or 0
        rows = left_join_small_or_any(parsed, covered, "body", size)
    names = ["page_id", "url", "text", "n_chars"]

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            texts = [joined_text(*row, MOST_COVERED[open_]) for *row, open_ in zip(*(batch.column(c).to_pylist() for c in ("texts", "left", "places", "open")))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=names)

    return rows.select("page_id", "url", "texts", "left", "places", "open").mapInArrow(extract, "page_id long, url string, text string, n_chars long")
