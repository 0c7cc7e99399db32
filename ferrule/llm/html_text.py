"""Main text of web pages, by differencing each page against its nearest URLs.

A page is read into lines: the text of each block, or of a whole region that an element, its role
or an unambiguous whole name marks (menus, headers, footers, sidebars, adverts, forms, reader
comments); elements that hold the page or the article open none by name or role. A region's line
is known by its place in the page's template, since what menus and adverts say differs from page
to page; any other line by its text.

Pages are ordered by host and URL path in ranges, and pages that stand beside each other with the
same lines form a run, numbered over all ranges, so a run and its neighbours are the same however
the ranges fall. Each run is paired with the NEAREST runs of its host on either side, the longest
common path first. Page and neighbour are aligned by a longest common subsequence of their lines,
and shared lines are deleted, until a neighbour that is no copy has been met: pages that share
most of their content are copies of one article, not two uses of a template, and tell of regions
only. Lines within an element that declares itself the article are not deleted as shared. A region
for which no neighbour has the like is the one case in which its mark alone decides: it goes.

The k-th line with a key in one page can only match the k-th with that key in the other, so keys
are unique and the alignment takes n log n steps for any page; reading a page takes steps in
proportion to its length, however deep its markup is.

Defined results: null html is the empty page with the empty text; null url sorts as a host
without name; repeated pages are one run and get the same text each; unclosed elements end where
an element around them ends, unclosed comments, scripts and styles with the page; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import erased, partitions, small_batches, written

#: Runs on either side that a run is paired with; runs that are decided together.
NEAREST, CHUNK = 2, 64
#: Tasks that share the decision of a run.
SALTS = 16

# Elements of HTML by how they are read.
RAW = frozenset("script style template textarea title noscript iframe noembed noframes xmp".split())
SKIPPED = frozenset("head svg math object audio video canvas select datalist button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
REGIONS = frozenset("nav header footer aside form menu dialog".split())
ARTICLES = frozenset("article main".split())
LOOSE = frozenset("p li dt dd tr td th thead tbody tfoot option optgroup colgroup caption".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
#: Names that say no content wherever they stand; and those that do outside an article.
ANYWHERE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies gdpr newsletter subscribe subscription comments disqus breadcrumb breadcrumbs navbar".split()
)
OUTSIDE = ANYWHERE | frozenset("banner sidebar rail menu nav navigation footer header masthead toolbar pagination pager login signup".split())
#: Names that add nothing to one of the above, as in site-footer or cookie-notice.
NEUTRAL = frozenset("site global main top bottom left right primary secondary notice bar box block".split())
#: Elements that hold the page or its text: names and roles open no region there.
HOLDERS = frozenset("html body main article".split())
#: Elements of text; inside an article names open no region there.
TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote dl dt dd".split())

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z/][^>]*+(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_PARTS = re.compile(r"[a-z]+")


def _named(value: str, known: frozenset) -> str | None:
    """The first name of a class or id value that is a known one, all of it but neutral parts."""
    for name in value.split():
        parts = _PARTS.findall(name)
        told = [x for x in parts if x in known]
        if told and all(x in known or x in NEUTRAL for x in parts):
            return told[0]
    return None


def _declared(tag: str, attributes: str, in_article: bool) -> str | None:
    """What region the element declares, if one that is no content."""
    if tag in ("html", "body"):
        return None
    if tag in REGIONS and not (in_article and tag == "header"):
        return tag
    if "=" in attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values).lower()
            if name == "aria-hidden" and value == "true":
                return f"{tag}[hidden]"
            if tag in HOLDERS:
                continue
            if name == "role" and value in ROLES:
                return f"{tag}[{value}]"
            # within an article an id is the anchor of one of its sections
            if name == "class" or name == "id" and not in_article:
                part = None if in_article and tag in TEXTS else _named(value, ANYWHERE if in_article else OUTSIDE)
                if part:
                    return f"{tag}.{part}"
    elif re.search(r"\bhidden\b", attributes):
        return f"{tag}[hidden]"
    return None


def _is_article(tag: str, attributes: str) -> bool:
    return tag in ARTICLES or "articlebody" in attributes.lower() or 'role="main"' in attributes.lower()


def lines(page: str) -> list[tuple[str, str | None, bool]]:
    """(text, region or None, within an article) of each line of a page."""
    out: list[tuple[str, str | None, bool]] = []
    stack: list[tuple[str, str | None, bool]] = []  # tag, region that it opened, article that it opened
    region, articles, text, at = [], 0, [], 0
    opened_now: Counter[str] = Counter()

    def flush():
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if joined:
                if region and out and out[-1][1] == region[0] and not fresh[0]:
                    out[-1] = (f"{out[-1][0]} {joined}", region[0], False)
                else:
                    out.append((joined, region[0] if region else None, articles > 0))
                fresh[0] = False

    fresh = [True]  # whether the next line of a region is its first

    def close():
        nonlocal articles
        tag, opened, article = stack.pop()
        opened_now[tag] -= 1
        if opened is not None:
            region.pop()
            fresh[0] = True
        articles -= article

    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, attributes = m[2].lower(), m[3]
        if m[1]:
            if tag in BLOCKS:
                flush()
            while opened_now[tag]:  # an element ends what is open within it
                inner, opens, article = stack[-1]
                if opens is not None or article:
                    flush()
                close()
                if inner == tag:
                    break
            continue
        if tag in RAW or tag in SKIPPED and tag != "head":
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in BLOCKS:
            flush()
            while stack and stack[-1][0] in LOOSE:  # its end is implied
                close()
        if tag == "body":
            while stack and stack[-1][0] == "head":
                close()
        if tag in VOID or attributes.endswith("/"):
            continue
        opened = "head" if tag == "head" else _declared(tag, attributes, articles > 0)
        article = _is_article(tag, attributes) and not region and opened is None
        if opened is None and not article and tag in LOOSE:
            continue
        if opened is not None:
            flush()
            region.append(opened)
            fresh[0] = True
        articles += article
        stack.append((tag, opened, article))
        opened_now[tag] += 1
    flush()
    return out


def keyed(page: list[tuple[str, str | None, bool]]) -> list[tuple]:
    """A key for each line, numbered among equal ones."""
    seen: dict[tuple, int] = {}
    out = []
    for text, region, _ in page:
        key = ("text", text) if region is None else ("region", region)
        seen[key] = seen.get(key, -1) + 1
        out.append((*key, seen[key]))
    return out


def shared_lines(a: list[tuple], b: list[tuple]) -> set[int]:
    """The lines of a in a longest common subsequence with b; keys are unique on either side."""
    where = {key: j for j, key in enumerate(b)}
    pairs = [(i, where[key]) for i, key in enumerate(a) if key in where]
    ends: list[int] = []  # least end of an increasing run of each length
    last: list[int] = []
    before = [-1] * len(pairs)
    for x, (_, j) in enumerate(pairs):
        k = bisect.bisect_left(ends, j)
        before[x] = last[k - 1] if k else -1
        if k == len(ends):
            ends.append(j)
            last.append(x)
        else:
            ends[k], last[k] = j, x
    found, x = set(), last[-1] if last else -1
    while x >= 0:
        found.add(pairs[x][0])
        x = before[x]
    return found


def gone(page: tuple, neighbours: list[tuple]) -> tuple[set[int], set[int]]:
    """The lines that the page shares with its neighbours, up to the first that is no copy; and marked lines that none shares.

    A page is (keys, lengths, whether marked as no content, whether within an article) of its lines.
    """
    keys, length, marked, article = page
    shared: set[int] = set()
    size = sum(n for n, m in zip(length, marked) if not m)
    for other_keys, other_length, other_marked, _ in neighbours:
        common = shared_lines(keys, other_keys)
        content = sum(length[i] for i in common if not marked[i])
        theirs = sum(n for n, m in zip(other_length, other_marked) if not m)
        shared |= {i for i in common if marked[i]}
        if 3 * content <= 2 * max(size, theirs):
            shared |= {i for i in common if not article[i]}
            break
    return shared, {i for i, m in enumerate(marked) if m} - shared


def facts(page: list[tuple[str, str | None, bool]]) -> tuple:
    """Keys, lengths and marks of a page's lines, for `gone`."""
    return keyed(page), [len(t) for t, *_ in page], [r is not None for _, r, _ in page], [a for *_, a in page]


def main_text(page: list[tuple[str, str | None, bool]], neighbours: list[list[tuple[str, str | None, bool]]]) -> str:
    """The page's text by differencing with its neighbours."""
    shared, marked = gone(facts(page), [facts(n) for n in neighbours])
    return " ".join(text for i, (text, *_) in enumerate(page) if i not in shared and i not in marked)


def nearness(a: str, b: str) -> int:
    """How far two paths agree."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _packed(page: list[tuple[str, str | None, bool]]) -> tuple[bytes, bytes, bytes]:
    """Keys (64 bits each, only ever compared between two pages), lengths and marks of a page's lines."""
    keys, length, marked, article = facts(page)
    names = b"".join(hashlib.blake2b(repr(k).encode("utf-8", "surrogatepass"), digest_size=8).digest() for k in keys)
    return names, np.array(length, np.int32).tobytes(), np.array([m + 2 * a for m, a in zip(marked, article)], np.uint8).tobytes()


def _unpacked(row: dict) -> tuple:
    kinds = np.frombuffer(row["marks"], np.uint8)
    names = [row["keys"][i : i + 8] for i in range(0, len(row["keys"]), 8)]
    return names, np.frombuffer(row["length"], np.int32).tolist(), (kinds & 1 == 1).tolist(), (kinds & 2 == 2).tolist()


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path, the lines' texts (compressed) and packed facts, and a digest of these of every page."""
    url = F.coalesce("url", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).alias("host"),
        F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "").alias("path"),
        "html",
    )

    def run(batches):
        small = zstandard.ZstdCompressor(level=6)
        for batch in batches:
            read = [lines(page.as_py() or "") for page in batch.column("html")]
            packed = [_packed(page) for page in read]
            # marked lines are never put out; no line holds a line feed
            texts = ["\n".join("" if marked else t for t, marked, _ in page) for page in read]
            texts = [small.compress(t.encode("utf-8", "surrogatepass")) for t in texts]
            digest = [hashlib.blake2b(b"".join(p), digest_size=16).digest() for p in packed]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("page_id", "url", "host", "path")),
                    pa.array(texts, pa.binary()),
                    *(pa.array([p[i] for p in packed], pa.binary()) for i in range(3)),
                    pa.array(digest, pa.binary()),
                ],
                ["page_id", "url", "host", "path", "texts", "keys", "length", "marks", "digest"],
            )

    return rows.mapInArrow(
        run, "page_id long, url string, host string, path string, texts binary, keys binary, length binary, marks binary, digest binary"
    )


def in_runs(rows: DataFrame, ranges: int) -> DataFrame:
    """rows, written in order of URL, with the number of their run; runs of one host have successive numbers.

    A run is a stretch of rows of one host with one digest. Ranges number their own runs; what is
    gathered from each range is the number of its runs and the first and the last.
    """
    order = ["host", "path", "digest", "row"]
    sorted_rows = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)

    def number(batches):
        part, at, i = TaskContext.get().partitionId(), None, -1
        for batch in batches:
            own, head = [], []
            for name in zip(batch.column("host").to_pylist(), batch.column("digest").to_pylist()):
                head.append(name != at)
                i += name != at
                at = name
                own.append(i)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * len(own), pa.int32()), pa.array(own, pa.int64()), pa.array(head, pa.bool_())],
                [*batch.schema.names, "part", "i", "head"],
            )

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted_rows.schema.fields)
    out = written(sorted_rows.mapInArrow(number, types + ", part int, i long, head boolean"), "ordered")
    ends = F.struct("host", "digest")
    told = out.where("head").groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(ends, "i").alias("first"), F.max_by(ends, "i").alias("last")
    )
    base, run, last = [], 0, None
    for r in sorted(told.collect(), key=lambda r: r.part):  # a row for each range
        run -= last is not None and tuple(r.first) == last
        base.append((r.part, run))
        run, last = run + r.n, tuple(r.last)
    bases = rows.sparkSession.createDataFrame(base, "part int, base long")
    numbered = out.join(F.broadcast(bases), "part").withColumn("run", F.col("base") + F.col("i")).drop("base", "i", "part")
    numbered.written_at = out.written_at
    return numbered


def decisions(runs: DataFrame, parts: int) -> DataFrame:
    """run, the numbers of the lines that stay, and how many go as shared with a neighbour or by their mark alone."""
    heads = runs.where("head").select("run", "host", "path", "keys", "length", "marks")
    chunk = lambda away: F.floor((F.col("run") + F.lit(away)) / F.lit(CHUNK))
    # a chunk of runs gets those beside it, too
    sent = heads.withColumn("chunk", F.explode(F.array_distinct(F.array(chunk(-NEAREST), chunk(0), chunk(NEAREST)))))
    sent = sent.repartition(parts, "chunk").sortWithinPartitions("chunk")

    def of(chunk, group):
        pages = {g["run"]: g for g in group}  # a run that goes on in the next range has a head there, too
        facts_of = {run: _unpacked(g) for run, g in pages.items()}
        for run in range(chunk * CHUNK, (chunk + 1) * CHUNK):
            if run in pages:
                own = pages[run]
                near = [run + d for d in range(-NEAREST, NEAREST + 1) if d and run + d in pages and pages[run + d]["host"] == own["host"]]
                near.sort(key=lambda n: (-nearness(pages[n]["path"], own["path"]), abs(n - run), n))
                shared, marked = gone(facts_of[run], [facts_of[n] for n in near])
                yield run, [i for i in range(len(facts_of[run][0])) if i not in shared and i not in marked], len(shared), len(marked)

    def decide(batches):
        def out(found):
            kinds = (pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], ["run", "kept", "n_shared", "n_marked"])

        at, group, found = None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                if row["chunk"] != at and group:
                    found += of(at, group)
                    group = []
                at = row["chunk"]
                group.append(row)
            if len(found) > 1000:
                yield out(found)
                found = []
        if group:
            found += of(at, group)
        if found:
            yield out(found)

    return sent.mapInArrow(decide, "run long, kept array<int>, n_shared long, n_marked long")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page, and how many lines went as shared with a neighbour, and by their mark alone."""
    spark = pages.sparkSession
    small_batches(spark)
    parts = partitions(spark)
    read = written(parsed(pages).withColumn("row", F.monotonically_increasing_id()), "lines")
    runs = in_runs(read.select("row", "host", "path", "digest", "keys", "length", "marks"), 4 * parts)
    told = written(decisions(runs, 4 * parts), "decisions")
    # a run of very many copies is looked up by several tasks
    salted = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = runs.select("row", "run", F.pmod(F.col("row"), F.lit(SALTS)).cast("int").alias("salt"))
    # the same joins at every size, so that what they need grows as the input does
    by_row = written(rows.join(salted.hint("merge"), ["run", "salt"]).select("row", "kept", "n_shared", "n_marked"), "kept")
    erased(runs, told)

    def put_out(batches):
        plain = zstandard.ZstdDecompressor()
        for batch in batches:
            texts = []
            for blob, kept in zip(batch.column("texts").to_pylist(), batch.column("kept").to_pylist()):
                page = plain.decompress(blob).decode("utf-8", "surrogatepass").split("\n")
                texts.append(" ".join(page[i] for i in kept))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("page_id", "url")),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    *(batch.column(c) for c in ("n_shared", "n_marked")),
                ],
                ["page_id", "url", "text", "n_chars", "n_shared", "n_marked"],
            )

    out = read.select("row", "page_id", "url", "texts").join(by_row.hint("merge"), "row").drop("row")
    return out.mapInArrow(put_out, "page_id long, url string, text string, n_chars long, n_shared long, n_marked long")
