"""Benchmark decontamination by a broadcast set of test n-grams.

Words are lower-cased runs of letters, digits and everything beyond ASCII. The windows of all
benchmark items (n consecutive words; a shorter item is one window of its own length) are
hashed into a sorted set, which is sent to every task if it is no larger than MOST_WINDOWS and
MOST_BYTES. A task hashes the words of whole texts, sums them into windows of each length that
the set has, and looks up a table of bits, then the set. Every run of windows found is verified
on its words, so a hash decides nothing. Spans are the verified words; they, or the documents
that hold them, can be removed. Documents are never shuffled.

A larger set is not sent: tasks get its hashes as a bitmap of fixed size, emit the windows that
may be in it with their words, and Spark joins these with the set's; the result is the same.

Defined results: null and empty texts have no words and no hits; an item without words has no
window; items are told apart by item_id, of which null is one, written as `null`; repeated
documents have a row each, null ids too; with an empty benchmark nothing is hit; an empty table
gives an empty result; further columns are kept by the functions that remove, else ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow_text import column_bytes, row_slices
from .common import ROW, row_check, row_key, small_batches, summarised, summary, written

#: Words of a window.
WORDS = 10
#: The largest set that is sent to every task: windows, and bytes of the items' words.
MOST_WINDOWS, MOST_BYTES = 2_000_000, 32 << 20
#: What a word is made of, after lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

U = np.uint64
#: Bytes as they count: A-Z lower-cased, other separators as spaces.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_normal = np.frombuffer(NORMAL, np.uint8)
_rng = np.random.default_rng(20)
#: A number for each byte value, odd factors for the places in a word and in a window.
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | U(1)
_STEP = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | U(1)
_SPAN = 1 << 20


def spread(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word, and the rows' offsets into them."""
    text = _normal[data]
    solid = text != 32
    edge = np.ones(len(data) + 1, bool)  # a word can begin here, or have ended
    edge[1:-1] = ~solid[1:] | ~solid[:-1]
    edge[offsets] = True
    begins = np.flatnonzero(solid & edge[:-1])
    ends = np.flatnonzero(solid & edge[1:]) + 1
    out = np.empty(len(begins), np.uint64)
    a = 0
    while a < len(begins):  # as many words at once as have _SPAN bytes
        b = max(a + 1, int(np.searchsorted(ends, begins[a] + _SPAN, "right")))
        here = text[begins[a] : ends[b - 1]]
        inside = here != 32
        size = ends[a:b] - begins[a:b]
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(first, size)
        out[a:b] = np.add.reduceat(_BYTE[here[inside]] * _PLACE[place & 63], first)
        a = b
    return begins, ends, spread(out), np.searchsorted(begins, offsets)


def windows(h: np.ndarray, at: np.ndarray, lengths) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length its windows inside rows: the number of the first word, and a hash."""
    until = np.repeat(at[1:], np.diff(at))  # the end of each word's row
    total = np.zeros(len(h), np.uint64)
    for n in range(1, max(lengths, default=0) + 1):
        m = len(h) - n + 1
        if m <= 0:
            return
        total = total[:m] + h[n - 1 :] * _STEP[(n - 1) & 63]
        if n in lengths:
            whole = np.flatnonzero(np.arange(m) + n <= until[:m])
            yield n, whole, spread(total[whole] + U(n))


@dataclass
class NGrams:
    """The windows of a benchmark: sorted hashes by length, and the items of each window's words."""

    hashes: dict[int, np.ndarray]
    bits: dict[int, np.ndarray]
    items: dict[bytes, tuple[int, ...]]
    names: list[str]


#: Bits of the table that is looked up first.
_FIRST = 22


def ngrams(items: list[tuple[str, bytes]], n: int = WORDS) -> NGrams:
    """The set of the items' windows; items: names and texts."""
    found: dict[bytes, set[int]] = defaultdict(set)
    hashes: dict[int, list[np.ndarray]] = defaultdict(list)
    names = sorted({name for name, _ in items})
    number = {name: i for i, name in enumerate(names)}
    for name, text in items:
        ws = text.translate(NORMAL).split()
        if not ws:
            continue
        length = min(n, len(ws))
        for i in range(len(ws) - length + 1):
            found[b" ".join(ws[i : i + length])].add(number[name])
        data = np.frombuffer(text, np.uint8)
        _, _, h, at = words(data, np.array([0, len(data)]))
        hashes[length] += [x for _, _, x in windows(h, at, {length})]
    sets = {k: np.unique(np.concatenate(v)) for k, v in hashes.items()}
    bits = {}
    for k, v in sets.items():
        bits[k] = np.zeros(1 << _FIRST, bool)
        bits[k][(v >> U(64 - _FIRST)).astype(np.int64)] = True
    return NGrams(sets, bits, {k: tuple(sorted(v)) for k, v in found.items()}, names)


def found_in(grams: NGrams, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int, int, int]], set[int]]]:
    """For each row its number of words, its spans (first and end word, first and end byte) and the items found."""
    begins, ends, h, at = words(data, offsets)
    hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
    of_row: dict[int, set[int]] = defaultdict(set)
    for n, first, hashed in windows(h, at, grams.hashes):
        first, hashed = (x[grams.bits[n][(hashed >> U(64 - _FIRST)).astype(np.int64)]] for x in (first, hashed))
        first = first[np.isin(hashed, grams.hashes[n])]
        if not len(first):
            continue
        # runs of windows that follow each other are read once
        cut = np.flatnonzero(np.diff(first) != 1) + 1
        rows = np.searchsorted(at, first, "right") - 1
        cut = np.union1d(cut, np.flatnonzero(np.diff(rows)) + 1)
        for run in np.split(first, cut):
            row = int(np.searchsorted(at, run[0], "right")) - 1
            ws = data[begins[run[0]] : ends[run[-1] + n - 1]].tobytes().translate(NORMAL).split()
            for k, w in enumerate(run.tolist()):
                who = grams.items.get(b" ".join(ws[k : k + n]))
                if who is not None:
                    hits[row].append((w, w + n))
                    of_row[row].update(who)
    for row in range(len(offsets) - 1):
        spans: list[list[int]] = []
        for a, b in sorted(hits.get(row, ())):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(b, spans[-1][1])
            else:
                spans.append([a, b])
        start = int(offsets[row])
        yield int(at[row + 1] - at[row]), [(a - int(at[row]), b - int(at[row]), int(begins[a]) - start, int(ends[b - 1]) - start) for a, b in spans], of_row.get(row, set())


#: What a scan tells of a document: its words, spans of hit words (numbers, and bytes of the text), and items.
FOUND = ("n_words", "spans", "items")
_SPANS, _ITEMS = "array<struct<first: long, end: long, first_byte: long, end_byte: long>>", "array<string>"
_SPAN_TYPE = pa.list_(pa.struct([(k, pa.int64()) for k in ("first", "end", "first_byte", "end_byte")]))


def normal_items(benchmark: DataFrame) -> DataFrame:
    """item, text, n: name, text and number of words of every item that has words."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    named = F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item")
    return benchmark.select(named, "text", F.regexp_count(lower, F.lit(WORD)).cast("long").alias("n")).where("n > 0")


def scan(docs: DataFrame, benchmark: DataFrame, columns: list[str] | None = None, n: int = WORDS, most_windows: int = MOST_WINDOWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The columns of docs (all by default) and FOUND: by the broadcast set, or by joins where that is too large."""
    spark = docs.sparkSession
    small_batches(spark)
    columns = docs.columns if columns is None else columns
    items = normal_items(benchmark)
    size = items.agg(F.sum(F.greatest(F.col("n") - (n - 1), F.lit(1))).alias("windows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    if (size.windows or 0) > most_windows or (size.bytes or 0) > most_bytes:
        return joined(docs, items, columns, n)
    grams = ngrams([(r.item, r.text.encode()) for r in items.select("item", "text").collect()], n)
    shared = spark.sparkContext.broadcast(grams)
    # the text goes to Python once, whether it is asked for or not
    sent = columns if "text" in columns else [*columns, "text"]
    text_at = sent.index("text")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for batch in batches:
            data, offsets = column_bytes(batch.column(text_at))
            for a, b in row_slices(offsets, _SPAN):
                rows = list(found_in(g, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                spans = [[dict(zip(("first", "end", "first_byte", "end_byte"), s)) for s in r[1]] for r in rows]
                told = [pa.array([r[0] for r in rows], pa.int64()), pa.array(spans, _SPAN_TYPE), pa.array([sorted(g.names[i] for i in r[2]) for r in rows], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in batch.columns[: len(columns)]], *told], [*batch.schema.names[: len(columns)], *FOUND])

    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(sent)])
    kinds = "".join(f"c{i} {f.dataType.simpleString()}, " for i, f in enumerate(inner.schema.fields[: len(columns)]))
    return inner.mapInArrow(found, f"{kinds}n_words long, spans {_SPANS}, items {_ITEMS}").toDF(*columns, *FOUND)


def joined(docs: DataFrame, items: DataFrame, columns: list[str], n: int) -> DataFrame:
    """scan by joins, for a set of any size: each distinct row is found by two hashes of its id and text."""
    spark = docs.sparkSession

    def cut(batches: Iterator[pa.RecordBatch], lengths, keep, columns: int) -> Iterator[pa.RecordBatch]:
        """The windows of the last column, with the other columns: first word, bytes, words, hash and the words themselves."""
        for batch in batches:
            data, offsets = column_bytes(batch.column(columns))
            for a, b in row_slices(offsets, _SPAN):
                own = data[offsets[a] : offsets[b]]
                begins, ends, h, at = words(own, offsets[a : b + 1] - offsets[a])
                by_row = np.minimum(np.diff(at), n) if lengths is None else None
                for k, first, hashed in windows(h, at, set(by_row[by_row > 0].tolist()) if lengths is None else lengths):
                    row = np.searchsorted(at, first, "right") - 1
                    fits = keep(hashed.view(np.int64)) if lengths is not None else by_row[row] == k
                    for lo in range(0, int(fits.sum()), 4096):
                        f, r, x = (y[fits][lo : lo + 4096] for y in (first, row, hashed))
                        text = [b" ".join(own[begins[i] : ends[i + k - 1]].tobytes().translate(NORMAL).split()) for i in f.tolist()]
                        start = offsets[a + r] - offsets[a]
                        told = [pa.array(f - at[r], pa.int64()), pa.array([k] * len(f), pa.int64()), pa.array(begins[f] - start, pa.int64()), pa.array(ends[f + k - 1] - start, pa.int64()), pa.array(x.view(np.int64)), pa.array(text, pa.binary())]
                        yield pa.RecordBatch.from_arrays([*[c.take(pa.array(a + r)) for c in batch.columns[:columns]], *told], [*batch.schema.names[:columns], *_CUT])

    cuts = ", first long, words long, first_byte long, end_byte long, hash long, gram binary"
    grams = items.select("item", "text").mapInArrow(lambda batches: cut(batches, None, None, 1), "item string" + cuts)
    grams = written(grams.select("item", "words", "hash", "gram").distinct(), "grams")
    lengths = {r.words for r in grams.select("words").distinct().collect()}  # n at most
    bits = spark.sparkContext.broadcast(summary(grams, "hash"))
    keyed = docs.select(row_key().alias("row_key"), row_check().alias("row_check"), "text")
    maybe = keyed.mapInArrow(lambda batches: cut(batches, lengths, lambda x: summarised(bits.value, x), 2), "row_key long, row_check long" + cuts)
    wanted = grams.groupBy("gram").agg(F.collect_set("item").alias("who"))
    hits = written(maybe.dropDuplicates([*ROW, "first", "words"]).join(wanted, "gram").select(*ROW, "first", (F.col("first") + F.col("words")).alias("end"), "first_byte", "end_byte", "who"), "hits")
    order = Window.partitionBy(*ROW).orderBy("first", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = hits.withColumn("fresh", F.when(F.coalesce(before, F.lit(-1)) < F.col("first"), 1).otherwise(0)).withColumn("run", F.sum("fresh").over(order))
    spans = runs.groupBy(*ROW, "run").agg(F.min("first").alias("first"), F.max("end").alias("end"), F.min("first_byte").alias("first_byte"), F.max("end_byte").alias("end_byte"))
    spans = spans.groupBy(*ROW).agg(F.array_sort(F.collect_list(F.struct("first", "end", "first_byte", "end_byte"))).alias("spans"))
    who = hits.select(*ROW, F.explode("who").alias("item")).groupBy(*ROW).agg(F.array_sort(F.collect_set("item")).alias("items"))
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    inner = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]
    rows = docs.select(*inner, F.coalesce(F.regexp_count(lower, F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"), row_key().alias("row_key"), row_check().alias("row_check"))
    out = rows.join(spans.join(who, list(ROW)), list(ROW), "left")
    lists = [F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in (("spans", _SPANS), ("items", _ITEMS))]
    return out.select(*[f"c{i}" for i in range(len(columns))], "n_words", *lists).toDF(*columns, *FOUND)


_CUT = ("first", "words", "first_byte", "end_byte", "hash", "gram")


def n_hit():
    return F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["first"])


def without_documents(docs: DataFrame, benchmark: DataFrame, least: float = 0.0, n: int = WORDS) -> DataFrame:
    """docs without those of whose words a share above least is hit."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    found = scan(docs, benchmark, n=n).toDF(*names, *FOUND)
    return found.where((F.size("spans") == 0) | (n_hit() <= F.col("n_words") * F.lit(least))).select(*names).toDF(*docs.columns)


def without_spans(docs: DataFrame, benchmark: DataFrame, n: int = WORDS) -> DataFrame:
    """docs with the hit words cut out of their texts, from the first byte of a span to its last."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index("text")]
    found, raw = scan(docs, benchmark, n=n).toDF(*names, *FOUND), F.col(text).cast("binary")
    state = F.struct(F.lit(1).alias("at"), F.lit(b"").alias("kept"))

    def cut(acc, s):
        piece = F.substring(raw, acc["at"], (s["first_byte"] + 1).cast("int") - acc["at"])
        return F.struct((s["end_byte"] + 1).cast("int").alias("at"), F.concat(acc["kept"], piece).alias("kept"))

    left = F.aggregate("spans", state, cut, lambda acc: F.concat(acc["kept"], F.substring(raw, acc["at"], F.octet_length(raw))))
    new = F.when(F.size("spans") > 0, F.decode(left, "UTF-8")).otherwise(F.col(text))
    return found.select(*[new.alias(c) if c == text else F.col(c) for c in names]).toDF(*docs.columns)


def report(docs: DataFrame, benchmark: DataFrame, n: int = WORDS, **bounds: int) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    found = scan(docs, benchmark, ["doc_id"], n, **bounds)
    out = found.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)
