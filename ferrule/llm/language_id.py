"""Language ID: multinomial naive Bayes over hashed character n-grams.

A text is folded to lower-case letters with every run of other characters as one blank; its
1- to 3-grams are hashed into BUCKETS. Counts per language and bucket are summed over a
sample of the labelled rows of a documented bound (TRAIN_DOCS for each language, chosen by a
hash of the id, all where there are fewer); the smoothed log-probability matrix, languages x
BUCKETS, is broadcast with the priors (the languages' shares of all labelled rows), and batches
are scored in numpy.

Memory is bounded by slices of SLICE bytes; a longer text is scored in parts, each of which is
told the last two folded letters of the part before it, so that no n-gram is lost or counted twice.

Defined results: null texts and texts without a letter are `und` with score 0, as are all
where nothing could be learned; equal scores go to the first language by name; null doc_id is
neither held out nor learned from; repeated rows get equal results; an empty table gives an
empty result; further columns are ignored. More than MOST_LANGUAGES labels is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_text import column_bytes, row_slices
from .common import small_batches

BUCKETS = 1 << 15
TRAIN_DOCS = 20_000
MOST_LANGUAGES = 500
SLICE = 1 << 18
#: Smoothing of counts.
ALPHA = 0.5

_fold: np.ndarray | None = None


def fold_table() -> np.ndarray:
    """For each code point its lower-case letter, or a blank."""
    global _fold
    if _fold is None:
        table = np.full(0x110000, 32, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                table[i] = ord(c.lower()[0])
        _fold = table
    return _fold


NO_CONTEXT = np.zeros(0, np.uint32)


def features(data: np.ndarray, offsets: np.ndarray, context: np.ndarray = NO_CONTEXT):
    """Bucket and row of each n-gram of the rows, whether each row has a letter, and the last two folded letters.

    context holds the folded letters before the first row, if that row goes on a text; n-grams within it are left out.
    """
    rows = len(offsets) - 1
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    at = before[offsets]  # offsets in code points
    codes = np.concatenate([context, fold_table()[points]])
    row = np.concatenate([np.zeros(len(context), np.int64), np.repeat(np.arange(rows), np.diff(at))])
    letter = codes != 32
    lettered = np.zeros(rows, bool)
    lettered[row[letter]] = True
    keep = letter.copy()
    if len(codes):
        keep[1:] |= letter[:-1] | (row[1:] != row[:-1])
        keep[0] = True
    codes, row, letter = codes[keep], row[keep], letter[keep]
    grams, owners, h = [], [], np.zeros(len(codes), np.uint32)
    some = np.zeros(len(codes), bool)
    for n in (1, 2, 3):
        m = len(codes) - n + 1
        if m <= 0:
            break
        h = (h[:m] * np.uint32(0x01000193)) ^ (codes[n - 1 :] * np.uint32(0x9E3779B1))
        some = some[:m] | letter[n - 1 :]
        ok = some & (row[:m] == row[n - 1 :])
        ok[: max(0, len(context) - n + 1)] = False
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(n)
        grams.append((mixed >> np.uint32(32 - BUCKETS.bit_length() + 1))[ok])
        owners.append(row[:m][ok])
    if not grams:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), lettered, codes[-2:]
    return np.concatenate(grams), np.concatenate(owners), lettered, codes[-2:]


def parts(data: np.ndarray, offsets: np.ndarray):
    """Rows a..b with the features of their n-grams, in slices; a row longer than a slice comes in several."""
    for a, b in row_slices(offsets, SLICE):
        lo, hi, context = int(offsets[a]), int(offsets[b]), NO_CONTEXT
        while hi - lo > 2 * SLICE and b == a + 1:
            cut = lo + SLICE
            while cut < hi and (data[cut] & 0xC0) == 0x80:
                cut += 1
            *found, context = features(data[lo:cut], np.array([0, cut - lo]), context)
            yield a, b, *found
            lo = cut
        start = offsets[a : b + 1] - lo
        start[0] = 0
        yield a, b, *features(data[lo:hi], start, context)[:3]


def learn(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray | None]:
    """The languages, sorted, and their log probabilities: a row for each bucket, then the priors."""
    labelled = docs.where(
        F.col("lang").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2)
    )
    counts = {r.lang: r["count"] for r in labelled.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    langs = sorted(counts)
    if not langs:
        return [], None
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, train_docs / counts[k]))])
    chosen = (F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 32)) / F.lit(float(1 << 32))) < share[F.col("lang")]
    number = {k: i for i, k in enumerate(langs)}

    def count(batches):
        total = np.zeros((len(langs), BUCKETS), np.int64)
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            lang = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            for a, b, gram, row, _ in parts(data, offsets):
                total += np.bincount(lang[a:b][row] * BUCKETS + gram, minlength=total.size).reshape(total.shape)
        i, j = np.nonzero(total)
        for s in range(0, len(i), 1 << 16):
            k, g = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(g), pa.array(total[k, g])], ["k", "g", "n"])

    got = labelled.where(chosen).select("text", "lang").mapInArrow(count, "k long, g long, n long")
    got = got.groupBy("k", "g").agg(F.sum("n").alias("n")).toPandas()  # at most languages x buckets
    sums = np.full((BUCKETS, len(langs)), ALPHA)
    sums[got.g.to_numpy(np.int64), got.k.to_numpy(np.int64)] += got.n.to_numpy(np.float64)
    prior = np.array([counts[k] for k in langs], np.float64)
    return langs, np.log(np.vstack([sums / sums.sum(axis=0), prior / prior.sum()])).astype(np.float32)


def rating(spark: SparkSession, langs: list[str], matrix: np.ndarray | None):
    """A column function of text: its language and score."""
    shared = spark.sparkContext.broadcast(matrix)

    def predict(text: pa.Array) -> pa.Array:
        logp, n = shared.value, len(text)
        pred, score = np.full(n, -1), np.zeros(n)
        if logp is not None and n:
            data, offsets = column_bytes(text)
            sums, letters = np.tile(logp[BUCKETS].astype(np.float64), (n, 1)), np.zeros(n, bool)
            for a, b, gram, row, lettered in parts(data, offsets):
                letters[a:b] |= lettered
                for k in range(logp.shape[1]):
                    sums[a:b, k] += np.bincount(row, logp[gram, k], minlength=b - a)
            sums -= sums.max(axis=1, keepdims=True)
            p = np.exp(sums)
            best = p.argmax(axis=1)
            pred = np.where(letters, best, -1)
            score = np.where(letters, p[np.arange(n), best] / p.sum(axis=1), 0.0)
        names = pa.array(["und" if i < 0 else langs[i] for i in pred.tolist()], pa.string())
        return pa.StructArray.from_arrays([names, pa.array(score, pa.float64())], ["lang_pred", "score"])

    return F.arrow_udf(predict, "struct<lang_pred:string,score:double>")


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    small_batches(docs.sparkSession)
    rate = rating(docs.sparkSession, *learn(docs))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), rate("text").alias("r")).select("doc_id", "held_out", "r.lang_pred", "r.score")


def confident(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs, with their columns, whose language is known with at least such a score."""
    small_batches(docs.sparkSession)
    r = rating(docs.sparkSession, *learn(docs))("text")
    return docs.where((r["lang_pred"] != "und") & (r["score"] >= F.lit(least)))
