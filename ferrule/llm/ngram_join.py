"""N-gram Jaccard self-join by token-combination prefixes, and its components.

A document is the set of its distinct k-word shingles. Two sets link when
100 * intersection >= least * union. Equal sets are one set from the start, known by 128 bits
of their shingles' digest.

Prefixes. Sets are compared within size bands one octave wide; a set near the upper edge of its
band is in the next one, too, so sets that can link share a band. Within a band a hash fixes a
part U of all shingles; the frequency of each shingle of U is counted over all sets of the band.
The global order is: U by rising frequency, then the rest by hash. Of a set with s shingles at
most t = s - ceil(least * s / 100) are missing from a set it links with. Its prefix goes on until
t + 1 matches could be lost without losing all signatures: a rare shingle counts 1 and is a
signature by itself; frequent ones are dealt by hash into classes, a class with c of them counts
c - 1, and its pairs are the signatures. For the set whose prefix ends first, what remains
after t losses is in the other's prefix, too, so sets that link share a signature. Shingles found
in one set only can't match, so sets with t + 1 of these, nearly all in most corpora, are done.

Verification. Each signature makes its first set in a hash order its pivot; sets that share a
signature share a pivot, and form its group. A group is cut into blocks of bounded size. First
each block is verified exactly, within itself and with one block of its group, by products of
incidence matrices; label propagation with pointer jumping joins the links into components.
Then only sets outside their group's main component are verified with the rest of the group,
in one block of them, then two, four and so on, as long as there are such sets: what is in one
component already needs no further link. A dense group of copies ends with its first round, whose
work is in proportion to its sets; each pair of a group that shares no component has been verified
at the end, so no link that joins components is lost. No pairs are written, only stars of links.

Sets are named by 128 bits of their shingles' digest. A 64-bit name (vid) only finds candidates:
sets that share one are verified each for itself.

Data between tasks goes in packed arrays. All is recomputable from the input and from tables in
the shared folder; such tables are erased once nothing reads them any more.

Defined results: documents without words (null text among them) have no shingles and link with
none, so are components by themselves; one with fewer than k words has one shingle, the whole
sequence; equal sets always link; repeated rows are as any equal sets; null doc_id is ignored
in smallest ids unless a component has no other; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import column_bytes, row_slices
from .common import ROW, erased, keep_rows, partitions, row_check, row_key, small_batches, summarised, summary, written
from .words import U, mix, shingle_sets

#: Bytes of text that are worked on at once; shingles that a task holds before it passes them on.
SLICE, HELD = 1 << 20, 1_000_000
#: Sets that may hold a shingle for it to be a signature by itself.
RARE = 8
#: Sets, and shingles, of a verification block.
BLOCK_SETS, BLOCK_SHINGLES = 256, 1 << 20
COLUMNS = 4096
#: Tasks that share what is looked up for the sets of a pivot.
SALTS = 64
#: Links in a partition of the tables that label propagation writes.
ROWS_A_PART = 200_000


def most_missing(size, least: int):
    """How many of a set's shingles a set that links with it can lack."""
    return size - -(-size * least // 100)


def bands(size: int, least: int) -> tuple[int, ...]:
    """The bands of a set; none if it can link with equal sets only."""
    upper = 100 * size // least
    if upper == size and -(-size * least // 100) == size:
        return ()
    return tuple(range(size.bit_length() - 1, upper.bit_length()))


def counted_share(band: int, least: int) -> int:
    """U within a band, of 65536: all of small sets, a fixed part of large ones."""
    return min(65536, int(65536 * 1.5 * (100 - least) / 100 * (1 + 2.0 ** (6 - band))))


def classes(band: int) -> int:
    return max(1, 1 << max(0, band - 6))


def in_band(tokens: np.ndarray, band: int) -> np.ndarray:
    return mix(tokens + U(band * 0xA24BAED4963EE407 % 2**64))


def bucket_of(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return ((tokens >> U(16)) & U(0xFFFF)) % U(buckets)


def set_key(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def packed(*arrays: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(a).tobytes() for a in arrays]


def by_key(batches, key: str):
    """Runs of rows of one key, from batches sorted by it, as lists of column dictionaries."""
    at, held = None, []
    for batch in batches:
        rows = batch.to_pylist()
        for row in rows:
            if held and row[key] != at:
                yield at, held
                held = []
            at = row[key]
            held.append(row)
    if held:
        yield at, held


def joined(rows, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(r[name] for r in rows), kind)


# --- first pass: sets, and the counted shingles of each band -----------------------------

_FIRST = "kind int, doc_id long, set binary, vid long, n long, row_key long, row_check long, bucket int, a binary, b binary, c binary"


def first_pass(docs: DataFrame, k: int, least: int, buckets: int) -> DataFrame:
    """kind 0: a row's set; kind 1: packed shingles by bucket; kind 2: packed sets by bucket."""
    names = ["kind", "doc_id", "set", "vid", "n", *ROW, "bucket", "a", "b", "c"]
    types = [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def passed_on(tokens, sets, table):
        """Shingles with the number of their set here, and the sets' facts, packed by bucket."""
        t, s = np.concatenate(tokens), np.concatenate(sets)
        dk, info = np.array([x[0] for x in table], np.uint64), np.array([x[1:] for x in table], np.int64)
        bucket = bucket_of(t, buckets).astype(np.uint16)
        order = np.argsort(bucket, kind="stable")
        bucket, t, s = bucket[order], (t[order] >> U(32)).astype(np.uint32), s[order]
        rows, edges = [], np.searchsorted(bucket, np.arange(buckets + 1))
        for b in range(buckets):
            lo, hi = edges[b], edges[b + 1]
            if hi > lo:
                own, local = np.unique(s[lo:hi], return_inverse=True)
                small = np.uint16 if len(own) < 65536 else np.uint32
                code = bytes([small(0).itemsize])
                rows.append((1, None, code, None, None, None, None, b, *packed(t[lo:hi], local.astype(small), dk[own])))
        home = (dk >> U(32)) % U(buckets)
        for b in np.unique(home).tolist():
            at = np.flatnonzero(home == b)
            rows.append((2, None, None, None, None, None, None, b, *packed(dk[at], info[at]), b""))
        for i in range(0, len(rows), 16):
            yield batch_of(rows[i : i + 16])

    def run(batches):
        tokens, sets, table, held, seen = [], [], [], 0, set()
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            ids, keys, checks = (batch.column(c).to_pylist() for c in ("doc_id", *ROW))
            for a, b in row_slices(offsets, SLICE):
                rows = []
                for i, own in enumerate(shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k), a):
                    key = set_key(own)
                    vid = int.from_bytes(key[:8], "little", signed=True)
                    rows.append((0, ids[i], key, vid, len(own), keys[i], checks[i], None, None, None, None))
                    if key in seen:
                        continue
                    seen.add(key)
                    for band in bands(len(own), least) if len(own) else ():
                        t = in_band(own, band)
                        t = t[(t & U(0xFFFF)) < U(counted_share(band, least))]
                        forced = len(t) - classes(band) < most_missing(len(own), least) + 1
                        dk = int(mix(np.array([(vid + band * 0x9FB21C651E98DF25) % 2**64], np.uint64))[0])
                        tokens.append(t)
                        sets.append(np.full(len(t), len(table), np.uint32))
                        table.append((dk, vid, band, len(own), len(t), int(forced)))
                        held += len(t)
                yield batch_of(rows)
                if held > HELD:
                    yield from passed_on(tokens, sets, table)
                    tokens, sets, table, held, seen = [], [], [], 0, set()
        if table:
            yield from passed_on(tokens, sets, table)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("row_key"), row_check().alias("row_check"))
    return rows.mapInArrow(run, _FIRST)


# --- frequencies, and the sets that are not done ------------------------------------------


def dealt(df: DataFrame, buckets: int, key: str = "bucket") -> DataFrame:
    return df.repartition(buckets, key).sortWithinPartitions(key)


def frequencies(first: DataFrame, buckets: int) -> DataFrame:
    """Packed (set and band, shingle, frequency) of the shingles that two sets or more hold, by the set's bucket."""

    def count(batches):
        for bucket, rows in by_key(batches, "bucket"):
            t = joined(rows, "a", np.uint32)
            dk = np.concatenate([np.frombuffer(r["c"], U)[np.frombuffer(r["b"], f"<u{r['set'][0]}")] for r in rows])
            order = np.argsort(t, kind="stable")
            t, dk = t[order], dk[order]
            twice = np.zeros(len(t), bool)
            twice[1:] = t[1:] == t[:-1]
            twice[:-1] |= twice[1:].copy()
            t, dk = t[twice], dk[twice]
            order = np.lexsort((dk, t))
            t, dk = t[order], dk[order]
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (dk[1:] != dk[:-1])
            t, dk = t[new], dk[new]
            _, back, n = np.unique(t, return_inverse=True, return_counts=True)
            df = n[back].astype(np.uint32) if len(t) else np.zeros(0, np.uint32)
            t, dk, df = t[df > 1], dk[df > 1], df[df > 1]
            token = (U(bucket) << U(32)) | t.astype(np.uint64)
            home = ((dk >> U(32)) % U(buckets)).astype(np.uint16)
            order = np.argsort(home, kind="stable")
            edges = np.searchsorted(home[order], np.arange(buckets + 1))
            out = []
            for b in range(buckets):
                at = order[edges[b] : edges[b + 1]]
                if len(at):
                    out.append((3, b, *packed(dk[at], token[at], df[at])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["kind", "bucket", "a", "b", "c"])

    shingles = first.where("kind = 1").select("set", "bucket", "a", "b", "c")
    return dealt(shingles, buckets).mapInArrow(count, "kind long, bucket long, a binary, b binary, c binary")


def open_sets(first: DataFrame, told: DataFrame, least: int, buckets: int) -> DataFrame:
    """vid, band and the shingles of frequency above 1, of the sets that may link with others."""

    def decide(batches):
        for _, rows in by_key(batches, "bucket"):
            facts = [r for r in rows if r["kind"] == 2]
            dk = joined(facts, "a", U)
            dk, pick = np.unique(dk, return_index=True)
            vid, band, n, counted, forced = joined(facts, "b", np.int64).reshape(-1, 5)[pick].T
            lists = [r for r in rows if r["kind"] == 3]
            owner, token, df = joined(lists, "a", U), joined(lists, "b", U), joined(lists, "c", np.uint32)
            order = np.argsort(owner, kind="stable")
            owner, token, df = owner[order], token[order], df[order]
            lo, hi = np.searchsorted(owner, dk), np.searchsorted(owner, dk, "right")
            alone = counted - (hi - lo)
            out = [
                (int(vid[i]), int(band[i]), *packed(token[lo[i] : hi[i]], df[lo[i] : hi[i]]))
                for i in np.flatnonzero((forced > 0) | (alone < most_missing(n, least) + 1))
                if hi[i] > lo[i] or forced[i]
            ]
            for i in range(0, len(out), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out[i : i + 1000])], ["vid", "band", "tokens", "df"])

    facts = first.where("kind = 2").select("kind", "bucket", "a", "b", "c")
    told = told.select(F.col("kind").cast("int").alias("kind"), F.col("bucket").cast("int").alias("bucket"), "a", "b", "c")
    return dealt(facts.unionByName(told), buckets).mapInArrow(decide, "vid long, band long, tokens binary, df binary")


def full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """node, set, vid, n, least_id and all shingles of the wanted sets, from the texts of one row each."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(summary(wanted, "row_key"))

    def run(batches):
        for batch in batches:
            rk = batch.column("row_key").to_numpy()
            hit = summarised(shared.value, rk)
            if hit.any():
                batch, rk = batch.filter(pa.array(hit)), rk[hit]
                data, offsets = column_bytes(batch.column("text"))
                for a, b in row_slices(offsets, SLICE):
                    sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rk[a:b]), pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                        ["row_key", "set", "shingles"],
                    )

    found = docs.select(row_key().alias("row_key"), "text").mapInArrow(run, "row_key long, set binary, shingles binary")
    own = found.join(wanted, ["row_key", "set"]).dropDuplicates(["set"])
    return own.select(F.monotonically_increasing_id().alias("node"), "set", "vid", "n", "least_id", "shingles")


# --- signatures and pivots -----------------------------------------------------------------


def signatures(own: np.ndarray, band: int, common: np.ndarray, df: np.ndarray, least: int, buckets: int) -> np.ndarray:
    """The signatures of a set in a band; common: its counted shingles of frequency above 1, with df."""
    t = in_band(own, band)
    counted = (t & U(0xFFFF)) < U(counted_share(band, least))
    inside, outside = t[counted], np.sort(t[~counted])
    name = (bucket_of(inside, buckets) << U(32)) | (inside >> U(32))
    order = np.argsort(common)
    common, df = common[order], df[order]
    at = np.minimum(np.searchsorted(common, name), max(0, len(common) - 1))
    shared = common[at] == name if len(common) else np.zeros(len(name), bool)
    need = most_missing(len(own), least) + 1 - int((~shared).sum())
    if need <= 0:
        return np.zeros(0, np.uint64)
    often = np.where(shared, df[at], 1)[shared] if len(common) else np.zeros(0, np.uint32)
    inside = inside[shared]
    order = np.lexsort((inside, often))
    inside, often = inside[order], often[order]
    frequent = often > RARE
    group = ((inside >> U(8)) % U(classes(band))).astype(np.int64)
    counts = np.ones(len(inside), np.int64)
    at = np.flatnonzero(frequent)
    counts[at[np.unique(group[at], return_index=True)[1]]] = 0
    sums = np.cumsum(counts)
    end = int(np.searchsorted(sums, need)) + 1
    got = int(sums[min(end, len(sums)) - 1]) if len(sums) else 0
    inside, frequent, group = inside[:end], frequent[:end], group[:end]
    out = [inside[~frequent]]
    for g in np.unique(group[frequent]):
        mine = np.sort(inside[frequent & (group == g)])
        i, j = np.triu_indices(len(mine), 1)
        out.append(mix(mine[i] * U(0xD6E8FEB86659FD93) + mine[j]))
    if got < need:
        out.append(outside[: need - got])
    return np.concatenate(out)


def pivot_pairs(opened: DataFrame, sets: DataFrame, least: int, buckets: int) -> DataFrame:
    """pivot, vid: each set with the pivots of its signatures, pivots among their own."""

    def sign(batches):
        sigs, vids, held = [], [], 0

        def out():
            s, v = np.concatenate(sigs), np.concatenate(vids)
            b = (bucket_of(s, buckets)).astype(np.uint16)
            order = np.argsort(b, kind="stable")
            edges = np.searchsorted(b[order], np.arange(buckets + 1))
            rows = [(i, *packed(s[at], v[at])) for i in range(buckets) if len(at := order[edges[i] : edges[i + 1]])]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["bucket", "a", "b"])

        for batch in batches:
            for r in batch.to_pylist():
                s = signatures(
                    np.frombuffer(r["shingles"], U), r["band"], np.frombuffer(r["tokens"], U), np.frombuffer(r["df"], np.uint32), least, buckets
                )
                if len(s):
                    sigs.append(s)
                    vids.append(np.full(len(s), r["vid"], np.int64))
                    held += len(s)
            if held > HELD:
                yield out()
                sigs, vids, held = [], [], 0
        if held:
            yield out()

    def meet(batches):
        for _, rows in by_key(batches, "bucket"):
            s, v = joined(rows, "a", U), joined(rows, "b", np.int64)
            rank = mix(v.view(U))
            order = np.lexsort((rank, s))
            s, v, rank = s[order], v[order], rank[order]
            new = np.ones(len(s), bool)
            new[1:] = s[1:] != s[:-1]
            run = np.cumsum(new) - 1
            head = np.flatnonzero(new)
            p = v[head][run]  # the first in the hash order
            other = p != v
            with_others = np.zeros(len(head), bool)
            with_others[run[other]] = True
            use = with_others[run]
            pairs = np.unique(np.stack([p[use], v[use]], axis=1), axis=0)
            if len(pairs):
                p, v = np.ascontiguousarray(pairs.T).view(U)
                part = (mix(p) ^ mix(v + U(1))) % U(buckets)
                order = np.argsort(part, kind="stable")
                edges = np.searchsorted(part[order], np.arange(buckets + 1).astype(np.uint64))
                rows = [(i, pairs[at].tobytes()) for i in range(buckets) if len(at := order[edges[i] : edges[i + 1]])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["bucket", "a"])

    def single(batches):
        for _, rows in by_key(batches, "bucket"):
            pairs = np.unique(joined(rows, "a", np.int64).reshape(-1, 2), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["pivot", "vid"])

    signed = opened.join(sets.select("vid", "shingles"), "vid").select("vid", "band", "tokens", "df", "shingles")
    signed = signed.mapInArrow(sign, "bucket long, a binary, b binary")
    met = dealt(signed, buckets).mapInArrow(meet, "bucket long, a binary")
    return dealt(met, buckets).mapInArrow(single, "pivot long, vid long")


# --- verification ---------------------------------------------------------------------------


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all sets of left with all of right, in columns of bounded number."""
    out = np.zeros((len(left), len(right)), np.float32)
    tokens = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in [*left, *right]])
    _, column, times = np.unique(tokens, return_inverse=True, return_counts=True)
    keep = times[column] > 1
    column, owner = column[keep], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        if b > a:
            m = np.zeros((len(left) + len(right), COLUMNS), np.float32)
            m[owner[a:b], column[a:b] - lo] = 1
            out += m[: len(left)] @ m[len(left) :].T
    return out


def links_of(rows: list[dict], least: int) -> list[tuple[int, int]]:
    """(root, node) of the sets of a task that link: those of side 0 among each other and with those of side 1, or, if labels are given, sets of side 0 with sets of side 1 of another label."""
    left, right = ([r for r in rows if r["side"] == k] for k in (0, 1))
    labelled = rows[0]["label"] is not None
    if not labelled:
        right = left + right
    if not left or not right or len(right) < 2 and not labelled:
        return []
    own, other = ([np.frombuffer(r["shingles"], U) for r in side] for side in (left, right))
    a, b = ([np.array([r["node"] for r in side]) for side in (left, right)])
    na, nb = ([np.array([len(x) for x in side], np.int64) for side in (own, other)])
    # only sets whose sizes allow a link, and that are not in one component already
    may = (100 * np.minimum.outer(na, nb) >= least * np.maximum.outer(na, nb)) & (a[:, None] != b[None, :])
    if labelled:
        la, lb = (np.array([r["label"] for r in side]) for side in (left, right))
        may &= la[:, None] != lb[None, :]
    some, some_other = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
    if not len(some):
        return []
    if len(some) == 1 or len(some_other) == 1 or may.sum() <= 4:
        x, y = np.nonzero(may)
        both = np.array([len(np.intersect1d(own[i], other[j], assume_unique=True)) for i, j in zip(x, y)], np.int64)
        linked = 100 * both >= least * (na[x] + nb[y] - both)
        x, y = x[linked], y[linked]
    else:
        both = overlaps([own[i] for i in some], [other[j] for j in some_other]).astype(np.int64)
        linked = may[np.ix_(some, some_other)] & (100 * both >= least * (na[some][:, None] + nb[some_other][None, :] - both))
        x, y = np.nonzero(linked)
        x, y = some[x], some_other[y]
    if not len(x):
        return []
    nodes, at = np.unique(np.concatenate([a[x], b[y]]), return_inverse=True)
    x, y = at[: len(x)], at[len(x) :]
    label = np.arange(len(nodes))
    while True:
        old = label.copy()
        np.minimum.at(label, x, old[y])
        np.minimum.at(label, y, label[x])
        label = label[label]
        if (label == old).all():
            return list(zip(nodes[label].tolist(), nodes.tolist()))


def checked(tasks: DataFrame, full: DataFrame, least: int, buckets: int) -> DataFrame:
    """a, b: links that join the components of the sets of each task (pivot, i, j), as stars."""
    rows = tasks.join(full.select("node", "shingles"), "node").select("pivot", "i", "j", "side", "node", "label", "shingles")
    rows = rows.repartition(buckets, "pivot", "i", "j").sortWithinPartitions("pivot", "i", "j")

    def check(batches):
        def out(found):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

        key, group, found = None, [], []
        for batch in batches:
            for r in batch.to_pylist():
                now = r["pivot"], r["i"], r["j"]
                if now != key and group:
                    found += links_of(group, least)
                    group = []
                key = now
                group.append(r)
            if len(found) > 10_000:
                yield out(found)
                found = []
        if group:
            found += links_of(group, least)
        if found:
            yield out(found)

    return rows.mapInArrow(check, "a long, b long")


def block_of(blocks, seed: str):
    return F.pmod(F.xxhash64("node", "pivot", F.lit(seed)), blocks).cast("int")


def blocks_for(sets: str, words: str):
    return F.greatest(F.ceil(F.col(sets) / BLOCK_SETS), F.ceil(F.col(words) / BLOCK_SHINGLES)).cast("int")


def by_group(members: DataFrame, groups: DataFrame, how: str = "inner") -> DataFrame:
    """members joined with what is known of their pivots, those of a hot pivot by many tasks."""
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return members.withColumn("salt", salt).join(salted, ["pivot", "salt"], how).drop("salt")


def linked(pairs: DataFrame, full: DataFrame, least: int, buckets: int) -> DataFrame:
    """v, label: the component of every set that links with another, v and label being nodes of full."""
    none = F.lit(None).cast("long").alias("label")
    members = written(pairs.join(full.select("vid", "node", "n"), "vid").select("pivot", "node", "n"), "members")
    sizes = members.groupBy("pivot").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("words"))
    sizes = written(sizes.where("sets > 1").select("pivot", blocks_for("sets", "words").alias("blocks")), "sizes")
    large = sizes.where("blocks > 1")
    # first all blocks, each within itself and with block 0
    dealt_out = by_group(members, large, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt_out = dealt_out.withColumn("i", block_of(F.col("blocks"), "first"))
    home = dealt_out.select("pivot", "i", F.lit(0).alias("j"), F.lit(0).alias("side"), "node", none)
    hubs = dealt_out.where("blocks > 1 AND i = 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("blocks") - 1)))
    hubs = hubs.select("pivot", "i", F.lit(0).alias("j"), F.lit(1).alias("side"), "node", none)
    found = written(checked(home.unionByName(hubs), full, least, buckets), "found")
    label = components(found)
    erased(found)
    # then what is not yet in its group's main component, in ever more blocks a round, with all of its group
    far, done, span = None, 0, 1
    while True:
        known = label.select(F.col("v").alias("node"), "label")
        if far is None:
            marked = by_group(members, large.select("pivot")).join(known, "node", "left").withColumn("label", F.coalesce("label", "node"))
            held = marked.groupBy("pivot", "label").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("words"))
            main = held.groupBy("pivot").agg(
                F.max_by("label", F.struct("sets", "label")).alias("main"),
                F.sum("sets").alias("sets"),
                F.sum("words").alias("words"),
                F.max(F.struct("sets", "label", "words")).alias("top"),
            )
            main = main.withColumn("rest", F.col("sets") - F.col("top.sets")).withColumn("rest_words", F.col("words") - F.col("top.words"))
            main = main.where("rest > 0").select("pivot", "main", blocks_for("sets", "words").alias("blocks"), blocks_for("rest", "rest_words").alias("parts"))
            far = written(main, "far")
        # main is a set of the main component: it leads to its label of today
        now = far.where(F.col("parts") > done).join(known.toDF("main", "now"), "main", "left")
        now = now.select("pivot", F.coalesce("now", "main").alias("main"), "blocks", "parts")
        marked = by_group(members, now).join(known, "node", "left").withColumn("label", F.coalesce("label", "node"))
        marked = marked.withColumn("part", F.when(F.col("label") != F.col("main"), block_of(F.col("parts"), "rest")))
        marked = written(marked.select("pivot", "node", "label", "blocks", "part"), "marked")
        todo = marked.where((F.col("part") >= done) & (F.col("part") < done + span))
        asked = written(todo.select("pivot", "part", "blocks").distinct(), "asked")
        if marked.where(F.col("part") >= done).isEmpty():
            erased(marked, asked, members, far, sizes)
            return label
        per = asked.groupBy("pivot").agg(F.collect_set("part").alias("parts"))  # at most span numbers
        home = by_group(marked, per).withColumn("i", block_of(F.col("blocks"), "all")).withColumn("j", F.explode("parts"))
        home = home.select("pivot", "i", "j", F.lit(0).alias("side"), "node", "label")
        hubs = todo.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        hubs = hubs.select("pivot", "i", F.col("part").alias("j"), F.lit(1).alias("side"), "node", "label")
        found = written(checked(home.unionByName(hubs), full, least, buckets), "found")
        old, label = label, components(found.unionByName(label.toDF("a", "b")))
        erased(found, marked, asked, old)
        done, span = done + span, 2 * span


def components(edges: DataFrame) -> DataFrame:
    """v, label: the least vertex that each vertex of the edges (a, b) reaches."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.where("a <> b").distinct(), "edges")
    parts = max(1, -(-both.count() // ROWS_A_PART))
    few = lambda df: df.coalesce(parts)  # noqa: E731  the tables of a round are as small as the links
    both = few(both)
    label = written(few(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("label"))), "labels")
    while True:
        near = both.join(label.toDF("b", "theirs"), "b").groupBy("a").agg(F.min("theirs").alias("theirs"))
        lower = label.join(near.toDF("v", "theirs"), "v").select("v", F.col("label").alias("old"), F.least("label", "theirs").alias("label"))
        lower = written(few(lower), "lower")
        jump = lower.join(lower.select("v", "label").toDF("label", "next"), "label").select("v", "old", F.col("next").alias("label"))
        jump = written(few(jump), "labels")
        if jump.where("label <> old").isEmpty():
            erased(label, lower, both)
            return written(jump.select("v", "label"), "components")
        erased(label, lower)
        label = jump.select("v", "label")


def near_duplicates(docs: DataFrame, k: int, least: int) -> DataFrame:
    """doc_id, n_shingles, component_id, n_copies, component_size, row_key, row_check, set and component of every row of docs.

    component_id is a doc_id, which may be null or stand for several components; component names one, by one of
    its sets. n_copies are the rows with the same set, component_size those of the component, the row itself included.
    """
    small_batches(docs.sparkSession)
    buckets = min(65535, partitions(docs.sparkSession))
    first = written(first_pass(docs, k, least, buckets), "first")
    told = written(frequencies(first, buckets), "frequencies")
    opened = written(open_sets(first, told, least, buckets), "open")
    rows = written(first.where("kind = 0").select("doc_id", "n", *ROW, "set", "vid"), "rows")
    erased(first, told)
    one = F.min(F.struct(*ROW)).alias("one")
    sets = rows.groupBy("set", "vid").agg(F.min("doc_id").alias("least_id"), one, F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    sets = written(sets.select("set", "vid", "least_id", "one.row_key", "n", "copies"), "sets")
    wanted = written(opened.select("vid").distinct().join(sets.select("vid", "set", "row_key", "n", "least_id"), "vid"), "wanted")
    full = written(full_sets(docs, wanted, k), "full")
    pairs = written(pivot_pairs(opened, full, least, buckets), "pairs")
    erased(wanted, opened)
    label = linked(pairs, full, least, buckets)
    erased(pairs)
    members = label.toDF("node", "label").join(full.select("node", "set"), "node").join(sets.select("set", "least_id", "copies"), "set")
    members = written(members.select("set", "label", "least_id", "copies"), "members")
    erased(label, full)
    tops = members.groupBy("label").agg(F.min("least_id").alias("top"), F.sum("copies").alias("size"), F.min("set").alias("component"))
    told = sets.select("set", "least_id", "n", "copies").join(members.select("set", "label").join(tops, "label"), "set", "left")
    empty = F.col("n_shingles") == 0
    return rows.withColumnRenamed("n", "n_shingles").drop("vid").join(told.drop("n"), "set").select(
        "doc_id",
        "n_shingles",
        F.when(empty, F.col("doc_id")).otherwise(F.coalesce("top", "least_id")).alias("component_id"),
        F.when(empty, F.lit(1)).otherwise(F.col("copies")).cast("long").alias("n_copies"),
        F.when(empty, F.lit(1)).otherwise(F.coalesce("size", "copies")).cast("long").alias("component_size"),
        *ROW,
        "set",
        F.coalesce("component", "set").alias("component"),
    )


def one_of_each(docs: DataFrame, k: int = 5, least: int = 80) -> DataFrame:
    """The rows of docs, with their columns, of which each component keeps one, its smallest id (null if it has no other).

    Rows without words are components by themselves and stay; of rows with equal id and text one stays.
    """
    found = written(near_duplicates(docs, k, least).select("doc_id", "n_shingles", "component", *ROW), "components")
    rows = found.where("n_shingles > 0").groupBy("component", "doc_id", *ROW).agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *ROW, "n")).alias("first"))
    first = written(first.select(*[f"first.{c}" for c in (*ROW, "n")]), "chosen")
    chosen = first.select(*ROW, F.lit(True).alias("chosen")).distinct()
    decided = found.join(chosen, list(ROW), "left").select(
        *ROW, (F.coalesce("chosen", F.lit(False)) | (F.col("n_shingles") == 0)).alias("kept")
    )
    # all copies of a chosen row have its key: that one of them goes leaves one
    repeated = first.where("n > 1").select(*ROW, F.lit(False).alias("kept"))
    return keep_rows(docs, decided.unionByName(repeated))
