"""Decontamination, Merkle proofs and clustering against brute force on odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ferrule.llm import decontamination, kd_clusters, merkle, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, g string, n_words int"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- decontamination ---------------------------------------------------------------------------


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def items():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(30)] + ["Ünï", "naïve", "x1"]
    out = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([10, 14, 25])))) for i in range(12)]
    out += [(20, "just Three words"), (21, "just three words"), (22, None), (23, " ,;- "), (None, "a nameless item"), (24, out[0][1]), (24, out[1][1].upper()), (25, "solo")]
    return out


def contaminated():
    rng = random.Random(8)
    bench = [t for _, t in items() if t]
    out = [(0, None), (1, ""), (2, " .,;\n"), (3, "ab" * 40_000), (None, bench[2]), (None, None), (4, "just-three\tWORDS, just three words"), (5, "Solo solo SOLO x solos")]
    for i in range(10, 60):
        parts = [" ".join(rng.choice(["lorem", "ipsum", "É", "w1", "w2"]) for _ in range(rng.choice([0, 3, 40]))) for _ in range(3)]
        for t in rng.sample(bench, rng.choice([0, 0, 1, 2])):
            ws = t.split()
            parts.insert(rng.randrange(3), rng.choice([" ", ", ", " -- "]).join(ws[rng.choice([0, 0, 2]) :]))
        out.append((i, " ".join(parts)))
    out.append((70, " ".join(["filler words go on"] * 60_000 + [bench[3]] + ["and on"] * 9)))  # beyond a slice
    return out + [out[4], out[20], out[20]]


def hits_by_hand(text):
    ws, hit, who = split(text), set(), set()
    for item, t in items():
        iw = split(t)
        n = min(10, len(iw))
        grams = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if iw else set()
        for i in range(len(ws) - n + 1):
            if n and tuple(ws[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                who.add("null" if item is None else str(item))
    return len(ws), hit, who


@pytest.mark.parametrize("most", [decontamination.MOST_WINDOWS, 0])
def test_decontamination(spark, most):
    rows = [(i, t, None, None, None, "s", "g", 1) for i, t in contaminated()]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    bench = spark.createDataFrame(items(), "item_id long, text string").repartition(2)
    got = Counter(tuple(r) for r in decontamination.report(docs, bench, most_windows=most).collect())
    want = Counter()
    for i, t in contaminated():
        n, hit, who = hits_by_hand(t)
        want[(i, n, len(hit), len(who), sha(",".join(sorted(who))), bool(hit))] += 1
    assert got == want
    assert sum(r[5] for r in want) > 15


def test_spans_and_documents_are_removed(spark):
    rows = [(i, t, "x", None, None, "s", "g", 1) for i, t in contaminated()]
    docs = spark.createDataFrame(rows, SCHEMA)
    bench = spark.createDataFrame(items(), "item_id long, text string")
    kept = decontamination.without_documents(docs, bench)
    assert kept.columns == docs.columns
    assert Counter(tuple(r) for r in kept.collect()) == Counter(r for r in rows if not hits_by_hand(r[1])[1])
    cut = decontamination.without_spans(docs, bench)
    assert cut.columns == docs.columns
    left = Counter((r.doc_id, tuple(split(r.text)) if r.text is not None else None) for r in cut.collect())
    want = Counter()
    for r in rows:
        _, hit, _ = hits_by_hand(r[1])
        want[(r[0], tuple(w for k, w in enumerate(split(r[1])) if k not in hit) if r[1] is not None else None)] += 1
    assert left == want
    half = decontamination.without_documents(docs, bench, least=0.5)
    assert half.count() == sum(len(h) <= 0.5 * n for n, h, _ in map(hits_by_hand, (r[1] for r in rows)))


def test_decontamination_of_nothing(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in decontamination.report(docs, none).collect()] == [(1, 2, 0, 0, sha(""), False)]
    assert decontamination.report(docs.where("false"), none).count() == 0
    assert [tuple(r) for r in decontamination.report(docs, none, most_windows=-1).collect()] == [(1, 2, 0, 0, sha(""), False)]


def test_hashes_decide_nothing(spark, monkeypatch):
    """With all hashes alike, words still decide."""
    monkeypatch.setattr(decontamination, "spread", lambda x: x * np.uint64(0))
    grams = decontamination.ngrams([(str(i), t.encode()) for i, t in items() if t])
    for _, t in contaminated()[:30]:
        data = np.frombuffer((t or "").encode(), np.uint8)
        [(n, spans, _)] = decontamination.found_in(grams, data, np.array([0, len(data)]))
        words, hit, _ = hits_by_hand(t)
        assert (n, {k for a, b, _, _ in spans for k in range(a, b)}) == (words, hit)


# --- Merkle proofs -------------------------------------------------------------------------------


def leaf_by_hand(row, text):
    values = (row[0], row[3], row[2], row[4], text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def runs(nodes):
    return [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append(runs(out[-1]))
    return out


def path(tree, at):
    out = []
    for nodes in tree[:-1]:
        run = nodes[at // 8 * 8 : at // 8 * 8 + 8]
        out.append((run[: at % 8], run[at % 8 + 1 :]))
        at //= 8
    return out


def proofs_by_hand(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_by_hand(r, r[1]), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    root, out = top[-1][0], Counter()
    for k, g in enumerate(names):
        for at, (*_, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            steps = path(trees[g], at) + path(top, k)
            odd = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            node = leaf_by_hand(r, r[1].translate(LOW) if odd and r[1] is not None else r[1])
            for left, right in steps:
                node = sha("".join([*left, node, *right]))
            out[(r[0], leaf, trees[g][-1][0], root, sha("".join("".join(a + b) for a, b in steps)), node, node == root)] += 1
    return out


def manifest_rows(seed, n, langs):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = rng.choice([None, "", "Öne TWO\nthree", "plain", f"Text {i}", "Z" * rng.choice([1, 5000])])
        out.append((rng.choice([None, i, i, i % 7]), text, rng.choice(langs), rng.choice([None, "", "ü", "web"]), rng.choice([None, i, -5]), "s", "=en", 1))
    return out + out[:3] + [out[0]] * 3


@pytest.mark.parametrize("n, langs", [(1, ["en"]), (3, ["en"]), (8, ["en"]), (60, ["en", "de", None, "", "é", "Z"]), (700, ["en"] * 6 + [None, "de"]), (90, [f"l{i}" for i in range(70)])])
def test_proofs(spark, n, langs):
    rows = manifest_rows(n, n, langs)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert Counter(tuple(r) for r in merkle.audit(docs).collect()) == proofs_by_hand(rows)


def test_proofs_of_nothing(spark):
    assert merkle.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_proofs_of_one_row_alone(spark):
    rows = [(5, "a", "en", "s", 1, "", "", 1)]
    [got] = merkle.audit(spark.createDataFrame(rows, SCHEMA)).collect()
    assert got.leaf == got.subroot == got.root and got.proof_sha256 == sha("") and got.verified


# --- clustering ------------------------------------------------------------------------------------


def clusters_by_hand(rows, k, rounds, dim):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, sha(f"3:{r[0]}"), r[1]))[:k]
    centres = [v for _, v in first]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min(range(len(centres)), key=lambda c: (apart(v, centres[c]), c))
    for _ in range(rounds):
        of = [near(v) for _, v in kept]
        for c in range(len(centres)):
            mine = [v for (_, v), x in zip(kept, of) if x == c]
            if mine:
                centres[c] = [sum(column) // len(mine) for column in zip(*mine)]
    of = [(i, near(v), v) for i, v in kept]
    dist = [apart(v, centres[c]) for _, c, v in of]
    each = Counter()
    for (_, c, _), d in zip(of, dist):
        each[c] += d
    return Counter((i, c, d, each[c], sum(dist), sha(",".join(map(str, centres[c])))) for (i, c, _), d in zip(of, dist))


def vectors(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (5, dim))
    out = [(i, (centres[i % 5] + spread * rng.normal(0, 1, dim)).round(3).tolist()) for i in range(n)]
    nan, inf = float("nan"), float("inf")
    out += [(n, None), (n + 1, []), (n + 2, [0.5] * (dim - 1)), (n + 3, [0.5] * (dim + 1)), (n + 4, [None] + [1.0] * (dim - 1)), (n + 5, [nan] * dim), (n + 6, [inf] + [0.0] * (dim - 1))]
    out += [out[0], out[0], (None, [0.25] * dim), (3, [-0.5] * dim)] + [(i, [0.125] * dim) for i in range(1000, 1040)]
    return out


@pytest.mark.parametrize("seed, n, dim, spread, k, rounds", [(1, 300, 4, 0.1, 8, 10), (2, 300, 4, 3.0, 8, 4), (3, 120, 64, 1.0, 8, 3), (4, 3, 4, 1.0, 8, 2), (5, 200, 2, 0.0, 3, 10)])
def test_clusters(spark, monkeypatch, seed, n, dim, spread, k, rounds):
    monkeypatch.setattr(kd_clusters, "BLOCK", 64)
    monkeypatch.setattr(kd_clusters, "LEAF", 4)
    rows = vectors(seed, n, dim, spread)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, ids string").repartition(3)
    got = kd_clusters.cluster(df, k=k, rounds=rounds, dim=dim)
    assert Counter(tuple(r) for r in got.collect()) == clusters_by_hand(rows, k, rounds, dim)


def test_nodes_are_assigned_whole():
    rng = np.random.default_rng(9)
    centres = rng.integers(-1000, 1000, (6, 3)) * 10
    v = np.concatenate([c + rng.integers(-40, 40, (200, 3)) for c in centres])
    t = kd_clusters.tree(v.astype(np.int32))
    t["vectors"] = v[t["order"]]
    wholes, rows, _ = kd_clusters.assigned(t, centres)
    covered = sum(int(t["stop"][n] - t["start"][n]) for n, _ in wholes)
    assert covered + len(rows) == len(v) and covered > len(v) // 2


def test_equal_distance_goes_to_the_smaller_number():
    v = np.zeros((100, 2), np.int32)
    t = kd_clusters.tree(v)
    t["vectors"] = v
    for centres in itertools.permutations([[1, 0], [-1, 0], [0, 1], [9, 9]]):
        wholes, rows, chosen = kd_clusters.assigned(t, np.array(centres, np.int64))
        first = min(i for i, c in enumerate(centres) if c != [9, 9])
        assert not wholes and len(rows) == 100 and set(chosen.tolist()) == {first}


def test_clusters_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert kd_clusters.cluster(empty).count() == 0
    assert kd_clusters.cluster(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).count() == 0


def test_components_too_large_for_exact_distances(spark):
    with pytest.raises(Exception, match="would not be exact"):
        kd_clusters.cluster(spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<double>"), dim=2).count()


# --- sharding of large equal rows ----------------------------------------------------------------


@pytest.mark.parametrize("small, large, size, id", [(8000, 3, 1_000_000, 7), (4000, 25, 1_000_000, None)])
def test_large_equal_rows_are_spread(spark, small, large, size, id):
    """Equal rows are hot by their bytes; what cannot be cut is one row."""
    rows = [(i, "x" * 92) for i in range(small)] + [(id, "y" * (size - 8))] * large
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sharding.shard(docs).collect()
    sums = Counter()
    for r in got:
        sums[r.shard] += r.size
    assert len(got) == len(rows) and sorted((r.shard, r.slot) for r in got) == [(s, k) for s in range(24) for k in range(Counter(r.shard for r in got)[s])]
    mean = sum(sums.values()) / 24
    assert max(sums.values()) <= max(mean, size) + size and len({r.shard for r in got if r.size == size}) == min(large, 24)
    again = sharding.shard(docs.repartition(3))
    key = lambda df: Counter((r.doc_id, r.size, r.vslot) for r in df)
    assert key(again.collect()) == key(got)
