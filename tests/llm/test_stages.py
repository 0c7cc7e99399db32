"""The pipeline's stages against brute force, on rows with nulls, repeats, copies, long texts and clashing columns."""

import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from ferrule.llm import language_id, queries

from .test_small_cases import jaccard_components, words

SCHEMA = "doc_id long, text string, lang string, source string, row_key string, kept int, c0 double, n_shingles string"
SPACES = "[\x20\x09-\x0d]+"
VOCABULARY = {
    "en": "the house with many windows stands beside which river where children would often swim through warm evenings".split(),
    "de": "das haus mit vielen fenstern steht neben einem fluss wo kinder oft durch warme abende schwimmen wollten".split(),
}


def rows():
    rng = random.Random(21)
    out = []
    for i in range(90):
        lang = rng.choice(["en", "de"])
        ws = [rng.choice(VOCABULARY[lang]) for _ in range(rng.choice([4, 30, 60]))]
        out.append((i, " ".join(ws), lang if i % 3 else None, rng.choice(["a", "b", "ü", None]), "k", 1, None, "x"))
    some = out[:30]
    for i, r in enumerate(some[:12]):  # the same text but for white space
        out.append((100 + i, r[1].replace(" ", "\n  ") + "\t", *r[2:]))
    for i, r in enumerate(some[12:24]):  # a word changed in long texts
        ws = r[1].split()
        ws[-1] = "other"
        out.append((200 + i if i % 4 else None, " ".join(ws), *r[2:]))
    out += [some[3], some[3], (None, some[4][1], *some[4][2:]), (5, "the house stands beside another river", "en", "a", None, None, None, None)]
    out += [(300, None, "en", "a", None, None, None, None), (301, "", "de", "b", None, None, None, None), (302, " \t ", None, None, None, None, None, None)]
    out += [(303, "12 + 34", "en", "b", None, None, None, None), (304, " ".join(rng.choice(VOCABULARY["de"]) for _ in range(30_000)), "de", "b", None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage was given and what it made of it."""
    docs, out = spark.createDataFrame(rows(), SCHEMA).repartition(5), {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, None).cache()
        out[name] = docs, made
        docs = made
    return out


def both(stages, name):
    docs, made = stages[name]
    assert docs.columns == made.columns
    return [tuple(r) for r in docs.collect()], [tuple(r) for r in made.collect()]


def id_order(r):
    return r[0] is None, r[0] or 0


def test_language_stage(stages):
    docs, kept = both(stages, "language_id")
    told = Counter((r.doc_id, r.lang_pred != "und" and r.score >= 0.5) for r in language_id.language_id(stages["language_id"][0]).collect())
    stay = Counter(r[0] for r in kept)
    assert stay == Counter({k: n for (k, yes), n in told.items() if yes})
    assert all(re.search("[a-z]", r[1] or "") for r in kept) and len(kept) == sum(bool(re.search("[a-z]", r[1] or "")) for r in docs)


def test_exact_dedup_stage(stages):
    docs, kept = both(stages, "exact_dedup")
    groups = defaultdict(list)
    for r in docs:
        groups[re.sub(SPACES, "", r[1] or "")].append(r)
    best = [min(g, key=lambda r: (-len(r[1] or ""), *id_order(r))) for g in groups.values()]
    assert len(kept) < len(docs)
    assert Counter((r[0], r[1]) for r in kept) == Counter((r[0], r[1]) for r in best)


def test_near_duplicate_stage(stages):
    docs, kept = both(stages, "near_duplicates")
    own = [(i, r[1]) for i, r in enumerate(docs)]  # numbers in place of ids, which may be null or repeated
    top = {i: component for (i, _, component, _, _), _ in jaccard_components(own, 5, 80).items()}
    groups = defaultdict(list)
    for i, r in enumerate(docs):
        groups[top[i]].append(r)
    assert len(kept) == len(groups) < len(docs)
    stay = Counter((r[0], r[1]) for r in kept)
    for g in groups.values():
        least = min(map(id_order, g))
        assert sum(stay[k] for k in {(r[0], r[1]) for r in g}) == 1
        assert any(id_order(r) == least and stay[r[0], r[1]] for r in g)


def test_mix_stage(stages):
    docs, kept = both(stages, "source_mix")
    size, taken, times = Counter(), Counter(), Counter((r[0], r[1]) for r in kept)
    for r in docs:
        size[r[3]] += len(words(r[1]))
    for r in kept:
        taken[r[3]] += len(words(r[1]))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(size.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * size[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2 * size[s]
            left -= 2 * size[s]
        open_ -= full
    longest = {s: max(len(words(r[1])) for r in docs if r[3] == s) for s in names}
    for s in names:
        assert target[s] - 1 <= taken[s] <= target[s] + longest[s]
    assert set(times) <= {(r[0], r[1]) for r in docs} and max(times.values()) <= 2


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    import public_tokenizers

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs, made = stages["packing"]
    lengths = Counter((r.doc_id, len(model.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in docs.collect())
    pieces = made.collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in pieces if r.start == 0) == lengths
    assert sum(r.length for r in pieces) == sum(n * k for (_, n), k in lengths.items())
    windows = defaultdict(list)
    for r in pieces:
        windows[r.sequence_id].append((r.offset, r.length))
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 2048


def test_pipeline_of_no_rows(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        columns, docs = docs.columns, stage(spark, docs, None).cache()
        assert docs.count() == 0 and (name == "packing" or docs.columns == columns)


def test_run_is_its_stages(spark):
    assert set(queries.QUERIES["pipeline"](spark, "/root/testdata/sf0.001").columns) >= {"doc_id", "start", "length", "sequence_id", "offset"}
