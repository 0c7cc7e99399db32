"""Secret scans by a linear-chain conditional random field.

Base spans come from three patterns of fixed meaning. The field then tags the tokens of a text,
runs of the characters that keys are made of, as begin, inside or outside of a secret, from their
shape, what stands beside them, and features of the whole text; Viterbi gives the best tags, and
spans that overlap no base span are added. Tokens that are shorter than LEAST, or plain words, are
outside by rule; the runs of other tokens between them are the chains: each is fitted and decoded by
itself, from the start row of the transitions.

The weights are fitted here, on runs of a hash sample of at most TRAIN_RUNS runs of the texts,
labelled by the patterns that name a key (runs with tokens that look like keys, but have no name, are
left out, as they may be either), and on TRAIN_MADE made-up runs of common key formats.

Defined results: null text is empty and has no spans; positions are code points; repeated rows get
equal results; null doc_id is kept; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

LEAST = 8
TRAIN_RUNS, TRAIN_MADE = 2000, 600
EPOCHS, RATE, DECAY = 60, 0.5, 1e-4
KINDS = ("assign", "access", "hex", "crf")

# The base patterns and the least lengths of what they match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST = 12
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
NEAR = frozenset("password passwd pwd secret token key apikey auth authorization bearer credential credentials private access".split())

_TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
_DIGIT = re.compile(r"[0-9]")
_SETTING = re.compile(r"^[ \t]*[\w.-]{1,64}[ \t]*[=:]", re.M)
_ENCODED = re.compile(r"^[ \t]*[A-Za-z0-9+/]{40,}={0,2}[ \t]*$", re.M)
_FILE_NAME = re.compile(r"\.(?:py|js|ts|json|ya?ml|toml|env|ini|cfg|conf|pem|key|sh)\b")
_WORD_BEFORE = re.compile(r"([A-Za-z_]+)[\"']?\s*[:=]?\s*[\"']?\Z")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [("assign", m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    """The tokens that may belong to a secret: with a digit, or long and of mixed case."""
    out = []
    for m in _TOKEN.finditer(text):
        token = m[0].rstrip(".=-_/+") if m[0][-1] == "." else m[0]
        if len(token) >= LEAST and (_DIGIT.search(token) or len(token) >= 20 and re.search("[a-z][A-Z]", token)):
            out.append((m.start(), m.start() + len(token)))
    return out


def runs(text: str) -> list[list[tuple[int, int]]]:
    """Candidates that follow one another with at most three characters, none a letter, between."""
    out: list[list[tuple[int, int]]] = []
    for a, b in candidates(text):
        if out and a - out[-1][-1][1] <= 3 and not any(c.isalnum() for c in text[out[-1][-1][1] : a]):
            out[-1].append((a, b))
        else:
            out.append([(a, b)])
    return out


def features(text: str, a: int, b: int, whole: list[str]) -> list[str]:
    """What is seen of a token: its shape, its neighbours, and its text."""
    token = text[a:b]
    before, after = text[max(0, a - 40) : a], text[b : b + 3]
    n = len(token)
    counts = [token.count(c) for c in set(token)]
    entropy = -sum(c / n * math.log2(c / n) for c in counts)
    digits = sum(c.isdigit() for c in token)
    upper, lower = any(c.isupper() for c in token), any(c.islower() for c in token)
    out = ["bias", f"length:{min(6, n // 8)}", f"entropy:{int(2 * entropy)}", f"digits:{4 * digits // n}", f"case:{upper:d}{lower:d}"]
    if not upper and not lower:
        out.append("numeric")
    if re.fullmatch("[0-9a-f]+", token):
        out.append("hex")
    if re.fullmatch(r"[0-9.]+", token):
        out.append("numbers")
    out += [f"has:{c}" for c in "+/_.=-" if c in token]
    m = re.match(r"[A-Za-z]{2,6}[_-]", token)
    if m:
        out.append("prefix")
    changes = sum(x.isdigit() != y.isdigit() for x, y in zip(token, token[1:]))
    out.append(f"changes:{min(4, changes // 2)}")
    m = _WORD_BEFORE.search(before)
    word = m[1].lower() if m else ""
    if word:
        out.append("near key" if any(p in NEAR for p in re.split("_+", word)) else "near word")
    tail = before.rstrip(" ")[-1:]
    out += [x for x, yes in (("assigned", tail in ("=", ":") or re.search(r"[=:]\s*[\"']\Z", before)), ("quoted", before[-1:] in ("'", '"')), ("at", "@" in (before[-1:], after[:1])), ("url", "//" in before[-12:])) if yes]
    return out + whole


def text_features(text: str) -> list[str]:
    """What is seen of a whole text: code or prose, the shares of its lines that set a value or hold encoded bytes, names of files."""
    lines = text.count("\n") + 1
    settings, encoded = sum(1 for _ in _SETTING.finditer(text)), sum(1 for _ in _ENCODED.finditer(text))
    out = ["text: code"] if text.count("=") + text.count(";") + text.count("{") > len(text) / 200 + 1 else ["text: prose"]
    out += [f"text: settings {min(3, 4 * settings // lines)}", f"text: encoded {min(3, 4 * encoded // lines)}"]
    return out + ["text: file name"] if _FILE_NAME.search(text) else out


def labels(text: str, run: list[tuple[int, int]]) -> list[int]:
    """0 outside, 1 begin, 2 inside: a token is a secret if a pattern that names a key covers it."""
    named = [(a, b) for kind, a, b in base_spans(text) if kind != "hex"]
    out = []
    for a, b in run:
        hit = any(x < b and a < y for x, y in named)
        out.append(0 if not hit else 2 if out and out[-1] else 1)
    return out


def undecided(token: list[str], tag: int) -> bool:
    """Whether a token that no pattern names looks so much like a key that it is no example of the contrary."""
    seen = set(token)
    long = any(f"length:{k}" in seen for k in range(2, 7)) and any(f"entropy:{k}" in seen for k in range(6, 14))
    return tag == 0 and long and not seen & {"numeric", "numbers", "at", "url"}


def made_runs(seed: int = 7) -> list[tuple[list[list[str]], list[int]]]:
    """Runs of common key formats, and of what looks like keys and is none."""
    rng = random.Random(seed)
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    hex_ = "0123456789abcdef"
    keys = [
        lambda: f'token = "{pick(hex_, rng.choice([32, 40, 64]))}"',
        lambda: f"key: {pick(base64, 24)}{pick(base64 + '+/', 16)}==",
        lambda: f"ghp_{pick(base64, 36)}",
        lambda: f"sk_live_{pick(base64, 24)}",
        lambda: f"xoxb-{pick('0123456789', 11)}-{pick(base64, 24)}",
        lambda: f"Authorization: Bearer {pick(base64, 20)}.{pick(base64, 30)}.{pick(base64, 20)}",
        lambda: f"AKIA{pick(base64[:26] + '0123456789', 16)}",
        lambda: f"password={pick(base64, 14)}",
    ]
    others = [
        lambda: f"version {rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(100, 999)}.{rng.randint(0, 9)}",
        lambda: f"on {rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)} it",
        lambda: f"call {pick('0123456789', rng.randint(8, 16))} now",
        lambda: f"see file_{pick('abcdefgh', 6)}_{rng.randint(1, 99)}.html for",
        lambda: f"{pick('abcdefgh', 5)}.{rng.randint(10, 99)}@mail{rng.randint(0, 9)}.example.com",
        lambda: f"{rng.randint(10, 250)}.{rng.randint(10, 250)}.{rng.randint(10, 250)}.{rng.randint(10, 250)}",
        lambda: f"the https://example.com/{pick('abcdef', 6)}/page{rng.randint(1, 999)} page",
    ]
    out = []
    for i in range(TRAIN_MADE):
        secret = i % 2 == 0
        text = f"{pick('aeionrst', 6)} {(rng.choice(keys) if secret else rng.choice(others))()} {pick('aeionrst', 5)}"
        for run in runs(text):
            tags = [1, *[2] * (len(run) - 1)] if secret else [0] * len(run)
            out.append(([features(text, a, b, text_features(text)) for a, b in run], tags))
    return out


class Field:
    """Weights of features by tag and of transitions; tag 2 must follow tag 1 or 2."""

    def __init__(self, names: dict[str, int]):
        self.names = names
        self.w = np.zeros((len(names), 3))
        self.t = np.zeros((4, 3))  # row 3: the start
        self.barred = np.zeros((4, 3))
        self.barred[0, 2] = self.barred[3, 2] = -1e9

    def scores(self, run: list[list[str]]) -> np.ndarray:
        return np.array([self.w[[self.names[f] for f in token if f in self.names]].sum(axis=0) for token in run])

    def step(self, run: list[list[str]], tags: list[int], rate: float) -> None:
        """One step up the gradient of a run's log likelihood."""
        s, t = self.scores(run), self.t + self.barred
        n = len(run)
        fwd, bwd = np.zeros((n, 3)), np.zeros((n, 3))
        fwd[0] = s[0] + t[3]
        for i in range(1, n):
            fwd[i] = s[i] + np.logaddexp.reduce(fwd[i - 1][:, None] + t[:3], axis=0)
        for i in range(n - 2, -1, -1):
            bwd[i] = np.logaddexp.reduce(t[:3] + (s[i + 1] + bwd[i + 1])[None, :], axis=1)
        z = np.logaddexp.reduce(fwd[-1])
        p = np.exp(fwd + bwd - z)
        for i, token in enumerate(run):
            g = -p[i]
            g[tags[i]] += 1
            at = [self.names[f] for f in token]
            self.w[at] += rate * g / math.sqrt(len(at))
        g = np.zeros((4, 3))
        g[3] -= p[0]
        g[3, tags[0]] += 1
        for i in range(1, n):
            g[:3] -= np.exp(fwd[i - 1][:, None] + t[:3] + (s[i] + bwd[i])[None, :] - z)
            g[tags[i - 1], tags[i]] += 1
        self.t += rate * g

    def best(self, run: list[list[str]]) -> list[int]:
        """The tags of highest score, by Viterbi; ties go to the lower tag."""
        s, t = self.scores(run), self.t + self.barred
        score, back = s[0] + t[3], []
        for i in range(1, len(run)):
            all_ = score[:, None] + t[:3]
            back.append(all_.argmax(axis=0))
            score = s[i] + all_.max(axis=0)
        tags = [int(score.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]


def fitted(data: list[tuple[list[list[str]], list[int]]]) -> Field:
    names: dict[str, int] = {}
    for run, _ in data:
        for token in run:
            for f in token:
                names.setdefault(f, len(names))
    field, rng = Field(names), random.Random(11)
    order = list(range(len(data)))
    for epoch in range(EPOCHS):
        rng.shuffle(order)
        rate = RATE / (1 + epoch / 4)
        for i in order:
            field.step(*data[i], rate)
        field.w *= 1 - DECAY
    return field


def learn(docs: DataFrame) -> Field:
    """A field fitted on the made-up runs and on a bounded hash sample of the texts' own."""

    def pick(batches):
        for batch in batches:
            out = []
            for text in batch.column("text"):
                text = text.as_py()
                whole = text_features(text)
                for run in runs(text):
                    seen = [features(text, a, b, whole) for a, b in run]
                    around = text[max(0, run[0][0] - 80) : run[-1][1] + 10]
                    shift = max(0, run[0][0] - 80)
                    tags = labels(around, [(a - shift, b - shift) for a, b in run])
                    if any(map(undecided, seen, tags)):
                        continue
                    digest = hashlib.md5(around.encode("utf-8", "replace")).hexdigest()
                    out.append((digest, seen[:64], tags[:64]))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.list_(pa.list_(pa.string())), pa.list_(pa.int64())))], ["digest", "run", "tags"]
                )

    # texts of a fixed share of all hashes, fewer the more there are, then the runs of least digest
    some = docs.where(F.col("text").rlike("[0-9]")).select("doc_id", "text")
    total = docs.count()
    share = min(1.0, 20 * TRAIN_RUNS / max(1, total))
    some = some.where(F.pmod(F.xxhash64("doc_id", F.lit("runs")), F.lit(1 << 32)) < F.lit(int(share * (1 << 32))))
    rows = some.select("text").mapInArrow(pick, "digest string, run array<array<string>>, tags array<long>").orderBy("digest").limit(TRAIN_RUNS).collect()
    own = [(r.run, r.tags) for r in rows]
    own.sort(key=lambda x: (x[0], x[1]))
    return fitted(made_runs() + own)


def covering(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """The spans' begins in order, and the greatest end up to each."""
    ordered = sorted((a, b) for _, a, b in spans)
    return [a for a, _ in ordered], list(accumulate((b for _, b in ordered), max))


def all_spans(text: str, field: Field) -> list[tuple[str, int, int]]:
    """Base spans and those that the field adds, by start and kind."""
    base = base_spans(text)
    begins, reach = covering(base)
    added = []
    whole = None
    for run in runs(text):
        whole = whole or text_features(text)
        tags = field.best([features(text, a, b, whole) for a, b in run])
        span = None
        for (a, b), tag in [*zip(run, tags), ((0, 0), 0)]:
            if tag != 2 and span:
                at = bisect_left(begins, span[1])  # base spans that begin before this one ends
                if not at or reach[at - 1] <= span[0]:
                    added.append(("crf", *span))
                span = None
            if tag == 1:
                span = (a, b)
            elif tag == 2 and span:
                span = (span[0], b)
    return sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, spans (kind, begin, end) of every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            found = [
                [{"kind": k, "begin": a, "end": b} for k, a, b in all_spans(text.as_py() or "", shared.value)] for text in batch.column("text")
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,begin:long,end:long>>")


def digest_columns(found: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans as text."""

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == F.lit(kind))).cast("long").alias(f"n_{kind}")

    base = listed(F.filter("spans", lambda s: s["kind"] != "crf"))
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(base, 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
