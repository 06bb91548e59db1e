"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans, which always stay. The field labels a document's candidate tokens (those with a digit or an at
sign; no other token can be one of the four kinds): unary potentials from a log-linear model of token shape and context,
chain potentials between neighbours, and skip potentials between distant tokens that are equal or share their digits. Tokens in base
spans are observed. Loopy message passing then carries a label from one mention to the others, and tokens that come out
as an entity with high probability add spans.

All three kinds of weights are trained together, from the patterns' own labels on a sample of documents, by the pseudo-likelihood of each token's
label given its neighbours' in the loopy graph. Every token is seen twice, once with its own shape and once with that masked: the patterns
tell most labels from the shape alone, and only where it is hidden do chains and skips have something to explain.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.llm.common import arrow, rows, slices, texts_of

#: In the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Starts behind a digit are left out: there a longer start would have matched or failed the same way.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARK = re.compile(r"[0-9@]")
NOT_DIGIT = re.compile(r"[^0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EDGE = "\"'`.,;:!?()[]{}<>*#$%&=/\\|"

#: Size of the hashed feature table, and what bounds the training sample: documents, and candidate tokens of one document on average.
FEATURES, SAMPLE_DOCS, SAMPLE_TOKENS = 1 << 12, 4000, 64
#: Probability from which a token adds a span.
SURE = 0.9
ROUNDS, DAMPING = 20, 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield "email", start, found.end()
            done = found.end()
        else:
            done = at + 1  # nothing left of this sign can be part of a later match
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points: per kind the leftmost matches that do not overlap, less those that fail its test."""
    if not MARK.search(text):
        return []
    spans = list(_emails(text)) if "@" in text else []
    if "." in text:
        spans += [("ip", *m.span()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", *m.span()))
    if "+" in text:
        spans += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return spans


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of the white-space tokens that hold a digit or an at sign, edge punctuation off."""
    out, done = [], 0
    for m in MARK.finditer(text):
        at = m.start()
        if at < done:
            continue
        start = end = at
        while start > done and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        done = end
        while start < at and text[start] in EDGE and text[start] != "(":
            start += 1
        while end > at + 1 and text[end - 1] in EDGE:
            end -= 1
        out.append((start, end))
    return out


def possible(token: str, run: int = 0) -> list[bool]:
    """Which labels a token's characters allow at all: a number that fails the kind's own test is none of that kind. ``run``: digits of the run of number
    tokens that it stands in, of which a telephone number may be a group."""
    digits = NOT_DIGIT.sub("", token)
    plain = "@" not in token and not any(c.isalpha() for c in token)
    at = token.find("@")
    parts = token.split(".")
    ip = plain and len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    card = plain and 13 <= len(digits) <= 19 and luhn(digits)
    phone = plain and len(parts) != 4 and (3 <= len(digits) <= 15 or 1 <= len(digits) and (token[:1] == "+" or 7 <= run <= 15))
    return [True, 0 < at < len(token) - 1 and "." in token[at:], ip, card, phone]


def _hash(name: str) -> int:
    return zlib.crc32(name.encode()) % FEATURES


def _word(text: str, at: int, step: int) -> str:
    """The whole word next to a place, before (step -1) or after it (step 1)."""
    i = at if step > 0 else at - 1
    while 0 <= i < len(text) and text[i].isspace():
        i += step
    j = i
    while 0 <= j < len(text) and not text[j].isspace():
        j += step
    return text[i:j] if step > 0 else text[j + 1 : i + 1]


def context(text: str, start: int, end: int) -> list[int]:
    """Hashed features of what stands around a token."""
    near = (("before", _word(text, start, -1)), ("after", _word(text, end, 1)))
    return [_hash("any"), *(_hash(f"{side} {w.lower()}") for side, w in near if w and not MARK.search(w))]


def own_features(token: str) -> list[int]:
    """Hashed features of a whole token's shape."""
    shape = re.sub(r"(.)\1+", r"\1+", re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "9", token)))
    digits = sum(c.isdigit() for c in token)
    names = [f"shape {shape}", f"first {shape[:2]}", f"last {shape[-2:]}", f"digits {min(digits, 20)}", f"dots {min(token.count('.'), 5)}", f"length {min(len(token), 40) // 4}", f"at {'@' in token}"]
    return [_hash(n) for n in names]


def features(text: str, start: int, end: int) -> list[int]:
    """Hashed shape and context features of a token."""
    return own_features(text[start:end]) + context(text, start, end)


def number_runs(text: str, spans: list[tuple[int, int]], chain: list[tuple[int, int]]) -> list[str]:
    """For each token the joined digits of the run of neighbouring number tokens that it stands in, empty for a token that is no number."""
    plain = [not any(c.isalpha() or c == "@" for c in text[a:b]) for a, b in spans]
    joined = {j for i, j in chain if plain[i] and plain[j]}
    out, at = [""] * len(spans), 0
    while at < len(spans):
        end = at + 1
        while end in joined:
            end += 1
        if plain[at]:
            out[at:end] = [NOT_DIGIT.sub("", "".join(text[a:b] for a, b in spans[at:end]))] * (end - at)
        at = end
    return out


def keys(token: str, run: str = "") -> list[str]:
    """What equal or similar tokens have in common: the folded token, and the last seven of at least seven digits, its own or its run's."""
    digits = NOT_DIGIT.sub("", token)
    out = [token.casefold()] if len(token) >= 6 else []
    if "@" not in token:
        out += dict.fromkeys(f"#{d[-7:]}" for d in (digits, run) if len(d) >= 7)
    return out


def edges_of(text: str, spans: list[tuple[int, int]], seen: list[int] | None = None) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges (neighbours one space apart) and skip edges. Every mention of a key is linked to the key's hub, its first observed mention or
    else its first, so edges are linear in the mentions and a label is two steps from all of them, however many there are."""
    chain = [(i, i + 1) for i in range(len(spans) - 1) if spans[i + 1][0] - spans[i][1] <= 2 and text[spans[i][1] : spans[i + 1][0]].strip(" ().-,") == ""]
    runs = number_runs(text, spans, chain)
    mentions: dict[str, list[int]] = {}
    for i, (a, b) in enumerate(spans):
        for key in keys(text[a:b], runs[i]):
            mentions.setdefault(key, []).append(i)
    skip = set()
    for own in mentions.values():
        hub = next((i for i in own if seen and seen[i]), own[0])
        skip.update((min(hub, i), max(hub, i)) for i in own if i != hub)
    return chain, sorted(skip.difference(chain))


def observed(spans: list[tuple[int, int]], base: list[tuple[str, int, int]]) -> list[int]:
    """The label of each token that a base span touches, 0 for others."""
    out = [0] * len(spans)
    ordered = sorted(base, key=lambda s: s[1])
    first = 0
    for i, (a, b) in enumerate(spans):
        while first < len(ordered) and ordered[first][2] <= a:
            first += 1
        at = first
        while at < len(ordered) and ordered[at][1] < b:
            if ordered[at][2] > a:
                out[i] = LABELS.index(ordered[at][0])
                break
            at += 1
    return out


@dataclass
class Field:
    """The field's weights: unary (feature x label), chain and skip (label x label)."""

    unary: np.ndarray = field(default_factory=lambda: np.zeros((FEATURES, len(LABELS))))
    chain: np.ndarray = field(default_factory=lambda: np.zeros((len(LABELS), len(LABELS))))
    skip: np.ndarray = field(default_factory=lambda: np.zeros((len(LABELS), len(LABELS))))

    def marginals(self, text: str, spans: list[tuple[int, int]], seen: list[int]) -> np.ndarray:
        """Label probabilities of each token after loopy message passing."""
        chain, skip = edges_of(text, spans, seen)
        runs = number_runs(text, spans, chain)
        energy = np.array([self.unary[features(text, a, b)].sum(axis=0) for a, b in spans])
        energy[~np.array([possible(text[a:b], len(run)) for (a, b), run in zip(spans, runs, strict=True)])] = -30.0
        for i, label in enumerate(seen):
            if label:
                energy[i] = -60.0
                energy[i, label] = 0.0
        if chain or skip:
            pairs = np.array([*chain, *skip])
            table = np.concatenate([np.repeat(self.chain[None], len(chain), 0), np.repeat(self.skip[None], len(skip), 0)])
            source, target = np.r_[pairs[:, 0], pairs[:, 1]], np.r_[pairs[:, 1], pairs[:, 0]]
            table = np.concatenate([table, table.transpose(0, 2, 1)])
            back = np.r_[np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))]
            sent = np.zeros((len(source), len(LABELS)))
            for _ in range(ROUNDS):
                held = energy.copy()
                np.add.at(held, target, sent)
                new = (held[source] - sent[back])[:, :, None] + table
                top = new.max(axis=1)
                new = top + np.log(np.exp(new - top[:, None, :]).sum(axis=1))
                new -= new.max(axis=1, keepdims=True)
                moved = np.abs(new - sent).max()
                sent = DAMPING * sent + (1 - DAMPING) * new
                if moved < 1e-3:
                    break
            np.add.at(energy, target, sent)
        energy -= energy.max(axis=1, keepdims=True)
        p = np.exp(energy)
        return p / p.sum(axis=1, keepdims=True)

    def spans(self, text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """Base spans, and all spans: base ones and those that the field adds, by kind and start."""
        base = base_spans(text)
        tokens = candidates(text)
        order = lambda s: (KINDS.index(s[0]), s[1])
        base.sort(key=order)
        if not tokens:
            return base, base
        seen = observed(tokens, base)
        if all(seen):
            return base, base
        best = self.marginals(text, tokens, seen)
        merged: list[tuple[str, int, int]] = []
        for (a, b), known, label, p in zip(tokens, seen, best.argmax(axis=1).tolist(), best.max(axis=1).tolist(), strict=True):
            if known or not label or p < SURE:
                continue
            kind = LABELS[label]
            if kind == "phone" and merged and merged[-1][0] == kind and a - merged[-1][2] <= 2:
                merged[-1] = (kind, merged[-1][1], b)
            else:
                merged.append((kind, a, b))
        merged = [s for s in merged if s[0] != "phone" or 7 <= len(NOT_DIGIT.sub("", text[s[1] : s[2]])) <= 15]
        return base, sorted([*base, *merged], key=order)


#: A token in training: its own and its context's features, its label, its neighbours' labels on the left and right (-1: none), and how many skip
#: partners have each label.
EXAMPLE = {"own": pa.list_(pa.int32()), "context": pa.list_(pa.int32()), "label": pa.int32(), "left": pa.int32(), "right": pa.int32(), "skip": pa.list_(pa.int32())}
EXAMPLE_DDL = "own array<int>, context array<int>, label int, left int, right int, skip array<int>"


def sample_rows(text: str) -> list[tuple]:
    """A document's training rows (see EXAMPLE): all its tokens up to SAMPLE_TOKENS, of more of them so many on average, chosen by hash all over the text.
    Labels of partners are known whether or not these are chosen."""
    tokens = candidates(text)
    if not tokens:
        return []
    seen = observed(tokens, base_spans(text))
    chain, skip = edges_of(text, tokens, seen)
    left, right, far = {j: seen[i] for i, j in chain}, {i: seen[j] for i, j in chain}, {}
    for i, j in skip:
        far.setdefault(i, []).append(seen[j])
        far.setdefault(j, []).append(seen[i])
    rate, out = SAMPLE_TOKENS / len(tokens), []
    for i, (a, b) in enumerate(tokens):
        if rate >= 1 or zlib.crc32(f"{a} {text[a:b]}".encode()) < rate * (1 << 32):
            count = [far.get(i, []).count(k) for k in range(len(LABELS))]
            out.append((own_features(text[a:b]), context(text, a, b), seen[i], left.get(i, -1), right.get(i, -1), count))
    return out


def _tied() -> np.ndarray:
    """Which of four weights a pair of labels has as a skip: equal kinds, different kinds, a kind beside none, none beside none. What repeats is of one
    kind whichever kind that is."""
    kind = 1 - np.eye(len(LABELS), dtype=int)
    kind[0], kind[:, 0], kind[0, 0] = 2, 2, 3
    return kind


def fit(examples: list[tuple], epochs: int = 400, rate: float = 0.5, decay: float = 1e-4, skips: bool = True) -> Field:
    """All weights together from training rows, by AdaGrad on the pseudo-likelihood: each token's label given its own features (in a second copy
    of the row: given its context only), and its neighbours' labels. None: all zero. ``skips``: whether skip weights are learned (else they stay zero)."""
    if not examples:
        return Field()
    n, k = len(examples), len(LABELS)
    rows = [[*own, *around] for own, around, *_ in examples] + [list(around) for _, around, *_ in examples]
    width = max(map(len, rows))
    index = np.full((2 * n, width), FEATURES)
    for i, x in enumerate(rows):
        index[i, : len(x)] = x
    labels, left, right = (np.array([x[c] for x in examples], np.int64) for c in (2, 3, 4))
    one = np.tile(np.eye(k)[labels], (2, 1))
    # One-hot labels of the neighbours, zero where there is none; skip partners by their share, so a hub of many weighs like one of few.
    beside = [np.tile(np.where(side[:, None] >= 0, np.eye(k)[np.maximum(side, 0)], 0.0), (2, 1)) for side in (left, right)]
    far = np.array([x[5] for x in examples], float)
    far = np.tile(far / np.maximum(far.sum(axis=1, keepdims=True), 1), (2, 1)) * skips
    tied = _tied()
    unary, chain, skip = np.zeros((FEATURES + 1, k)), np.zeros((k, k)), np.zeros(4)
    past = [np.full(x.shape, 1e-6) for x in (unary, chain, skip)]
    for _ in range(epochs):
        unary[FEATURES] = 0
        score = unary[index].sum(axis=1) + beside[0] @ chain + beside[1] @ chain.T + far @ skip[tied]
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = (p - one) / len(one)
        slopes = (
            np.stack([np.bincount(index.ravel(), np.repeat(x, width), FEATURES + 1) for x in d.T], axis=1) + decay * unary,
            beside[0].T @ d + d.T @ beside[1] + decay * chain,
            np.bincount(tied.ravel(), (far.T @ d).ravel(), 4) + decay * skip,
        )
        for w, g, slope in zip((unary, chain, skip), past, slopes, strict=True):
            g += slope**2
            w -= rate * slope / np.sqrt(g)
    return Field(unary[:FEATURES], chain, skip[tied] if skips else np.zeros((k, k)))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """A field from about ``sample_docs`` documents, chosen by a hash of id and text, with about SAMPLE_TOKENS tokens each at most.

    Documents without an id are told apart by their texts, and rows that are repeated whole count once, so the sample is bounded whatever the ids are."""
    texts = texts_of(docs, id_col, text_col)
    n = max(1, docs.count())
    chosen = texts.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < F.lit(int(min(1.0, sample_docs / n) * (1 << 20)))).distinct()

    def run(batches):
        for _, block in rows(batches, "doc_id", "text"):
            out = [x for text in block for x in sample_rows(text)]
            yield arrow(EXAMPLE, zip(*out, strict=True) if out else [[]] * len(EXAMPLE))

    found = chosen.mapInArrow(run, EXAMPLE_DDL).toArrow()
    examples = sorted(zip(*(found.column(i).to_pylist() for i in range(len(EXAMPLE))), strict=True))  # in any order, the same sums
    return fit(examples)


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


FIELDS = {"doc_id": pa.int64(), **{f"n_{k}": pa.int64() for k in KINDS}, "base_sha256": pa.string(), "spans": pa.string()}


def find_personal_data(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, counts of base spans by kind, digest of the base spans, and all spans as ``kind:start:end`` joined by commas.

    Null and empty texts have no spans; repeated rows stay, each with the same result; an empty table gives an empty one; other columns
    are ignored. Spans of different kinds may overlap, as their patterns are matched separately."""

    def run(batches):
        for ids, texts in rows(batches, "doc_id", "text"):
            out = []
            for doc_id, text in zip(ids, texts, strict=True):
                base, every = model.spans(text)
                kinds = [s[0] for s in base]
                out.append((doc_id, *map(kinds.count, KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(every)))
            yield arrow(FIELDS, zip(*out, strict=True))

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; where spans overlap, the one that starts first names the whole."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_documents(docs: DataFrame, model: Field, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data masked in its text; other columns pass unchanged, null texts stay null.

    Repeated rows stay, each with the same result; where spans overlap, the one that starts first names the whole (see ``masked``); an empty table gives
    an empty one."""
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts = [t if t is None else masked(t, model.spans(t)[1]) for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else part.column(i) for i in range(len(names))], names)

    return docs.mapInArrow(run, docs.schema)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_personal_data(docs, train(docs))
