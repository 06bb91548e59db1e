"""Quality classifier: a linear hinge-loss model over n-gram indicators scaled by naive Bayes log-count ratios.

Features of a text are the set of its word unigrams, of character-class n-grams of its words (runs of letters, digits and
marks, with their case), and of word pairs' classes with a mark where a word repeats. Each indicator is scaled by the log of its ratio
between the classes, the model is fitted by dual coordinate descent, and its margin is turned into a probability by a
logistic curve. Only the text is an input.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.llm.common import arrow, rows, slices, table, texts_of

FEATURES = 1 << 18
#: Labelled documents that training reads at most, on average: they are chosen by a hash of their id.
SAMPLE_ROWS = 8_000
THRESHOLD = 0.7
RUN = re.compile(r"[^\W\d_]+|\d+|\s+|[\W_]")


def shape(word: str) -> str:
    """A whole word's character classes: A for capitals, a for small letters, Aa for both, 9 for digits, marks as they are."""
    out = []
    for part in RUN.findall(word):
        if part[0].isalpha():
            out.append("Aa" if part[:1].isupper() and len(part) > 1 and part[1:].islower() else "A" if part.isupper() else "a" if part.islower() else "aA")
        else:
            out.append("9" if part[0].isdigit() else part[:1])
    return "".join(out)


def _id(name: str) -> int:
    return zlib.crc32(name.encode()) % FEATURES


class Words(dict):
    """Feature id and shape by word, and feature ids by shape. At ``limit`` words the table becomes the earlier generation, from which words
    met again move over; shapes are few, and begin anew at the same limit. Words and shapes of more than ``LONG`` characters count as a whole like any
    others, but are not remembered."""

    limit, LONG = 30_000, 64

    def __init__(self):
        super().__init__()
        self.earlier: dict = {}
        self.shapes: dict[str, list[int]] = {}

    def __missing__(self, word: str) -> tuple[int, str]:
        found = self.earlier.get(word) or (_id("w" + word.lower()), shape(word))
        if len(word) <= self.LONG:
            if len(self) >= self.limit:
                self.earlier = dict(self)
                self.clear()
            self[word] = found
        return found

    def of_shape(self, form: str) -> list[int]:
        ids = self.shapes.get(form)
        if ids is None:
            grams = {form[i : i + n] for n in (1, 2, 3, 4) for i in range(len(form) - n + 1)}
            ids = sorted({_id("f" + form), *(_id(f"s{g}") for g in grams)})
            if len(form) <= self.LONG:
                if len(self.shapes) >= self.limit:
                    self.shapes.clear()
                self.shapes[form] = ids
        return ids


def words() -> Words:
    return table(("quality",), Words)


def indicators(text: str) -> np.ndarray:
    """Ids of the features that a text has, sorted; the empty text has none but that of its length."""
    parts = text.split()
    known = words()
    found = {word: known[word] for word in set(parts)}
    ids = {own for own, _ in found.values()}
    for form in {form for _, form in found.values()}:
        ids.update(known.of_shape(form))
    if len(parts) > 1:
        repeats = sum(map(str.__eq__, parts, parts[1:]))
        share = repeats / len(parts)
        level = 0 if not repeats else 1 + int(np.clip(np.log2(share * 256), 0, 8))
        ids.update(_id(f"repeat {k}") for k in range(level + 1))
        distinct = len(found) / len(parts)
        ids.add(_id(f"distinct {int(distinct * 10)} {min(len(parts).bit_length(), 10)}"))
        forms = [found[w][1] for w in parts]
        ids.update(_id(f"p{a} {b}") for a, b in set(zip(forms, forms[1:])))  # noqa: B905
        counts = Counter(forms)
        ids.update(_id(f"share {form} {int(np.log2(n / len(parts) * 64))}") for form, n in counts.items() if n * 64 >= len(parts))
    ids.add(_id(f"length {min(len(parts).bit_length(), 16)}"))
    return np.fromiter(sorted(ids), np.int32, len(ids))


@dataclass
class Model:
    """Weights by feature, bias, and the slope and shift of the logistic curve over margins."""

    weights: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, ids: np.ndarray) -> float:
        return float(self.weights[ids].sum() + self.bias)

    def score(self, text: str) -> float:
        z = self.slope * self.margin(indicators(text)) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def neutral() -> Model:
    """Without labels of both classes nothing is known: every text scores one half."""
    return Model(np.zeros(FEATURES, np.float32), 0.0, 0.0, 0.0)


def ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Log of each indicator's smoothed share among positives over that among negatives."""
    logs = []
    for sign in (1, -1):
        chosen = [x for x, label in zip(rows, y, strict=True) if label == sign]
        counts = np.bincount(np.concatenate(chosen), minlength=FEATURES) + smooth
        logs.append(np.log(counts / counts.sum()))
    return logs[0] - logs[1]


def fit_margins(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float = 0.1, epochs: int = 12, mix: float = 0.25, seed: int = 5) -> tuple[np.ndarray, float]:
    """Hinge loss with L2 penalty by dual coordinate descent over documents, classes weighted to equal shares; weights are mixed
    with their mean size, which keeps the naive Bayes direction. Returns weights on unscaled indicators, and the bias."""
    w, bias = np.zeros(FEATURES), 0.0
    # One array for all rows, and views of it: thousands of small ones would stay with the driver's allocator.
    ends = np.cumsum([len(x) for x in rows])
    flat = scale[np.concatenate(rows)]
    values = np.split(flat, ends[:-1])
    norms = np.array([v @ v + 1.0 for v in values])
    share = {s: len(y) / (2 * max(1, (y == s).sum())) for s in (1, -1)}
    bound = np.array([cost * share[s] for s in y])
    alpha = np.zeros(len(y))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in order.permutation(len(y)):
            x, v = rows[i], values[i]
            gradient = y[i] * (w[x] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), bound[i])
            if step := new - alpha[i]:
                alpha[i] = new
                w[x] += step * y[i] * v
                bias += step * y[i]
                most = max(most, abs(step) * norms[i])
        if most < 1e-3:
            break
    used = w != 0
    flat = np.abs(w[used]).mean() if used.any() else 0.0
    return ((1 - mix) * w + mix * flat * used) * scale, bias


def calibrate(margins: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton's method, with targets drawn a little inwards."""
    n1, n0 = (y == 1).sum(), (y == -1).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -40, 40)))
        d, h = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(d * margins).sum(), d.sum()])
        m = np.array([[(h * margins**2).sum() + 1e-6, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(m, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return max(float(a), 0.0), float(b)


def fit(rows: list[np.ndarray], quality: np.ndarray, folds: int = 3) -> Model:
    """A model from indicators and 0/1 labels. Margins for the curve come from folds that did not train on them."""
    y = np.where(np.asarray(quality) == 1, 1, -1)
    if len(set(y.tolist())) < 2:
        return neutral()
    margins, fold = np.zeros(len(y)), np.arange(len(y)) % folds
    known = np.zeros(len(y), bool)
    for k in range(folds):
        inside = np.flatnonzero(fold != k)
        if len(set(y[inside].tolist())) < 2:
            continue
        own = [rows[i] for i in inside]
        w, bias = fit_margins(own, y[inside], ratios(own, y[inside]))
        for i in np.flatnonzero(fold == k):
            margins[i], known[i] = w[rows[i]].sum() + bias, True
    w, bias = fit_margins(rows, y, ratios(rows, y))
    slope, shift = calibrate(margins[known], y[known]) if len(set(y[known].tolist())) == 2 else (1.0, 0.0)
    return Model(w.astype(np.float32), float(bias), slope, shift)


def fold_of(id_col: str = "doc_id"):
    """Which quarter a document is in; quarter 2 is held out of training."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model from about ``sample_rows`` labelled documents that are not held out, fewer if there are fewer.

    Null labels and labels without an id are skipped; an id with different labels has the lowest of them; of several documents with one id the one whose text
    has the smallest hash is read. Only ids of the sample (bounded by ``sample_rows``) are broadcast, and only indicators come back, one row an id."""
    known = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label")).where("label is not null and doc_id is not null").where(fold_of() != 2)
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    n = max(1, known.count())
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(min(1.0, sample_rows / n) * (1 << 20))))
    joined = texts_of(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")
    joined = joined.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def run(batches):
        for ids, given, texts in rows(batches, "doc_id", "label", "text"):
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "label": pa.array(given, pa.int32()), "ids": pa.array([indicators(t) for t in texts], pa.list_(pa.int32()))})

    found = joined.mapInArrow(run, "doc_id long, label int, ids array<int>").toArrow().sort_by("doc_id").combine_chunks()
    if not found.num_rows:
        return neutral()
    ids = found.column("ids").combine_chunks()
    ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
    vectors = np.split(ids.flatten().to_numpy(), ids.offsets.to_numpy()[1:-1] - ids.offsets[0].as_py())
    return fit(vectors, found.column("label").to_numpy())


FIELDS = {"doc_id": pa.int64(), "score": pa.float64()}


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text.

    Null texts count as empty and get the score of a text without features; repeated rows stay; an empty table gives an
    empty one; other columns (labels, language, source) are never read."""
    lent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for ids, texts in rows(batches, "doc_id", "text"):
            yield arrow(FIELDS, (ids, [lent.value.score(t) for t in texts]))

    scored = texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold_of() == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, all columns as they were.

    Null texts count as empty; equal texts, repeated rows among them, stay or go together; a score at the threshold stays; an empty table gives
    an empty one; ids are not looked at."""
    lent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array([lent.value.score(t or "") >= threshold for t in part.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_documents(docs, train(docs, labels))
