"""Terms of texts counted in Arrow batches, and BM25 scores of the counts: what ``rank.bm25`` hands to the tasks."""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from graphloom.functions.text import CAMEL, STOPWORDS

#: Pairs of a document's term and a query that are added up together, and cells of a table of documents by queries.
PAIRS = 1 << 20
#: Words whose terms a task remembers, at most, and bytes of such a word.
KNOWN, KNOWN_BYTES = 200_000, 64

_CAMEL = re.compile(CAMEL.encode())
_STOPWORDS = {w.encode() for w in STOPWORDS}
# All bytes of a character beyond ASCII divide words, as the character does.
_KEPT = bytes(c if c < 128 and chr(c).isalnum() else 32 for c in range(256))
_FOLDED = _KEPT.lower()


def _code_terms(word: bytes) -> list[bytes]:
    parts = _CAMEL.findall(word)
    return [t for t in (p.lower() for p in ([word, *parts] if len(parts) > 1 else parts)) if len(t) > 1 and t not in _STOPWORDS]


def _plain_terms(word: bytes) -> list[bytes]:
    return [word]


@dataclass(frozen=True)
class Terms:
    """How a text becomes terms: its alphanumeric words, in lower case beforehand if ``fold``, and the terms of each."""

    fold: bool
    of_word: Callable[[bytes], list[bytes]]

    def words(self, text: bytes | None) -> list[bytes]:
        if not text:
            return []
        if self.fold:  # the two characters beyond ASCII whose lower case is a letter of ASCII
            text = text.replace(b"\xc4\xb0", b"i").replace(b"\xe2\x84\xaa", b"k")
        return text.translate(_FOLDED if self.fold else _KEPT).split()

    def counted(self, text: bytes | None) -> Counter:
        """Term: its number."""
        out: Counter = Counter()
        for word, n in Counter(self.words(text)).items():
            for term in self.of_word(word):
                out[term] += n
        return out


#: The terms that ``functions.text.tokens`` gives, and plain words in lower case.
CODE_TERMS, PLAIN_TERMS = Terms(False, _code_terms), Terms(True, _plain_terms)


def query_terms(terms: Terms) -> Callable:
    """Batches of ``query_id, text`` to ``query_id, term, qtf``."""

    def run(batches):
        for batch in batches:
            counts = [terms.counted(t) for t in batch.column(1).to_pylist()]
            which = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
            found = [(t.decode(), n) for c in counts for t, n in c.items()]
            columns = [batch.column(0).take(pa.array(which)), pa.array([t for t, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "term", "qtf"])

    return run


class _Known(dict):
    """A word's number of terms and the places of those that are wanted."""

    def __init__(self, terms: Terms, places: dict[bytes, int]):
        self.terms, self.places = terms, places

    def __missing__(self, word: bytes) -> tuple[int, list[int]]:
        all_terms = self.terms.of_word(word)
        out = len(all_terms), [self.places[t] for t in all_terms if t in self.places]
        if len(self) < KNOWN and len(word) <= KNOWN_BYTES:
            self[word] = out
        return out


def document_terms(terms: Terms, places) -> Callable:
    """Batches of ``doc_id, text`` to ``doc_id, dl, terms, tfs``: the number of all terms, and places and numbers of those in ``places``, which is
    lent to the tasks."""

    def run(batches):
        known = _Known(terms, places.value)
        for batch in batches:
            lengths, offsets, flat, times = array("q"), array("i", [0]), array("i"), array("i")
            for text in batch.column(1):
                length, found = 0, {}
                for word, n in Counter(terms.words(text.as_py())).items():
                    own, at = known[word]
                    length += own * n
                    for place in at:
                        found[place] = found.get(place, 0) + n
                order = sorted(found)
                flat.extend(order)
                times.extend([found[p] for p in order])
                lengths.append(length)
                offsets.append(len(flat))
            starts = pa.array(np.frombuffer(offsets, np.int32))
            lists = [pa.ListArray.from_arrays(starts, pa.array(np.frombuffer(x, np.int32) if x else np.empty(0, np.int32))) for x in (flat, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(lengths, np.int64) if lengths else np.empty(0, np.int64)), *lists], ["doc_id", "dl", "terms", "tfs"])

    return run


@dataclass
class Weights:
    """What a block of queries weighs: ``query[starts[t]:starts[t + 1]]`` are those that have term ``t``, ``weight`` the products of its frequency in
    the query and its inverse document frequency."""

    ids: pa.Array
    starts: np.ndarray
    query: np.ndarray
    weight: np.ndarray
    avgdl: float
    k1: float
    b: float

    @classmethod
    def of(cls, ids: pa.Array, term: np.ndarray, query: np.ndarray, qtf: np.ndarray, df: np.ndarray, n_docs: int, avgdl: float, k1: float, b: float) -> Weights:
        order = np.lexsort((query, term))
        idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
        starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(df)))])
        return cls(ids, starts, query[order], (idf[term] * qtf)[order], avgdl, k1, b)

    def scores(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        """Tables of documents by queries, each with the row of the batch that its first document is in. ``batch``: ``doc_id, terms, tfs, dls``, the terms of a
        document in order, so equal documents have equal scores."""
        terms, tfs, dls = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2, 3))
        offsets = batch.column(1).offsets.to_numpy()
        offsets = offsets - offsets[0]
        part = tfs * (self.k1 + 1) / (tfs + self.k1 * (1 - self.b + self.b * dls / self.avgdl))
        first, width = self.starts[terms], self.starts[terms + 1] - self.starts[terms]
        pairs = np.concatenate([[0], np.cumsum(width)])
        per_doc, n = pairs[offsets], len(self.ids)
        i = 0
        while i < batch.num_rows:
            j = min(max(i + 1, int(np.searchsorted(per_doc, per_doc[i] + PAIRS, "right")) - 1), i + max(1, PAIRS // n), batch.num_rows)
            own = slice(offsets[i], offsets[j])
            wide = width[own]
            at = np.arange(per_doc[j] - per_doc[i]) + np.repeat(first[own] - (pairs[:-1][own] - per_doc[i]), wide)
            row = np.repeat(np.repeat(np.arange(j - i), np.diff(offsets[i : j + 1])), wide)
            yield i, np.bincount(row * n + self.query[at], self.weight[at] * np.repeat(part[own], wide), (j - i) * n).reshape(j - i, n)
            i = j


@dataclass
class Best:
    """The ``k`` best documents of each query so far, ties by ``doc_id``, nulls last."""

    k: int
    floor: np.ndarray  # what a document must reach
    kept: list[pa.Table] = field(default_factory=list)

    def add(self, ids: pa.Array, scores: np.ndarray, shares: np.ndarray) -> None:
        """``scores`` of documents by queries; ``shares``: whether the two share a term."""
        if len(scores) >= self.k:
            self.floor = np.maximum(self.floor, np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k])
        doc, query = np.nonzero(shares & (scores >= self.floor))
        if not len(doc):
            return
        more = pa.table({"query": query, "score": scores[doc, query], "doc_id": ids.take(pa.array(doc))})
        table = pa.concat_tables([*self.kept, more]).sort_by([("query", "ascending"), ("score", "descending"), ("doc_id", "ascending")])
        query = table.column("query").to_numpy()
        table = table.filter(pa.array(np.arange(len(query)) - np.searchsorted(query, query) < self.k)).combine_chunks()
        query, score = table.column("query").to_numpy(), table.column("score").to_numpy()
        last = np.flatnonzero(np.arange(len(query)) - np.searchsorted(query, query) == self.k - 1)
        self.floor[query[last]] = np.maximum(self.floor[query[last]], score[last])
        self.kept = [table]


def scored(weights, k: int | None = None, digits: int | None = None) -> Callable:
    """Batches of ``doc_id, terms, tfs, dls`` to ``query_id, doc_id, score``: all documents that share a term with a query, or a task's ``k`` best of each query.
    ``weights`` are lent to the tasks; scores are rounded to ``digits`` beforehand."""

    def run(batches):
        w = weights.value
        best = Best(k, np.full(len(w.ids), -np.inf)) if k else None
        rows = lambda query, doc_id, score: pa.RecordBatch.from_arrays([w.ids.take(query), doc_id, score], ["query_id", "doc_id", "score"])
        for batch in batches:
            for at, table in w.scores(batch) if len(w.ids) else ():
                shares, ids = table > 0, batch.column(0).slice(at, len(table))
                if digits is not None:
                    table = np.floor(table * 10.0**digits + 0.5) / 10.0**digits
                if best:
                    best.add(ids, table, shares)
                else:
                    doc, query = np.nonzero(shares)
                    yield rows(pa.array(query), ids.take(pa.array(doc)), pa.array(table[doc, query]))
        for table in best.kept if best else ():
            for part in table.to_batches():
                yield rows(part.column("query"), part.column("doc_id"), part.column("score"))

    return run
