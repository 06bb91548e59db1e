import hashlib
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings, strategies as st

from graphloom.llm import pii


def plain_base(text):
    """The contract's patterns as they stand."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


PARTS = st.sampled_from(["a@b.co", "x.y@z-1.example.com", "@", "a@b@c.de", "a@b.cc@d.ee", "10.0.0.1", "1.2.3.4.5", "256.1.1.1", "1.2.3", "4111 1111 1111 1111", "4111111111111111", "4111-1111", "+1 (555) 123-4567", "+49 89 1234567", "+", "1", "9", " ", "-", ".", "é", "0001.02.3.4", "٣"])


@settings(max_examples=600, deadline=None)
@given(st.lists(PARTS, max_size=12).map("".join))
def test_base_spans_are_the_patterns_matches(text):
    assert sorted(pii.base_spans(text)) == sorted(plain_base(text))


def brute_marginals(energy, pairs, tables):
    """Exact marginals by summing over all labelings."""
    n, k = energy.shape
    total = np.zeros((n, k))
    for state in np.ndindex(*[k] * n):
        p = np.exp(sum(energy[i, s] for i, s in enumerate(state)) + sum(t[state[a], state[b]] for (a, b), t in zip(pairs, tables, strict=True)))
        for i, s in enumerate(state):
            total[i, s] += p
    return total / total.sum(axis=1, keepdims=True)


def test_message_passing_is_exact_on_trees():
    r = np.random.default_rng(3)
    model = pii.Field(r.normal(size=(pii.FEATURES, 5)) * 0.3, r.normal(size=(5, 5)), r.normal(size=(5, 5)))
    text = "555-123-4567 then 12 words (77) 8899123 and at the end 555-123-4567"
    tokens = pii.candidates(text)
    chain, skip = pii.edges_of(text, tokens)
    assert skip and len(chain) + len(skip) < len(tokens)
    energy = np.array([model.unary[pii.features(text, a, b)].sum(axis=0) for a, b in tokens])
    runs = pii.number_runs(text, tokens, chain)
    energy[~np.array([pii.possible(text[a:b], len(run)) for (a, b), run in zip(tokens, runs, strict=True)])] = -30.0
    exact = brute_marginals(energy, [*chain, *skip], [model.chain] * len(chain) + [model.skip] * len(skip))
    assert np.abs(model.marginals(text, tokens, [0] * len(tokens)) - exact).max() < 0.02


def trained():
    texts = [f"write to user{i}@mail.example.com or call +1 (555) {i:03d}-{i + 1000:04d} now, page {i} of 300. Again user{i}@mail.example.com" for i in range(100, 300)]
    return pii.fit(sorted(x for t in texts for x in pii.sample_rows(t)))


def test_a_label_reaches_other_mentions_and_base_spans_stay():
    model = trained()
    text = "Call +1 (555) 123-4567 today. Some words between. Reach the office at 555-123-4567 or never. Version 2.0, page 17."
    base, every = model.spans(text)
    assert [text[a:b] for _, a, b in base] == ["+1 (555) 123-4567"] and set(base) <= set(every)
    assert [text[a:b] for k, a, b in every if (k, a, b) not in base] == ["555-123-4567"]
    clean = "Version 2.0 of 1999 has 555 pages, 12:30 at section 4.1.2, order 555-123, row 7."
    assert model.spans(clean) == ([], [])


def test_matches_that_ran_together_come_apart():
    text = "Des +1 (826) 555-4081 190.137.223.204 du, 4111111111111111 4012888888881881 end 1421201075424982"
    base, every = trained().spans(text)
    assert [k for k, _, _ in base] == ["ip"]
    assert "+1 (826) 555-4081" in [text[a:b] for k, a, b in every if k == "phone"]
    assert not any(text[a:b] == "1421201075424982" for _, a, b in every)


def test_masking():
    text = "a@b.co, 10.0.0.1 +1 (555) 123-4567"
    assert pii.masked(text, pii.base_spans(text)) == "[EMAIL], [IP] [PHONE]"
    assert pii.masked("x 4111111111111111 y", [("card", 2, 18), ("phone", 4, 18)]) == "x [CARD] y"


def test_documents(spark, docs_edge):
    model = pii.train(docs_edge)
    got = {r.doc_id: r for r in pii.find_personal_data(docs_edge, model).collect()}
    for r in docs_edge.collect():
        base = sorted(plain_base(r.text or ""), key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        assert got[r.doc_id].base_sha256 == hashlib.sha256(pii.listed(base).encode()).hexdigest()
        assert set(filter(None, pii.listed(base).split(","))) <= set(got[r.doc_id].spans.split(","))
        assert got[r.doc_id].n_email == sum(s[0] == "email" for s in base)
    masked = {r.doc_id: r.text for r in pii.mask_documents(docs_edge, model).collect()}
    assert masked[0] is None and masked[1] == "" and masked[9] == "call [PHONE] or [EMAIL]"
    none = docs_edge.limit(0)
    assert pii.find_personal_data(none, pii.train(none)).count() == 0


@pytest.mark.parametrize("text", ["1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1 " * 70_000, "@" * 100_000, "555-123-4567 " * 5_000])
def test_long_texts(text):
    trained().spans(text)


def mentions():
    """Texts of the fixture with a number given in full and, far from it, in part; and a number of the same form that is given nowhere else."""
    r = random.Random(4)
    texts = [x or "" for x in pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()]
    for base in texts[500:600]:
        a, b = ("".join(r.choices("0123456789", k=10)) for _ in range(2))
        for form in ("{0}-{1}-{2}", "{0} {1} {2}", "{1}-{2}"):
            own, other = (form.format(x[:3], x[3:6], x[6:]) for x in (a, b))
            words = base.split()[:200]
            yield " ".join([*words[:50], "call", f"+1 ({a[:3]}) {a[3:6]}-{a[6:]}", "or", *words[50:], "again", own, "and", "ref", other, "end"]), own, other


def test_skips_find_mentions_that_chains_alone_do_not():
    texts = [x or "" for x in pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()]
    rows = sorted(x for t in texts[:500] for x in pii.sample_rows(t))
    found, wrong, n = {True: 0, False: 0}, {True: 0, False: 0}, 0
    models = {skips: pii.fit(rows, skips=skips) for skips in (True, False)}
    for text, own, other in mentions():
        at, far, n = text.rindex("again " + own) + 6, text.rindex("ref " + other) + 4, n + 1
        for skips, model in models.items():
            every = model.spans(text)[1]
            found[skips] += any(a <= at and b >= at + len(own) for _, a, b in every)
            wrong[skips] += any(a < far + len(other) and b > far for _, a, b in every)
    assert found[True] >= 0.9 * n and found[False] <= 0.4 * n and wrong[True] <= 0.01 * n, (found, wrong, n)


def test_a_label_reaches_every_mention_however_many():
    text = "Call +1 (555) 123-4567 today. " + "More 555-123-4567 words. " * 200
    base, every = trained().spans(text)
    assert len(base) == 1 and len(every) == 201


def test_grouped_numbers_share_their_runs_key():
    text = "01 42 68 53 00 here and 01 42 68 53 00 there"
    tokens = pii.candidates(text)
    chain, skip = pii.edges_of(text, tokens)
    assert (0, 1) in chain and {i for e in skip for i in e} == set(range(10)) - {1} and len(chain) == 8


def test_samples_are_bounded_whatever_the_ids_are(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pii, "fit", lambda rows, **_: seen.append(len(rows)) or pii.Field())
    n = 3000
    one = lambda i, text: spark.range(n).selectExpr(f"{i} doc_id", f"{text} text")
    pii.train(one("cast(null as long)", "concat('no. ', id, ' of 9')"), sample_docs=100)
    pii.train(one("7L", "'a@b.co 12 and 13'"), sample_docs=100)
    assert 50 < seen[0] < 400 and seen[1] <= 3
    assert len(pii.sample_rows("a1 " * 10_000)) < 120 and max(len(x[0]) for x in pii.sample_rows("x 1 " * 40)) > 0


def test_context_words_are_whole():
    word = "w" * 5000
    assert pii.context(f"{word}a 12 {word}b", 5002, 5004) != pii.context(f"{word}c 12 {word}b", 5002, 5004)
    assert pii.own_features("1" * 70 + "a") != pii.own_features("1" * 70 + "-")
