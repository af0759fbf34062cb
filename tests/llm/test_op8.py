import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillstack.llm import brown
from quillstack.llm.brown import exchange, fit, op8_lm_scores, score_texts
from quillstack.llm.textcore import SPACED, Words, text_buffers

SF = "/root/testdata/sf0.01"


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None]


def base(rows, train):
    c = Counter(w for d, t in rows if train(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    for d, t in rows:
        w = tokens(t)
        yield d, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)


def test_all_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    got = {r.doc_id: r for r in op8_lm_scores(spark, SF).collect()}
    mine = theirs = 0
    for d, size, known, n, score in base(rows, lambda d: not held(d)):
        r = got.pop(d)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(d), size, known, n)
        assert abs(r.base_score - score) < 1e-6 * size
        if held(d):
            mine, theirs = mine + r.score, theirs + score
    assert not got and mine > theirs * 0.97


def test_rare_words_meet_their_counts(spark):
    rows = [(1, "a b a c"), (2, None), (3, ""), (4, "A B zz é"), (4, "A B zz é"), (None, "q " * 9000)]
    d = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    train = d.where("doc_id = 1 or doc_id is null").select("text")
    scores = []
    for head in (0, 2, 1 << 17):
        model, counts = fit(train, head)
        got = sorted(score_texts(d, model, counts).collect(), key=lambda r: (str(r.doc_id), r.text or ""))
        want = sorted(base(rows, lambda x: x in (1, None)), key=lambda x: (str(x[0]), x[1]))
        assert [(r.doc_id, r.n_tokens, r.n_known) for r in got] == [x[:3] for x in want]
        assert np.allclose([r.base_score for r in got], [x[4] for x in want])
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)
        scores.append(got)
    model, counts = fit(train.limit(0))
    assert score_texts(d.limit(0), model, counts).collect() == []
    assert {r.n_known for r in score_texts(d, model, counts).collect()} == {0}


def test_exchange_finds_classes():
    r = np.random.default_rng(1)
    own = r.integers(0, 4, 60)
    rate = np.array([[1, 9, 1, 1], [1, 1, 9, 1], [1, 1, 1, 9], [9, 1, 1, 1]])
    moves = np.zeros((61, 61))
    moves[1:, 1:] = r.poisson(rate[own][:, own] * 3.0)
    found = exchange(moves, 5)
    assert found[0] == 0
    assert len(set(zip(own.tolist(), found[1:].tolist(), strict=True))) == 4


def test_the_product_is_a_probability(spark):
    d = spark.createDataFrame([("a b a c a b",), ("b a",)], "text string")
    model, counts = fit(d)
    assert np.allclose((10**model.move).sum(1), 1)
    words = {r.word: r.n for r in counts.collect()}
    v = model.vocabulary
    for c in range(brown.CLASSES):
        mine = model.own[v.kind] == c
        total = ((v.n[mine] + brown.EMIT).sum() + brown.EMIT) / 10 ** model.under[c]
        assert abs(total - 1) < 1e-9
    assert sum(words.values()) == 10


def test_words_outside_the_head_have_classes_of_their_own_counts(spark, monkeypatch):
    """Nouns and verbs with one ending: a few are clustered, the others follow their neighbours, with any head."""
    monkeypatch.setattr(brown, "sizes", lambda distinct: (13, 4))
    r = random.Random(3)
    nouns, verbs = ([f"{k}{i}xyz" for i in range(40)] for k in "nv")
    weights = [60 - i for i in range(40)]
    texts = [" ".join(w for _ in range(6) for w in (r.choices(nouns, weights)[0], r.choices(verbs, weights)[0])) for _ in range(600)]
    d = spark.createDataFrame([(t,) for t in [*texts, "n39xyz v39xyz n39xyz v39xyz", "new1 new2 n0xyz"]], "text string")
    seen = []
    for head in (20, 1 << 17):
        model, counts = fit(d, head)
        words = {x.word: x["class"] for x in counts.collect()}
        assert len(model.vocabulary.word) <= head + 1 and len(words) == 83
        hashes = {t: int(Words(*text_buffers(pa.array([t])), SPACED).hash.view(np.int64)[0]) for t in (*nouns, *verbs)}
        n, v = ({words[hashes[t]] for t in x} for x in (nouns, verbs))
        assert not n & v  # endings alone gave both kinds one class
        got = sorted((x.text, x.score, x.base_score) for x in score_texts(d, model, counts).collect())
        seen.append((words, got, model.move, model.under))
    assert seen[0][0] == seen[1][0]
    assert np.allclose(seen[0][2], seen[1][2]) and np.allclose(seen[0][3], seen[1][3])
    assert all(a[0] == b[0] and np.allclose(a[1:], b[1:]) for a, b in zip(seen[0][1], seen[1][1], strict=True))

    # Transitions and scores by brute force from the classes.
    of = lambda t: [words[int(h)] for h in Words(*text_buffers(pa.array([t])), SPACED).hash.view(np.int64)]
    lines = [[0, *of(x.text), 0] for x in d.collect()]
    table = np.zeros((4, 4))
    for line in lines:
        for a, b in zip(line, line[1:], strict=False):
            table[a, b] += 1
    assert np.allclose(model.move, np.log10((table + brown.MOVE) / (table + brown.MOVE).sum(1, keepdims=True)))
    count = Counter(w for x in d.collect() for w in tokens(x.text))
    for t, score, _ in got:
        c = [0, *of(t), 0]
        want = sum(model.move[a, b] for a, b in zip(c, c[1:], strict=False)) + sum(math.log10(count[w] + brown.EMIT) - model.under[k] for w, k in zip(tokens(t), c[1:], strict=True))
        assert abs(score - want) < 1e-6


def test_types_and_classes_grow_and_sweeps_end_where_none_moves():
    few, many = brown.sizes(1000), brown.sizes(50_000_000)
    assert few == (brown.TOP, brown.CLASSES) and many[0] > 4 * few[0] and many[1] > 2 * few[1]
    r = np.random.default_rng(5)
    moves = r.poisson(r.gamma(0.3, 4, (150, 150)))
    own = exchange(moves, 6)

    def likelihood(own):
        of = np.eye(6)[own]
        n = of.T @ moves @ of
        f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return f(n) - f(n.sum(0)) - f(n.sum(1))

    best = likelihood(own)
    for w in range(1, 150):
        for c in range(1, 6):
            other = own.copy()
            other[w] = c
            assert likelihood(other) <= best + 1e-6


def test_any_number_of_types_up_to_the_whole_vocabulary(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), brown.remainder("doc_id", 7).alias("k"))
    train, held = docs.where("k <> 2").select("text"), docs.where("k = 2")
    seen = {}
    for types, classes in ((50, 8), (500, 24), (10**9, 24)):
        model, counts = fit(train, types=types, classes=classes)
        clustered = int((model.own >= 0).sum())
        assert len(model.under) == classes and clustered == len(model.vocabulary.word)
        r = score_texts(held, model, counts, keep=["doc_id"]).agg(F.sum("score"), F.sum("n_tokens")).first()
        seen[types] = 10 ** (-r[0] / r[1])
    assert seen[10**9] < min(seen[50], seen[500])
