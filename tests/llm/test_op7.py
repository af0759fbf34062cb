import numpy as np
import pyarrow as pa

from quillstack.llm.quality import NEIGHBOURS, TERMS, WORD_TERMS, _terms, fit, op7_quality, score_quality, training_rows
from quillstack.llm.textcore import SPACED, Words, text_buffers

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    got = op7_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert len(good) > 500 and len(bad) > 80
    area = (good[:, None] > bad[None]).mean() + 0.5 * (good[:, None] == bad[None]).mean()
    right = ((got.predicted == 1) == (got.quality == 1)).mean()
    print(area, right, (good >= 0.3).mean(), (bad < 0.3).mean())
    assert area > 0.95 and right > 0.95


def test_edges(spark):
    good = [(i, f"plain prose number {i} about words. And another sentence.", 1) for i in range(40)]
    bad = [(100 + i, f"BUY!!! NOW!!! {i}*** $$$ %%%", 0) for i in range(40)]
    rows = spark.createDataFrame([*good, *bad, (7, "again", None), (8, None, 1), (9, "odd", 5)], "key long, text string, label int")
    space = fit(rows)
    texts = [None, "", " \n", "plain prose about other words. And more.", "SELL!!! *** $$$", "SELL!!! *** $$$", "word " * 200_000, "日本語"]
    d = spark.createDataFrame([(i, t, 5.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    got = {r.doc_id: r.score for r in score_quality(d, space).collect()}
    assert got[0] == got[1] == got[2] and abs(got[0] - space.prior) < 1e-9
    assert got[3] > 0.7 and got[4] == got[5] < 0.3 and all(0 <= x <= 1 for x in got.values())
    assert score_quality(d.limit(0), space).collect() == []
    none = fit(rows.limit(0))
    assert {r.score for r in score_quality(d, none).collect()} == {0.5}
    assert len(fit(rows, sample=10).labels) <= 11


def test_votes_against_brute_force(spark):
    """Each document by itself against every labelled vector, in double precision and by a whole sort."""
    small = "/root/testdata/sf0.01"
    space = fit(training_rows(spark, small))
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    vectors, unlike = space.vectors.astype(float), 0
    got = {r.doc_id: r for r in op7_quality(spark, small).collect()}
    assert set(got) == set(docs)
    for d, text in docs.items():
        owner, term = _terms(Words(*text_buffers(pa.array([text])), SPACED))
        x = np.log1p(np.bincount(term, minlength=TERMS)) * space.weight
        x = np.concatenate([h / max(np.linalg.norm(h), 1e-9) for h in (x[:WORD_TERMS], x[WORD_TERMS:])]) @ space.project
        near = vectors @ (x / max(np.linalg.norm(x), 1e-9))
        best = sorted(range(len(near)), key=lambda i: -near[i])
        vote = [max(near[i], 0) ** 4 for i in best[:NEIGHBOURS]]
        want = (sum(v * space.labels[i] for v, i in zip(vote, best, strict=False)) + 1e-6 * space.prior) / (sum(vote) + 1e-6)
        tied = near[best[NEIGHBOURS - 1]] - near[best[NEIGHBOURS]] < 1e-5
        unlike += abs(want - got[d].score) > 1e-4 and not tied
        assert tied or abs(want - got[d].score) < 1e-3 and got[d].predicted == int(got[d].score >= 0.3)
    assert unlike <= 2


def test_neighbours_are_exact(spark):
    r = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, " ".join(f"w{x}" for x in r.integers(0, 50, 20)), int(r.integers(0, 2))) for i in range(200)], "key long, text string, label int")
    space = fit(rows)
    near = space.vectors @ space.vectors.T
    assert np.allclose(np.diag(near), 1, atol=1e-3) and near.max() < 1.001
