"""Each stage against a brute-force version of it, on all rows that its predecessor kept."""

import public_tokenizers
import tiktoken

import corpus_pipeline
from quillstack.llm import quality
from quillstack.llm.bpe import read_ranks
from quillstack.session import materialize, table
from tests.llm import test_op5, test_op6, test_op10

SF = "/root/testdata/sf0.01"


def rows(df):
    return sorted(map(tuple, df.select(*corpus_pipeline.COLUMNS).collect()))


def test_stages(spark):
    docs = table(spark, SF, "documents")
    kept = [materialize(corpus_pipeline.STAGES[0][1](spark, docs, SF))]
    scores = quality.op7_quality(spark, SF).where("predicted = 1").select("doc_id")
    assert rows(kept[0]) == rows(docs.join(scores, "doc_id", "left_semi"))
    labels = table(spark, SF, "labels")
    judged = kept[0].join(labels, "doc_id")
    assert judged.where("quality = 1").count() >= 0.99 * labels.where("quality = 1").count()
    assert judged.where("quality = 0").count() <= 0.15 * labels.where("quality = 0").count()

    kept.append(materialize(corpus_pipeline.STAGES[1][1](spark, kept[-1], SF)))
    before = {r[0]: r for r in rows(kept[0])}
    want = [(d, t, *before[d][2:4], len(t)) for d, _, gone, t in test_op6.brute([r[:2] for r in rows(kept[0])]) if not gone or t]
    assert rows(kept[1]) == sorted(want)

    kept.append(materialize(corpus_pipeline.STAGES[2][1](spark, kept[-1], SF)))
    stay = {d for d, _, c in test_op5.brute([r[:2] for r in rows(kept[1])], 5, 80, 100) if d == c}
    assert rows(kept[2]) == [r for r in rows(kept[1]) if r[0] in stay]

    kept.append(materialize(corpus_pipeline.STAGES[3][1](spark, kept[-1], SF)))
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    hit = {d for d, x in test_op10.brute([r[:2] for r in rows(kept[2])], items).items() if x[4]}
    assert hit and rows(kept[3]) == [r for r in rows(kept[2]) if r[0] not in hit]

    coded = {r.doc_id: r.token_ids for r in corpus_pipeline.STAGES[4][1](spark, kept[-1], SF).collect()}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert coded == {r[0]: " ".join(map(str, library.encode_ordinary(r[1]))) for r in rows(kept[3])}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == set(coded)


def test_stages_on_empty_tables_and_nulls(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
    odd = spark.createDataFrame([(10**7, None, None, None, None), (10**7 + 1, "", "en", "s", 0), (None, "no id at all here", None, None, 1)], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, SF)
        assert got.count() >= 1
