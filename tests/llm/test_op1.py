import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from quillstack.llm.bpe import code_words, digest, encode_documents, op1_byte_bpe, read_ranks

SF = "/root/testdata/sf0.01"
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def want(library, doc, text):
    ids = library.encode_ordinary(text or "")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return doc, len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())


def test_all_documents_against_the_library(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert sorted(map(tuple, op1_byte_bpe(spark, SF).collect())) == sorted(want(library, r.doc_id, r.text) for r in docs)


@pytest.mark.parametrize("ahead", [1 << 18, 3, 0])
def test_edges(spark, library, ahead):
    r = random.Random(5)
    texts = [None, "", " ", "\n\n \t x 　 y", "it's we'LL 'S", "日本語のテキスト🙂🙂 é", "<|endoftext|> <|", "a" * 3000, " " * 5000 + "b", "x y " * 40_000]
    texts += ["".join(r.choice("etaoin shrdlu'ßé\n12🙂") for _ in range(r.randrange(400))) for _ in range(60)] + ["same text"] * 5
    texts += ["".join(r.choice("etaoinshrdlu") for _ in range(700))]
    rows = [(i, t, [i], "k") for i, t in enumerate(texts)] + [(3, "repeated id", [1], None), (None, "no id", None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, token_ids array<int>, `a.b` string")
    got = encode_documents(d, PATH, PATTERN, ahead_words=ahead, as_text=True)
    assert sorted(got.columns) == ["a.b", "decoded", "doc_id", "n_tokens", "text", "token_ids"]
    listed = encode_documents(d, PATH, PATTERN, ahead_words=ahead).select("text", "token_ids", "n_tokens").collect()
    assert all(list(r.token_ids) == library.encode_ordinary(r.text or "") and r.n_tokens == len(r.token_ids) for r in listed)
    assert sorted(map(tuple, digest(got).collect()), key=str) == sorted((want(library, i, t) for i, t, *_ in rows), key=str)
    assert encode_documents(d.limit(0), PATH, PATTERN, ahead_words=ahead).collect() == []


def test_long_words_and_names_in_other_case(spark, library):
    r = random.Random(8)
    pick = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    texts = [pick("etaoinshrdlu", 120_000), "x" + "ab" * 60_000, pick("กขคงจฉชซาิีเแโ", 40_000), "=" * 100_001 + pick("=-_", 3000), pick("aA", 999) + " one " + pick("the and of", 9000)]
    texts += [pick(r.choice(["etaoin", "abc", "é日本ü", "zqxj", "theringationsed"]), r.randrange(250, 1300)) for _ in range(150)]
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, N_TOKENS int")
    got = {r.doc_id: list(r.token_ids) for r in encode_documents(d, PATH, PATTERN).select("doc_id", "n_tokens", "token_ids").collect()}
    assert got == {i: library.encode_ordinary(t) for i, t in enumerate(texts)}


def test_every_token_of_the_vocabulary(spark, library):
    ranks = read_ranks(PATH)
    d = spark.createDataFrame([(r, list(t)) for t, r in ranks.items()], "rank int, word array<int>")
    coded = code_words(d.select("rank", "word", F.array("word").alias("c")), "c", PATH).withColumn("c", F.element_at("c", 1))
    assert coded.where("size(c.ids) <> 1 or c.ids[0] <> rank").collect() == []
    assert all(bytes(r.word) == bytes(r.c.bytes) for r in coded.where("rank < 5000").collect())
