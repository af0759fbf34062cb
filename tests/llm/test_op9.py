import hashlib
import random
import re
import time

from quillstack.llm.secrets import LEDGER, RULES, Rule, op9_secrets, scan

SF = "/root/testdata/sf0.01"
KINDS = ("assign", "access", "hex")


def base(t):
    out = []
    for m in re.finditer(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 8:
            out.append(("assign", *m.span()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", t):
        if m.end() - m.start() >= 16:
            out.append(("access", *m.span()))
    for m in re.finditer(r"[0-9a-f]+", t):
        if m.end() - m.start() >= 32:
            out.append(("hex", *m.span()))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def test_all_documents_against_brute_force(spark):
    got = {r.doc_id: r for r in op9_secrets(spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        want, r = base(d.text or ""), got.pop(d.doc_id)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x[0] for x in want) for k in KINDS)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and [x for x in r.spans.split(",") if x.split(":")[0] in KINDS] == [x for x in text.split(",") if x]
    assert not got


def test_edges(spark):
    r = random.Random(3)
    parts = ["Token", "ſecret=abcdefgh", "PASSWORD", ' : "', "= ", "'", "api_key", "apikey", "=", ":", " ", "abcdefgh12", "short", "é🙂", "AKIA", "ABCDEFGH1234", "deadbeef" * 4, "0", "x", "\n", "secret:pass: hunter2222"]
    texts = [None, "", "token: 'secret: abcdefghij'", "token=secret=abcdefgh", "🙂" * 20 + "token=12345678", "ab" * 100_000, "token=abcdefgh1 " * 3000]
    texts += ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(600)]
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(3, "twice", "y"), (None, "no id", None)], "doc_id long, text string, findings string")
    found, new = scan(d, "doc_id", "text")
    rows = found.collect()
    assert len(rows) == len(texts) + 2 and new.count() == len({t or "" for t in texts} | {"twice", "no id"})
    for row in rows:
        if row.path is not None and row.path != 3:
            assert [tuple(f) for f in row.findings if f.kind in KINDS] == base(texts[row.path] or "")
    found, new = scan(d.limit(0), "doc_id", "text")
    assert found.collect() == [] and new.collect() == []


def test_only_unseen_pairs_are_scanned(spark):
    v1 = spark.createDataFrame([("a.txt", "token=abcdefgh1"), ("b.txt", "plain"), ("c.txt", "token=abcdefgh1")], "path string, text string")
    found, ledger = scan(v1, "path", "text")
    assert ledger.count() == 2
    v2 = v1.unionByName(spark.createDataFrame([("d.txt", "token=abcdefgh1"), ("a.txt", "token=zzzzzzzzz")], "path string, text string"))
    found, new = scan(v2, "path", "text", ledger)
    assert new.count() == 1 and new.first().rules == [r.name for r in RULES]
    assert sorted((r.path, len(r.findings)) for r in found.collect()) == [("a.txt", 1), ("a.txt", 1), ("b.txt", 0), ("c.txt", 1), ("d.txt", 1)]
    more = (*RULES, Rule("plain", "pl[a-z]+", 0, 1))
    found, newer = scan(v2, "path", "text", ledger.unionByName(new), more)
    assert sorted(map(tuple, (r.rules for r in newer.collect()))) == [("plain:1",)] * 3
    assert {r.path: [f.kind for f in r.findings] for r in found.collect()}["b.txt"] == ["plain"]


def test_changed_removed_and_restored_rules(spark):
    docs = spark.createDataFrame([("a", "plain pear"), ("b", "nothing")], "path string, text string")
    one, two = Rule("plain", "pl[a-z]+", 0, 1), Rule("plain", "pe[a-z]+", 0, 1, version=2)
    spans = lambda found: {r.path: [(f.kind, f.start, f.end) for f in r.findings] for r in found.collect()}
    found, ledger = scan(docs, "path", "text", rules=(one,))
    assert spans(found) == {"a": [("plain", 0, 5)], "b": []}
    found, new = scan(docs, "path", "text", ledger, (two,))
    assert spans(found) == {"a": [("plain", 6, 10)], "b": []} and {tuple(r.rules) for r in new.collect()} == {("plain:2",)}
    ledger = ledger.unionByName(new)
    found, new = scan(docs, "path", "text", ledger, (Rule("other", "not", 0, 1),))
    assert spans(found) == {"a": [], "b": [("other", 0, 3)]}
    found, new = scan(docs, "path", "text", ledger.unionByName(new), (one,))
    assert spans(found) == {"a": [("plain", 0, 5)], "b": []} and new.count() == 0


def test_many_matches_take_no_longer_each(spark):
    took = []
    for n in (100, 100, 20_000):  # the first warms up
        d = spark.createDataFrame([(1, "token=abcdefgh1 " * n)], "path long, text string")
        began = time.perf_counter()
        found, _ = scan(d, "path", "text")
        r = found.first()
        took.append(time.perf_counter() - began)
        assert len(r.findings) == n and [(f.start, f.end) for f in r.findings[-2:]] == [(16 * k, 16 * k + 15) for k in (n - 2, n - 1)]
    assert took[2] < took[1] + 5


def test_a_second_run_over_a_stored_ledger_scans_nothing(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found, new = scan(docs, "doc_id", "text")
    new.write.parquet(f"{tmp_path}/ledger")
    first = sorted(map(str, found.collect()))
    again, newer = scan(docs, "doc_id", "text", spark.read.schema(LEDGER).parquet(f"{tmp_path}/ledger"))
    assert newer.count() == 0 and sorted(map(str, again.collect())) == first and any("kind=" in x for x in first)
