import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstack.llm.pii import BASE, find_pii, find_spans, luhn, op3_pii, score

SF = "/root/testdata/sf0.01"


def base(t):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda x: (x[1], BASE.index(x[0])))


def test_all_documents_against_brute_force(spark):
    got = {r.doc_id: r for r in op3_pii(spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        want, r = base(d.text or ""), got.pop(d.doc_id)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x[0] for x in want) for k in BASE)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and x.split(":")[0] in BASE] == [x for x in text.split(",") if x]
    assert not got


@settings(max_examples=2000, deadline=None)
@given(st.text("ab@@..-+%_ 0123456789()é🙂", max_size=60))
def test_base_spans(t):
    assert [x for x in find_spans(t) if x[0] in BASE] == base(t)


def test_checksums_and_scores(spark):
    assert luhn("4242424242424242") and not luhn("4242424242424241")
    rows = [(1, "iban GB82 WEST 1234 5698 7654 32."), (2, "GB82 WEST 1234 5698 7654 33"), (3, "My card: 4242 4242 4242 4242"), (4, "🙂 4242-4242-4242-4242"), (5, None), (6, ""), (7, "1" * 200_000 + ".2.3.4 " + "+1 " * 50_000 + "9" * 300_000 + "@" * 1000)]
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    got = {r.doc_id: [(s.kind, s.start, s.end, round(s.score, 2)) for s in r.spans] for r in find_pii(d).collect()}
    assert got == {1: [("iban", 5, 32, 1.0)], 2: [], 3: [("card", 9, 28, 0.95)], 4: [("card", 2, 21, 0.8)], 5: [], 6: [], 7: []}
    assert find_pii(d.limit(0)).collect() == []


def test_luhn_catches_single_digit_errors():
    r = random.Random(1)
    for _ in range(200):
        d = "".join(r.choice("0123456789") for _ in range(15))
        d += next(c for c in "0123456789" if luhn(d + c))
        i = r.randrange(16)
        assert not luhn(d[:i] + str((int(d[i]) + r.randrange(1, 10)) % 10) + d[i + 1 :])


def test_ibans_before_other_tokens():
    for t, end in (
        ("DE89370400440532013000 BIC COBADEFFXXX", 22), ("DE89 3704 0044 0532 0130 00 EUR 20", 27), ("GB82WEST12345698765432 2024", 22), ("NO93 8601 1117 947 NOK", 18),
        ("DE89 3704 0044 0532 0130 01 EUR 20", None), ("DE89370400440532013000BIC", None), ("DE89 3704 0044", None),
    ):
        assert [x for x in find_spans(t) if x[0] == "iban"] == ([("iban", 0, end)] if end else [])
    two = "AB12 CD34 GB82 WEST 1234 5698 7654 32 DE89 3704 0044 0532 0130 00"
    assert [two[a:b] for k, a, b in find_spans(two) if k == "iban"] == [two[10:37], two[38:]]


def test_context_is_on_both_sides():
    card = "4242 4242 4242 4242"
    for t, raised in ((f"{card} (Visa)", True), (f"visas: {card}", True), (f"{card} {'x' * 60} visa", False), (f"visavis {card}", False), (f"{card}\nkreditkarte", True), (f"{card} payments", True), (card, False)):
        a = t.index("4242")
        assert score(t, "card", a, a + len(card)) == pytest.approx(0.95 if raised else 0.8), t
    assert score("ipsum 10.0.0.1 dolor", "ip", 6, 14) == 0.6 and score("10.0.0.1 is the server", "ip", 0, 8) == 0.75


def test_scores_are_returned(spark, tmp_path):
    rows = [(1, "iban DE89370400440532013000 BIC COBADEFFXXX and a@b.cd"), (2, "nothing")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.spans, r.scores) for r in op3_pii(spark, str(tmp_path)).collect()}
    assert got == {1: ("iban:5:27,email:48:54", "1.00,0.90"), 2: ("", "")}
