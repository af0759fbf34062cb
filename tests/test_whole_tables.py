"""Queries over whole tables against brute force."""

from collections import defaultdict

from quillstack.plans import catalogue

SF = "/root/testdata/sf0.001"


def lines(spark):
    out = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        if kept := [x.strip(" ") for x in (r.text or "").split("\n") if x.strip(" ")]:
            out[f"{r.source}:{r.doc_id}"] = kept
    return out


def test_sources_are_whole(spark):
    docs = lines(spark)
    assert max(map(len, docs.values())) > 5 and max(sum(map(len, x)) for x in docs.values()) > 2000
    escape = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    state = {r.qid: r.state for r in catalogue.QUERIES["answer_state_whole"](spark, SF).collect()}
    assert state == {d: "\n".join(f"[{n}] {t}" for n, t in enumerate(x, 1))[:16000] for d, x in docs.items()}
    prompt = {r.qid: r.prompt for r in catalogue.QUERIES["explain_prompt_whole"](spark, SF).collect()}
    assert prompt.keys() == docs.keys()
    assert all(prompt[d].count("<source chunk_id=") == len(x) and all(escape(t) + "\n</source>" in prompt[d] for t in x) for d, x in docs.items())
    shown = {r.document_id: r.markdown for r in catalogue.QUERIES["render_sources_whole"](spark, SF).collect()}
    cut = lambda t: t[:200].rstrip(" ") + "…" if len(t) > 200 else t
    assert shown == {d: "**Sources**\n" + "\n".join(f"[{n}] [Document {d.split(':')[1]}]({d}): {cut(t)}" for n, t in enumerate(x, 1)) for d, x in docs.items()}


def test_rules_and_layers_cover_all_documents(spark):
    ids = [(r.source, str(r.doc_id)) for r in spark.read.parquet(f"{SF}/documents.parquet").select("source", "doc_id").collect()]
    got = {r.document_id: (r.acl.split(",") if r.acl else [], r.sensitivity) for r in catalogue.QUERIES["label_rules_corpus"](spark, SF).collect()}
    want = {f"{s}:{i}": (["role:hr"], "confidential") if s == "src1" else (["role:hr", "role:payroll"], "internal") if (s, i) == ("src0", "10") else ([], "public") if s == "src0" else ([], "internal") for s, i in ids}
    assert got == want
    paths = {r.path: r.standing for r in catalogue.QUERIES["layer_resolution_corpus"](spark, SF).collect()}
    assert paths == {f"{s}/{i}": "authoritative" if s == "src0" else "evidence" for s, i in ids if s != "src1"}
