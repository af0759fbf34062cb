"""Stored state, statistics by changes, sources that fail alone, numbered lines, folders, traces."""

import os

import pytest
from pyspark.sql import functions as F

from quillstack.functions import markdown as M
from quillstack.operators import evaluate as E
from quillstack.operators import ingest as I
from quillstack.operators import retrieval as R
from quillstack.operators import runs as U
from quillstack.operators import store
from quillstack.sources.folder import markdown_folder
from quillstack.sources.lines import numbered_lines

DRAFT = "document_id string, id string, text string, version string, ordinal long"


def snapshot(spark, texts):
    rows = [(i.split("#")[0], i, t, f"v:{t}", int(i.split("#")[1])) for i, t in texts.items()]
    return spark.createDataFrame(rows, DRAFT)


SNAPSHOTS = [
    {"a#1": "one two two", "a#2": "three", "b#1": "one", "c#1": "gone soon"},
    {"a#1": "one two", "a#2": "three", "b#1": "one", "d#1": "two new words"},
    {"a#1": "one two two", "b#1": "", "d#1": "two new words"},  # a#1 is back to its first text
]

STILL = {f"s{n}#0": f"still {n}" for n in range(12)}


def test_three_snapshots_equal_a_rebuild(spark, tmp_path):
    path, history = str(tmp_path), None
    for n, texts in enumerate(SNAPSHOTS):
        rows = snapshot(spark, texts | STILL)
        listed = lambda: {os.path.join(d, f) for d, _, fs in os.walk(f"{path}/chunks") for f in fs if f.endswith(".parquet")}
        before = listed()
        store.update_stats(*store.save(rows, f"{path}/chunks", first=n == 0, parts=9), f"{path}/stats", parts=3)
        drafts = rows.select("id", "version", "ordinal")
        history = drafts.withColumn("superseded", F.lit(False)) if n == 0 else I.apply(drafts, history)
        stored = store.read(spark, f"{path}/chunks", store.HISTORY)
        key = lambda df: sorted(map(tuple, df.select("id", "version", "ordinal", "superseded").collect()))
        assert key(stored) == key(history)
        chunks = stored.where("not superseded")
        assert {r.term: r.df for r in store.stored_terms(spark, f"{path}/stats").collect()} == {r.term: r.df for r in R.term_stats(chunks).collect()}
        assert store.stored_corpus(spark, f"{path}/stats").first() == R.corpus_stats(chunks).first()
        assert n == 0 or (listed() - before and listed() & before)  # some partitions were written, others weren't touched
    again = store.save(snapshot(spark, SNAPSHOTS[-1] | STILL), f"{path}/chunks", parts=9)
    assert again[1].count() == 0  # nothing changed


def test_saves_return_what_changed_and_keep_repeated_rows_apart(spark, tmp_path):
    path = f"{tmp_path}/chunks"
    rows = snapshot(spark, {"a#1": "one", "a#2": "two", "b#1": "three"})
    twice = rows.union(rows.where("id = 'a#1'"))
    store.save(twice, path, first=True, parts=1)
    edited = twice.withColumn("version", F.when(F.col("id") == "a#2", "v:new").otherwise(F.col("version")))
    for _ in range(2):
        before, now = store.save(edited.where("id <> 'b#1'"), path, parts=1)
        changed = [sorted((r.id, r.version) for r in x.collect()) for x in (before, now)]
        assert changed == ([[("a#2", "v:two"), ("b#1", "v:three")], [("a#2", "v:new")]] if _ == 0 else [[], []])
        edited = edited.withColumn("ordinal", F.col("ordinal") + 1)  # moves alone change no statistics
    stored = sorted((r.id, r.version, r.superseded) for r in store.read(spark, path, store.HISTORY).collect())
    assert stored == [("a#1", "v:one", False)] * 2 + [("a#2", "v:new", False), ("a#2", "v:two", True), ("b#1", "v:three", True)]


def test_a_killed_write_leaves_the_old_state(spark, tmp_path):
    path = f"{tmp_path}/chunks"
    store.save(snapshot(spark, SNAPSHOTS[0]), path, first=True)
    old = sorted(map(tuple, store.read(spark, path, store.HISTORY).collect()))
    rows = store.read(spark, path, store.HISTORY)
    broken = rows.withColumn("text", F.when(F.col("id") == "c#1", F.raise_error(F.lit("lost"))).otherwise(F.lit("half written")))
    with pytest.raises(Exception, match="lost"):
        store.put(broken, path)
    assert sorted(map(tuple, store.read(spark, path, store.HISTORY).collect())) == old


def test_a_source_fails_alone(spark):
    columns = "reader string, source string, document_id string, id string, version string, ordinal long"
    rows = [("a", "a", "a:1", "a:1#x", "new", 0), ("b", "b", "b:1", "b:1#x", "new", 0), ("b", "c", "c:9", "c:9#x", "v", 0), ("c", "c", "c:1", "c:1#x", "v", 0), ("c", "c", "c:1", "c:1#x", "w", 1), ("d", "d", "d:1", "d:1#x", "v", 0)]
    past = [(s, f"{s}:1#x", "old", 0, False) for s in "abcde"] + [("a", "a:2#x", "old", 0, False)]
    history = spark.createDataFrame(past, "source string, id string, version string, ordinal long, superseded boolean")
    readers = spark.createDataFrame([(s,) for s in "abcde"], "reader string")
    report, after = I.ingest(spark.createDataFrame(rows, columns), history, readers)
    got = {r.reader: tuple(r)[1:] for r in report.collect()}
    assert got == {"a": (None, 1, 1, 2), "b": ("foreign document c:9", 0, 0, 0), "c": ("duplicate locator c:1", 0, 0, 0), "d": (None, 1, 1, 1), "e": (None, 0, 0, 1)}
    current = {(r.source, r.id, r.version) for r in after.collect() if not r.superseded}
    assert current == {("a", "a:1#x", "new"), ("b", "b:1#x", "old"), ("c", "c:1#x", "old"), ("d", "d:1#x", "v")}
    unseen = I.ingest(spark.createDataFrame(rows[:1], columns), history, readers.where("reader = 'a'"))[1]
    assert {r.source for r in unseen.collect() if not r.superseded} == {"a", "b", "c", "d", "e"}  # sources that weren't read stay


def test_lines_have_their_numbers_in_every_block(spark, tmp_path):
    text = [f"line {n} " + "x" * (n % 50) for n in range(3000)]
    (tmp_path / "a.txt").write_text("\n".join(text) + "\n")
    (tmp_path / "b.txt").write_text("only\n\nthree\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7k")
    try:
        rows = numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.line, r.value) for r in rows if r.file.endswith("a.txt")) == list(enumerate(text, 1))
    assert sorted((r.line, r.value) for r in rows if r.file.endswith("b.txt")) == [(1, "only"), (2, ""), (3, "three")]


def test_golden_files(spark, tmp_path):
    good = '{"id":"a","question":"q?","category":"open"}\n\n{"id":"b","question":"q","category":"ranking","expected":["x","y"]}\n'
    bad = '{"id":"a","question":"q?","category":"open"}\n{"id":"a","question":"x","category":"open"}\n{"id":" ","question":"q","category":"open"}\nnonsense\n{"id":"c","question":" ","category":"open"}\n{"id":"d","question":"q","category":"ranking","expected":["x"]}\n'
    (tmp_path / "good.jsonl").write_text(good)
    (tmp_path / "bad.jsonl").write_text(bad)
    lines = numbered_lines(spark, str(tmp_path))
    problems = {(r.file.rsplit("/", 1)[-1], r.line): r.problem for r in E.validate_golden(lines).collect()}
    assert problems == {("bad.jsonl", 2): "repeated id", ("bad.jsonl", 3): "blank id", ("bad.jsonl", 4): "malformed", ("bad.jsonl", 5): "blank question", ("bad.jsonl", 6): "ranking of one"}
    assert sorted((r.line, r.id, r.expected) for r in E.read_golden(lines).collect()) == [(1, "a", None), (3, "b", ["x", "y"])]


def test_a_folder_of_markdown(spark, tmp_path):
    files = {"a.md": "# A\ntext", "z/b.md": "plain", "_int/c.md": "# C\nx", ".hidden.md": "# H\ny", ".git/no.md": "no", "z/.x/no.md": "no", "z/note.txt": "no", "z-1/d.md": "\n---\nk: v\n---\n# D\r\nend line\x0cfeed\r\n"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    rows = markdown_folder(spark, str(tmp_path), 2)
    want = sorted((n for n in files if n.endswith(".md") and ".git" not in n and ".x" not in n), key=lambda p: p.split("/"))
    got = rows.collect()
    assert [r.path for r in got] == want and rows.rdd.getNumPartitions() == 3 and all(r.text == files[r.path] and r.updated_at for r in got)
    given = spark.createDataFrame([(p, files[p]) for p in want], "path string, text string")
    assert sorted(map(tuple, M.section_rows(rows).collect())) == sorted(map(tuple, M.section_rows(given).collect()))
    assert [r.text for r in M.section_rows(rows.where("path = 'z-1/d.md'")).collect()] == ["end line\x0cfeed"]
    assert markdown_folder(spark, f"file://{tmp_path}/z").count() == 1
    (tmp_path / "empty").mkdir()
    assert markdown_folder(spark, str(tmp_path / "empty")).count() == 0


def test_front_matter_and_words():
    assert M.without_front_matter("\n---\na: b\n---- more\nx") == "- more\nx" and M.without_front_matter("---\nnever closed") == "---\nnever closed"
    assert M.without_front_matter("--- a\n---\nx") == "x" and M.without_front_matter("x\n---\ny\n---\n") == "x\n---\ny\n---\n"
    assert M.words("Due_date é2x 2024 Naïve-Été") == ["due", "date", "naïve", "été"]
    assert M.entry(["due date / Payment day (DD-x-Yz, ACL)", "when"]) == (["due date", "payment day"], ["dd", "dxy", "acl"], ["due", "date", "payment", "day", "dd", "x", "yz", "acl", "when"])


def test_traces_keep_what_nobody_knows(spark):
    known = '{"step":"explain","record":{"kind":"explain","contradicts_verdict":true,"raw":"t"},"access":[{"chunk":"a","allowed":true,"why":1},{"chunk":"b","allowed":false},{"chunk":"c"}],"later":{"x":[1,2]}}'
    odd = '{"step":"new","record":{"kind":"new","deep":{"contradicts_verdict":true}}}'
    rows = spark.createDataFrame([("open", f"[{known},{odd},7]"), ("judged", f'[{{"step":"answer"}},{known}]'), ("broken", "[{"), ("object", "{}"), ("none", None), ("empty", "[]")], "id string, trace string")
    moved = {r.id: r.t for r in rows.select("id", U.as_json(U.migrate_trace(F.col("trace"))).alias("t")).collect()}
    assert moved["open"].count('"contradicts_verdict"') == 1 and '"deep":{"contradicts_verdict":true}' in moved["open"] and '"later":{"x":[1,2]}' in moved["open"] and moved["open"].endswith(",7]")
    assert moved["judged"].count('"contradicts_verdict":true') == 1 and moved["empty"] == "[]" and moved["broken"] is None and moved["object"] is None and moved["none"] is None
    seen = {r.id: r.t for r in rows.select("id", U.as_json(U.without_denials(F.col("trace"))).alias("t")).collect()}
    assert '"access":[{"allowed":true,"chunk":"a","why":1}]' in seen["open"] and '"deep"' in seen["open"]


def test_equal_arrivals_are_all_accounted_for(spark):
    batch = spark.createDataFrame([("r1", 1, "x"), ("r1", 1, "y"), ("r1", 2, "z"), ("r2", 5, "w")], "id string, arrived long, outcome string")
    fresh, rejected = U.new_runs(spark.createDataFrame([("r2",)], "id string"), batch)
    assert fresh.count() == 1 and rejected.count() == 3 and fresh.first().arrived == 1


def test_lines_are_found_where_they_stand(spark):
    chunks = spark.createDataFrame([("a", "say one two three four five now"), ("b", "xone two three four fivey"), ("c", "one two three five four"), ("d", "averyveryverylongword")], "id string, text string")
    lines = spark.createDataFrame([(1, "one two three four five"), (2, "veryverylong"), (3, "none of these words are there")], "qid int, line string")
    assert sorted((r.qid, r.id) for r in R.containing(chunks, lines).collect()) == [(1, "a"), (1, "b"), (2, "d")]


def test_models_and_oversized_texts(spark):
    chunks = spark.createDataFrame([("a", "m1"), ("b", "m1")], "id string, model string")
    R.require_model(chunks, "m1")
    R.require_model(chunks.limit(0), "m1")
    for other in (chunks, chunks.withColumn("model", F.when(F.col("id") == "a", F.col("model")))):
        with pytest.raises(ValueError, match="not all of"):
            R.require_model(other, "m2" if other is chunks else "m1")
    assert [len(b) for b in R.batches(iter(["a", "b" * 900, "c"]), 64, 20)] == [1, 1, 1]
    with pytest.raises(ValueError, match="text 1"):
        list(R.batches(iter(["a", "b" * 900, "c"]), 64, 20, reject=True))


def test_blank_questions_find_nothing_and_glossaries_reach_both_sides(spark):
    rows = [("a", "wages are paid on friday"), ("b", "holidays are long"), ("c", "friday is a day")]
    chunks = spark.createDataFrame([(i, "d", n, None, t) for n, (i, t) in enumerate(rows)], "id string, document_id string, ordinal long, heading string, text string")
    asked = spark.createDataFrame([(1, "When is the pay run?"), (2, "  "), (3, "holidays")], "qid long, question string")
    entries = spark.createDataFrame([(1, ["pay run"], [], ["wages", "friday"])], "entry long, phrases array<string>, acronyms array<string>, terms array<string>")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, embedding array<double>")
    seen = []

    def embed(expanded):
        seen.extend(sorted((r.qid, r.question) for r in expanded.collect()))
        return expanded.where("qid = 3").select("qid", F.array(F.lit(0.0), F.lit(1.0)).alias("query"))

    got = R.hybrid(asked, chunks, embed, vectors, chunks.select("id"), entries=entries).where("context_for is null").collect()
    assert seen == [(1, "When is the pay run? wages friday"), (3, "holidays")]
    assert {(r.qid, r.id) for r in got} >= {(1, "a"), (1, "c"), (3, "b")} and 2 not in {r.qid for r in got}
