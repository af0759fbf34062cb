"""Conversation repair against a search of all edit strings."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quillstack.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\v\f\r"


def faults(rows):
    """Rows (turn, role, text) in order with their first faults."""
    out, seen = [], set()
    for turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        bare = text.strip(WHITE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def legal(roles):
    x = "".join(r[:1] or "-" for r in roles)
    x = x[1:] if x.startswith("s") else x
    return (not roles) or (x and x == "ua" * (len(x) // 2))


def begun(tail):
    """May these roles still become legal?"""
    x = "".join(tail)
    x = x[1:] if x.startswith("s") else x
    return x == ("ua" * len(x))[: len(x)]


def brute(rows):
    """(cost, audit, digest) by relaxing every state of (rows read, all roles so far), without a heuristic or a queue."""
    rows = faults(rows)
    best = None
    front = {(0, ()): (0, "", ())}
    for k in range(len(rows) + 1):
        level = {key: v for key, v in front.items() if key[0] == k}
        for _ in range(2):  # insertions, twice in a row at most
            for (_, tail), (cost, audit, said) in list(level.items()):
                for role in ("user", "assistant"):
                    new = (cost + 5, audit + "I", (*said, f"{role}:"))
                    key = (k, (*tail, role[0]))
                    if begun(key[1]) and (key not in level or new[:2] < level[key][:2]):
                        level[key] = new
        if k == len(rows):
            for (_, tail), v in level.items():
                if legal(tail) and (best is None or v[:2] < best[:2]):
                    best = v
            break
        turn, role, text, fault = rows[k]
        for (_, tail), (cost, audit, said) in level.items():
            moves = [("D", 2, tail, said)]
            if fault not in ("blank", "duplicate"):
                charge = 5 if fault == "truncated" else 0
                moves += [("K", charge, (*tail, role[:1] or "-"), (*said, f"{role}:{text}"))]
                moves += [("R", charge + 1, (*tail, r[0]), (*said, f"{r}:{text}")) for r in ("user", "assistant")]
            for edit, price, to, words in moves:
                new = (cost + price, audit + edit, words)
                if begun(to) and ((k + 1, to) not in front or new[:2] < front[k + 1, to][:2]):
                    front[k + 1, to] = new
    return best[0], best[1], hashlib.sha256("\n".join(best[2]).encode()).hexdigest()


def counts(rows):
    rows = faults(rows)
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    return (gaps, *(sum(r[3] == f for r in rows) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs))


def made(seed, conversations, most=6):
    r = random.Random(seed)
    texts = ["Hi.", "Yes!", "no end", " ", "", "What?  ", "cut,", "Hi.", "a.\n"]
    return [(c, r.choice([t, t, t, None, t + 2]), r.choice(["user", "assistant", "system", "user", "assistant", "tool", ""]), r.choice(texts)) for c in range(conversations) for t in range(r.randint(1, most))]


def by_conversation(rows):
    out = {}
    for conv, *row in rows:
        out.setdefault(conv, []).append((row[0], " " if row[1] is None else row[1], " " if row[2] is None else row[2]))
    return out


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("block", [1, 2, 256])
def test_edits_are_the_cheapest(spark, monkeypatch, block):
    rows = made(7, 150)
    monkeypatch.setattr(C, "BLOCK", block)
    want = {c: (*counts(x), *brute(x)) for c, x in by_conversation(rows).items()}
    for conv, x in by_conversation(rows).items():  # the search itself, with blocks of any length
        said = []
        work = C._Repair(lambda edit, turn, role, text, fault, said=said: edit != "D" and said.append(f"{role}:{text}"))
        for turn, role, text, fault in faults(x):
            work.add(turn, role, text, 0 if fault is None else 1 + C._FAULTS.index(fault))
        assert (*work.finish(), hashlib.sha256("\n".join(said).encode()).hexdigest()) == want[conv], (conv, x)
    if block == 256:
        got = {r.conv_id: tuple(r[f] for f in FIELDS) for r in C.summaries(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert got == want


def test_turns_say_the_same(spark):
    rows = [*made(3, 60), (None, None, None, None), (None, 3, "user", "Hello?"), (None, 4, "assistant", "Hello.")]
    df = spark.createDataFrame(rows, SCHEMA)
    turns = {}
    for r in C.repaired(df).orderBy("step").collect():
        turns.setdefault(r.conv_id, []).append(r)
    for r in C.summaries(df).collect():
        mine = turns.get(r.conv_id, [])
        assert "".join(t.edit for t in mine) == r.audit and [t.step for t in mine] == list(range(len(mine)))
        assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in mine if t.edit != "D").encode()).hexdigest() == r.repaired_sha256
        assert legal([t.role for t in mine if t.edit != "D"])
    assert [t.edit for t in turns[None]] == ["D", "K", "K"] and turns[None][0].fault == "blank"


def test_damage_is_by_the_checksum(spark):
    rows = [(c, t, role, "One. Two! Three?") for c in range(40) for t, role in enumerate(["user", "assistant", None])] + [(None, None, "system", None), (1, None, "user", "x.")]
    want = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else text.translate({ord(x): None for x in ".!?"}) if k == 2 else text
        want += [(c, t, "user" if k == 4 else role, text, k == 0)] * (2 if k == 3 else 1)
    got = [tuple(r) for r in C.damaged(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and {w[4] for w in want} == {True, False}


def test_dropped_and_empty(spark):
    df = spark.createDataFrame([(1, 0, "user", "a.", True), (2, 0, "user", "a.", False)], SCHEMA + ", gone boolean")
    got = {r.conv_id: (r.audit, r.cost, r.repaired_sha256) for r in C.summaries(df).collect()}
    assert got == {1: ("", 0, hashlib.sha256(b"").hexdigest()), 2: ("D", 2, hashlib.sha256(b"").hexdigest())}
    assert C.summaries(spark.createDataFrame([], SCHEMA)).collect() == [] and C.repaired(spark.createDataFrame([], SCHEMA)).collect() == []


def test_other_columns_and_long_conversations(spark):
    n = 3000
    df = spark.range(n).select(F.lit("x").alias("CONV"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("who"), F.concat(F.col("id").cast("string"), F.lit(".")).alias("said"), F.lit(1).alias("fault"), F.lit(2).alias("role"))
    r = C.summaries(df, "CONV", "turn", "who", "said").first()
    assert r.audit == "K" * n and r.cost == 0 and r.CONV == "x"
    long = "word " * 200_000
    r = C.summaries(spark.createDataFrame([(1, 0, "user", long + "?"), (1, 1, "assistant", long)], SCHEMA)).first()
    assert (r.truncated, r.audit, r.cost) == (1, "DD", 4)


def test_a_conversation_lets_its_texts_go():
    work = C._Repair(lambda *edit: None)
    most = 0
    for k in range(20_000):
        work.add(k, "user" if k % 2 == 0 else "assistant", f"{k}.", 3 if k % 97 == 0 else 0)
        most = max(most, len(work.held))
    assert most <= 2 * C.BLOCK and len(work.finish()[-1]) == 20_000
