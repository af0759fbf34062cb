import random
from collections import defaultdict

import numpy as np
import pytest

from quillstack.llm.components import components
from quillstack.llm.jaccard import BLOCK, LEAF, Cells, Tree, jaccard_components, op5_jaccard_join, packed, points, shingle_groups, widths

SF = "/root/testdata/sf0.01"


def shingles(t, k):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def brute(docs, k, num, den):
    sets = [(d, shingles(t, k)) for d, t in docs]
    up = list(range(len(sets)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    by = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            by[x].append(i)
    for i, (_, s) in enumerate(sets):
        count = defaultdict(int)
        for x in s:
            for j in by[x]:
                if j > i:
                    count[j] += 1
        for j, c in count.items():
            if den * c >= num * (len(s) + len(sets[j][1]) - c):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[top(i)] = min(least.get(top(i), d), d)
    return sorted((d, len(s), least[top(i)]) for i, (d, s) in enumerate(sets))


def test_all_documents_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, op5_jaccard_join(spark, SF).collect())) == brute(docs, 3, 90, 100)


@pytest.mark.parametrize(("k", "num", "den", "block"), [(1, 80, 100, BLOCK), (2, 90, 100, BLOCK), (1, 80, 100, 400)])
def test_many_near_copies_of_all_sizes(spark, k, num, den, block):
    r, docs = random.Random(k), [(900, None), (901, ""), (902, " \n"), (903, "One"), (904, "one"), (905, "one two"), (906, "ONE two")]
    for _ in range(60):
        base = [f"w{r.randrange(500)}" for _ in range(r.choice([3, 5, 8, 10, 14, 19, 30, 60, 150]))]
        for _ in range(r.choice([1, 2, 6])):
            words = list(base)
            for _ in range(r.randrange(1 + len(words) // 8)):
                words[r.randrange(len(words))] = f"v{r.randrange(500)}"
            if r.random() < 0.5:
                words.append(f"u{r.randrange(9)}")
            docs.append((r.randrange(10_000, 10**9), " ".join(words)))
    docs += [docs[-1]]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, n int").repartition(5)
    got = sorted(map(tuple, jaccard_components(d, shingle=k, num=num, den=den, block=block).collect()))
    assert got == brute(docs, k, num, den)
    assert len({x[2] for x in got}) < len(got) - 20


@pytest.mark.parametrize("block", [BLOCK, 3000])
def test_a_large_group_that_no_head_joins(spark, block):
    """Chains of sets, each like its neighbours and unlike its first member."""
    r, docs = random.Random(2), []
    for chain in range(3):
        words = [f"c{chain}w{i}" for i in range(60)]
        for step in range(150):
            docs.append((len(docs), " ".join(words)))
            words[step * 7 % 60] = f"n{chain}x{step}"
    r.shuffle(docs)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, jaccard_components(d, shingle=1, num=90, den=100, block=block).collect()))
    assert got == brute(docs, 1, 90, 100) and len({x[2] for x in got}) == 3


def test_rows_without_ids_and_repeated_ids(spark):
    a, b = " ".join(f"w{i}" for i in range(40)), " ".join(f"w{i}" for i in range(39))
    rows = [(None, a, 1), (None, b, 2), (None, "alone here", 3), (7, b, 4), (7, b, 5), (7, "some other words", 6), (3, None, 7), (None, "", 8)]
    d = spark.createDataFrame(rows, "doc_id long, text string, ID int")
    got = sorted(map(tuple, jaccard_components(d, shingle=1).collect()), key=str)
    assert got == sorted([(None, 40, 7), (None, 39, 7), (None, 2, None), (7, 39, 7), (7, 39, 7), (7, 3, 7), (3, 0, 3), (None, 0, None)], key=str)
    only = shingle_groups(d.where("doc_id is null"), shingle=1).where("n > 2").collect()
    assert len({r["first"]["mark"] for r in only}) == 1 and {r["first"]["mark"] for r in only} <= {r["mark"] for r in only}


def test_the_tree_leaves_out_no_pair_that_may_link():
    r = np.random.default_rng(4)
    sets = []
    for _ in range(40):
        base = r.choice(2**60, r.integers(20, 2500), replace=False).astype(np.uint64)
        for _ in range(r.integers(1, 9)):
            sets.append(np.unique(np.concatenate([base[r.random(len(base)) > 0.08], r.choice(2**60, max(1, len(base) // 15)).astype(np.uint64)])))
    at = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    counts, ends = points(np.concatenate(sets), at)
    n = np.diff(at)
    assert (np.diff(ends) == widths(n)).all() and (np.add.reduceat(counts, ends[:-1]) == n).all()
    counts[5] += 1000
    wide = packed(counts, ends).to_pylist()
    counts_of = lambda i: np.frombuffer(wide[i], np.uint8 if len(wide[i]) == ends[i + 1] - ends[i] else "<i4")
    assert len(wide[0]) == 4 * ends[1] and all((counts_of(i) == counts[ends[i] : ends[i + 1]]).all() for i in range(len(n)))
    counts[5] -= 1000
    width = int(widths(n).min())
    matrix = np.stack([counts[a:b].reshape(width, -1).sum(1) for a, b in zip(ends, ends[1:], strict=False)])
    tree = Tree(matrix, n, np.arange(len(n)), 80, 100)
    top = tree.build(np.arange(len(n)))
    reached = {tuple(sorted(p)) for x, y in tree.pairs(top, top) for p in zip(x.tolist(), y.tolist(), strict=True)}
    linked = {(i, j) for i in range(len(n)) for j in range(i + 1, len(n)) if 180 * len(np.intersect1d(sets[i], sets[j])) >= 80 * (n[i] + n[j])}
    assert len(n) > 2 * LEAF and linked and linked <= reached
    half = len(n) // 2
    two = tree.build(np.arange(half)), tree.build(np.arange(half, len(n)))
    reached = {tuple(sorted(p)) for x, y in tree.pairs(*two) for p in zip(x.tolist(), y.tolist(), strict=True)}
    assert {p for p in linked if p[0] < half <= p[1]} <= reached and all(i < half <= j for i, j in reached)


@pytest.mark.parametrize("part", [10**6, 150])
def test_components(spark, part):
    r = random.Random(6)
    links = [(r.randrange(1200), r.randrange(1200)) for _ in range(500)] + [(i, i + 1) for i in range(2000, 2300)] + [(2**62, -(2**62)), (5, 5)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    lone = {x for link in links for x in link} - {x for a, b in links if a != b for x in (a, b)}
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long"), part).collect()))
    assert got == {x: top(x) for x in up if x not in lone}
    assert components(spark.createDataFrame([], "a long, b long"), part).collect() == []


def test_empty_table(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize(("num", "den"), [(80, 100), (90, 100)])
def test_linked_sets_share_a_signature(num, den):
    r = np.random.default_rng(num)
    for n in [*range(1, 60), 100, 333, 1000]:
        for _ in range(20):
            pool = r.choice(2**62, 3 * n + 9, replace=False).astype(np.uint64)
            a = pool[:n]
            cut = r.integers(0, n * (den - num) // den + 1)
            add = r.integers(0, n * (den - num) // num + 1)
            b = np.concatenate([a[cut:], pool[n : n + add]])
            both = len(a) - cut
            if den * both < num * (len(a) + len(b) - both) or set(a.tolist()) == set(b.tolist()):
                continue
            sig, who = Cells(num, den).signatures(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, len(a), len(a) + len(b)]))
            assert set(sig[who == 0].tolist()) & set(sig[who == 1].tolist())
