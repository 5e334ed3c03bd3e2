import random
import re

from solstice.llm.graph import components
from solstice.llm.jaccard_join import HUBS, _hubs, jaccard_components

SCHEMA = "doc_id long, text string, f string, size string, h string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def brute(rows, n, percent):
    sets = [(d, shingles(t, n)) for d, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i, (_, s) in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    for i, (_, s) in enumerate(sets):
        for j in {j for g in s for j in where[g] if j < i}:
            t = sets[j][1]
            both = len(s & t)
            if 100 * both >= percent * (len(s) + len(t) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(sets):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(s), low[find(i)]) for i, (d, s) in enumerate(sets))


def run(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, "x", "y", "z") for d, t in rows], SCHEMA)
    return sorted(tuple(r) for r in jaccard_components(df, **kw).select("doc_id", "n_shingles", "component_id").collect())


def family(rng, base, copies, edits):
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.random()}"
        out.append(" ".join(w))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(5)
    texts = [" ".join(f"t{rng.randrange(40)}" for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    for size, copies, edits in ((80, 40, 4), (200, 30, 9), (25, 20, 2), (12, 20, 1)):
        texts += family(rng, [f"b{rng.randrange(10 ** 6)}" for _ in range(size)], copies, edits)
    texts += ["A b  C", "a B c", "a\nb", "A B", "a", "A", "", " \t ", None, None, "é É x", "é é x"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert run(spark, rows) == brute(rows, 3, 90)
    assert run(spark, rows, n=5, percent=80) == brute(rows, 5, 80)
    assert run(spark, rows, n=1, percent=50) == brute(rows, 1, 50)


def test_null_and_repeated_ids(spark):
    t = " ".join(f"w{i}" for i in range(50))
    assert run(spark, [(3, t), (3, t), (5, t + " x")]) == [(3, 48, 3), (3, 48, 3), (5, 49, 3)]
    df = spark.createDataFrame([(None, t), (5, t), (7, "other words here")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_components(df).collect()}
    assert got == {None: None, 5: None, 7: 7}


def test_each_hub_once_and_without_filter_words(spark):
    rows = [(1, f, 10, 2, 5 if f < 4 else 900) for f in range(40)] + [(2, 7, 20, 1, 30), (2, 8, 21, 0, 700)] + [(3, f, 9, f % 5, 0) for f in range(30)]
    hubs = _hubs(spark.createDataFrame(rows, "h long, f long, size long, pos long, alone int"))
    assert hubs.columns == ["h", "f", "size", "pos"]
    got = [tuple(r) for r in hubs.collect()]
    assert len(got) == len(set(got)) and set(got) <= {r[:4] for r in rows}
    assert {f for h, f, *_ in got if h == 1} <= set(range(4))
    assert [r for r in got if r[0] == 2] == [(2, 7, 20, 1)]
    assert 1 < sum(h == 3 for h, *_ in got) <= HUBS


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, "")]) == [(1, 0, 1), (2, 0, 2)]


def test_chain_and_star_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(5, 5)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


def test_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows, 3, 90)
    assert sorted(tuple(r)[:3] for r in jaccard_components(docs).collect()) == want
    assert sum(c != d for d, _, c in want) > 10
