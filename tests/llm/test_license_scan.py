import random
import re

import pytest

from solstice.llm import license_scan as L

WORD = re.compile(r"(?:[A-Za-z0-9]|[^\x00-\x7f])+")


def words(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in WORD.findall(text or "")]


def brute(text):
    """Best containment of each template in the windows that the scan looks at, without MinHash."""
    w, out = words(text), {}
    for name, template in L.TEMPLATES.items():
        t = words(template)
        want = {tuple(t[i:i + L.GRAM]) for i in range(len(t) - L.GRAM + 1)}
        size = -(-len(t) * 5 // 4)
        step = max(1, size // 8)
        if len(w) < L.GRAM:
            continue
        shares = []
        for a in range(0, max(len(w) - size, 0) + step, step):
            part = w[a:a + size]
            shares.append(len(want & {tuple(part[i:i + L.GRAM]) for i in range(len(part) - L.GRAM + 1)}) / len(want))
        if max(shares) >= L.CONTAINED:
            out[name] = max(shares)
    return out


def test_equals_brute_force(spark):
    rng = random.Random(8)
    noise = lambda n: " ".join(rng.choice("the of under license version this work and to 2 0 public alpha beta".split()) for _ in range(n))
    texts = [None, "", "MIT", "Released under the MIT License", "RELEASED\nunder   the mit license!!", "under the"]
    for name, t in L.TEMPLATES.items():
        for _ in range(4):
            w = t.split()
            if rng.random() < 0.5 and len(w) > 9:
                w[rng.randrange(1, len(w) - 1)] = "other"
            texts.append(noise(rng.randrange(0, 60)) + " " + " ".join(w) + " " + noise(rng.randrange(0, 60)))
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, license string, containment string")
    got = {}
    for r in L.scan(df).collect():
        got.setdefault(r.doc_id, {})[r.license] = r.containment
    for i, t in enumerate(texts):
        assert got.get(i, {}) == pytest.approx(brute(t)), t


def test_exact_set_of_licenses(spark):
    around = "some words of a page before and after it "
    texts = [(around + t + " " + around, {name}) for name, t in L.TEMPLATES.items()]
    both = lambda *names: (" ".join(L.TEMPLATES[n] + "." for n in names), set(names))
    texts += [both("MIT", "Apache-2.0"), both("GPL-3.0", "GPL-2.0"), both("CC-BY-4.0", "CC-BY-SA-4.0"), both("GPL-3.0", "GPL-3.0"),
              ("Licensed under CC BY-ND 4.0", set()), ("This work is licensed under the GNU General Public License, version 1", set())]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = {}
    for r in L.licenses(df).collect():
        got.setdefault(r.doc_id, []).append(r.license)
    for i, (t, want) in enumerate(texts):
        assert sorted(got.get(i, [])) == sorted(want), t


def test_odd_rows(spark):
    t = "Released under the MIT License"
    long = "word " * 200_000 + t
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (2, long), (3, "été " * 50)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.license, r.start_word) for r in L.scan(df).collect())
    assert [g[:2] for g in got] == [("1", "MIT"), ("1", "MIT"), ("2", "MIT"), ("None", "MIT")]
    assert L.scan(df.limit(0)).collect() == []
    assert L.scan(df, {"short": "one"}).collect() == []


def test_table_finds_every_notice(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = {}
    for r in L.scan(docs).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    n = 0
    for r in docs.select("doc_id", "text").collect():
        for name in ("MIT", "Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0"):
            inside = " ".join(words(L.TEMPLATES[name])) in " ".join(words(r.text))
            if inside:
                n += 1
                assert name in got.get(r.doc_id, set()), (r.doc_id, name)
    assert n > 50
