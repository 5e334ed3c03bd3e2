import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from solstice.llm import conversation_repair as C
from solstice.llm.queries import op11_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string"
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    """First fault of each (turn, role, text) row."""
    seen, out = set(), []
    for _, role, text in rows:
        marks = VISIBLE.findall(text)
        out.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows):
    """(cost, audit, repaired) by trying every row's edits and up to two inserts around them, keeping the best of each state."""
    found = faults(rows)
    legal_next = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", ())}

    def inserts(best):
        for _ in range(2):
            new = dict(best)
            for q, (c, a, t) in best.items():
                p = "u" if q != "u" else "a"
                cand = (c + 3, a + "I", t + ((("user", "assistant")[p == "a"], ""),))
                new[p] = min(new.get(p, cand), cand)
            best = new
        return best

    for (_, role, text), fault in zip(rows, found):
        best, new = inserts(best), {}

        def offer(q, cand):
            new[q] = min(new.get(q, cand), cand)

        for q, (c, a, t) in best.items():
            offer(q, (c + 4, a + "D", t))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            if role[:1] and role[:1] in legal_next[q]:
                offer(role[:1], (c + more, a + "K", t + ((role, text),)))
            p = "u" if q != "u" else "a"
            offer(p, (c + 3 + more, a + "R", t + ((("user", "assistant")[p == "a"], text),)))
        best = new
    best = inserts(best)
    return min(best[q] for q in ("", "a") if q in best)


def summary(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    found = faults(rows)
    turns = {r[0] for r in rows} - {None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, fixed = brute(rows)
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, sha


def compared(spark, rows, out):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert len(out) == len(convs)
    for r in out:
        assert tuple(r)[1:] == summary(convs[r.conv_id]), r.conv_id


CODES = st.lists(st.tuples(st.sampled_from(["s", "u", "a", "x", ""]), st.booleans(), st.booleans()), max_size=14)


def streamed(rows):
    out = []
    c = C.Conversation(lambda e, role, text: out.append((role, text)))
    for k, (initial, goes, truncated) in enumerate(rows):
        c.add(k, initial, "" if goes else f"text {k}" + "." * (not truncated), False)
    c.finish()
    return c, tuple(out)


def as_rows(codes):
    return [(k, i, "" if g else f"text {k}" + "." * (not t)) for k, (i, g, t) in enumerate(codes)]


@settings(max_examples=500, deadline=None)
@given(CODES)
def test_cheapest_and_least(codes):
    c, out = streamed(codes)
    assert (c.cost, c.audit.decode(), out) == brute(as_rows(codes))


@pytest.mark.parametrize("block", [1, 2, 5])
def test_blocks_give_the_same(monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(300):
        codes = [(rng.choice("suax"), rng.random() < 0.15, rng.random() < 0.3) for _ in range(rng.randrange(25))]
        c, out = streamed(codes)
        assert (c.cost, c.audit.decode(), out) == brute(as_rows(codes))


def test_a_long_conversation_holds_few_rows():
    rng = random.Random(1)
    codes = [(rng.choice("suaua"), rng.random() < 0.1, rng.random() < 0.2) for _ in range(6000)]
    out = []
    c = C.Conversation(lambda e, role, text: out.append((role, text)))
    most = 0
    for k, i, t in as_rows(codes):
        c.add(k, i, t, False)
        most = max(most, len(c.rows))
    c.finish()
    assert (c.cost, c.audit.decode(), tuple(out)) == brute(as_rows(codes)) and most <= 4 * C.BLOCK


ODD = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, None, "system", "Be kind."), (1, 9, "user", "no end"),
    (2, None, None, None), (2, None, "user", None), (2, None, None, "x."),
    (None, 1, "user", "a."), (None, 1, "user", "a."), (None, 2, "assistant", "b? \t\n"), (None, -(2**63), "tool", "c."), (None, 2**63 - 1, "User", "d."),
    (3, 5, "", ""), (4, 0, "user", "\x1c"), (5, 0, "system", "Only this."), (6, 0, "assistant", "a!" * 50000), (6, 1, "uncle", "é."), (7, 3, "system", "a."), (7, 3, "system", "b."),
]


def test_odd_rows(spark):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in ODD], SCHEMA + ", audit string, again string")
    out = C.audits(df).collect()
    assert {r.gaps for r in out if r.conv_id is None} == {2**63 - 1}
    fixed = [r if r.conv_id is not None else None for r in out]
    rows = [r for r in ODD if r[0] is not None]
    compared(spark, rows, [r for r in fixed if r])
    lines = {}
    for r in C.repaired(df).orderBy("conv_id", "position").collect():
        assert r.position == len(lines.setdefault(r.conv_id, []))
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    for r in out:
        assert r.repaired_sha256 == hashlib.sha256("\n".join(lines.get(r.conv_id, [])).encode()).hexdigest()


def test_empty_table(spark):
    assert C.audits(spark.createDataFrame([], SCHEMA)).collect() == [] == C.repaired(spark.createDataFrame([], SCHEMA)).collect()


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if d == 1:
            text = ""
        if d == 2:
            text = re.sub("[.!?]", "", text)
        if d == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return out


def query_equals(spark, folder, rows):
    out = op11_conversation_repair(spark, folder).collect()
    left = damaged(rows)
    whole = {r[0] for r in rows}
    gone = whole - {r[0] for r in left}
    compared(spark, left, [r for r in out if r.conv_id not in gone])
    assert {r.conv_id for r in out} == whole and len(out) == len(whole)
    empty = hashlib.sha256(b"").hexdigest()
    assert all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "", empty) for r in out if r.conv_id in gone)


def test_query_on_the_table(spark):
    for folder in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        query_equals(spark, folder, [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()])


def test_query_on_odd_rows(spark, tmp_path):
    rows = [r for r in ODD if r[0] is not None] + [(100 + k, 0, "user", "One row.") for k in range(60)] + [(None, None, "user", "x")] * 3
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    query_equals(spark, str(tmp_path), rows)
