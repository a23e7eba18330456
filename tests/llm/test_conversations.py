"""Prefix trie and structure repair against plain versions, and their edge rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from evalpack.llm import conversation_repair, prefix_trie

ROWS = "conv_id long, turn long, role string, text string, depth long, hi string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], ROWS)


# --- trie ------------------------------------------------------------------------------------

def plain_trie(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            convs[conv].append((turn is not None, turn or 0, sha(f"{len(role)}:{role}{text}"), role, text))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    members = defaultdict(list)
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        donor = c - int(np.fmod(c, 5))
        built[c] = tuple(turns.get(donor, [])[:h] + own[h:])
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    out = []
    for node, m in members.items():
        below = [x for x in members if x[:len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(y[:len(x)] == x and len(y) == len(x) + 1 for y in below)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ends = ",".join(str(c) for c in sorted(m) if built[c] == node)
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children), len(leaves), saved, sha(ends)))
    return sorted(out, key=repr)


def spark_trie(spark, rows, limit):
    nodes = prefix_trie.trie(table(spark, rows), limit).collect()
    return sorted([(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256 or sha("")) for r in nodes], key=repr)


def talks(rng, n, deep=6, words=3):
    return [(c, t, rng.choice(["user", "assistant", "é"]), "w" * rng.randrange(words) + "ü") for c in range(-7, n) for t in range(rng.randrange(deep + 1))]


@pytest.mark.parametrize("limit", [1 << 16, 40, 3])
def test_trie_equals_plain_trie(spark, limit):
    rng = random.Random(12)
    rows = talks(rng, 60)
    rows += [(100 + i, t, "user", "same") for i in range(30) for t in range(7)]  # exact copies
    rows += [(200 + i, 0, "system", "first") for i in range(25)] + [(200 + i, 1 + t, "user", str(i % 4)) for i in range(25) for t in range(3)]
    rows += [(300, None, "a", "b"), (300, None, None, None), (300, 1, "", ""), (300, 1, "", ""), (None, 1, "user", "x"), (301, 5, "user", None)]
    rows += [(c, t, "user", str(t)) for c in (400, 401) for t in range(60)]  # a deep chain of two
    rng.shuffle(rows)
    assert spark_trie(spark, rows, limit) == plain_trie(rows)


def test_trie_without_turns(spark):
    assert spark_trie(spark, [], 10) == [] == spark_trie(spark, [(None, 1, "user", "x")], 10)
    lone = [(5, 0, "user", "x" * 3_000_000)]
    assert spark_trie(spark, lone, 10) == plain_trie(lone)
    # h of 9 is 8 or less for both, the donor is absent: conversations of one turn may keep none
    short = [(c, 0, "user", "x") for c in range(1, 5)] + [(c, 0, "user", "x") for c in range(6, 10)]
    assert spark_trie(spark, short, 10) == plain_trie(short)


def test_stretches_of_one_conversation_join(spark):
    """A conversation that many tasks share has the same places and digests as one in a single task."""
    rows = [(5, t, "user", str(t % 50)) for t in range(3000)] + [(10, 0, "user", "x")]
    turns = prefix_trie.original_turns(table(spark, rows).repartition(4))
    assert sorted(r.place for r in turns.where("conv_id = 5").collect()) == list(range(3000))
    got = [r.asDict() for r in prefix_trie.trie(table(spark, rows), 500).where("conv_id = 5").orderBy("depth").collect()]
    assert len(got) >= 3000 and all(r["n_convs"] == 1 for r in got if r["depth"] > 0)
    assert [r["n_leaves"] for r in got if r["depth"] > 0] == [1] * 3000


def test_perfect_hash_slots():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, (5000, 2)).astype(np.uint64)
    table_ = prefix_trie.PerfectHash(keys)
    assert sorted(table_.slots(keys)) == list(range(5000))
    assert (table_.slots(rng.integers(0, 2**63, (5000, 2)).astype(np.uint64)) == -1).all()
    with pytest.raises(ValueError):
        prefix_trie.PerfectHash(np.zeros((2, 2), np.uint64))


def test_round_thresholds():
    assert prefix_trie.thresholds(5, 0, 10) == [10]
    assert prefix_trie.thresholds(10**6, 5, 1000) == [1000, 200_000, 40_000_000]
    assert prefix_trie.thresholds(50, 10**9, 10) == [10, 20, 40, 80]


def test_colliding_digests_fail(spark):
    rows = spark.createDataFrame([(1, 1, 1, 1, 5, 5, 9, 9, 0, 0), (2, 1, 1, 1, 6, 5, 9, 9, 0, 0)],
                                 "conv_id long, depth long, length long, bytes long, t1 long, t2 long, hi long, lo long, phi long, plo long")
    with pytest.raises(Exception, match="same digest"):
        prefix_trie.nodes_of(rows.select("conv_id", "length"), rows).collect()


# --- repair ------------------------------------------------------------------------------------

WHITE = " \t\n\x0b\x0c\r"


def plain_repair(rows):
    """rows (turn, role, text) in order -> (gaps, blank, duplicate, truncated, illegal, cost, audit, sha), by a DP from the end."""
    seen, faults, live = set(), [], []
    for _, role, text in rows:
        body = text.strip(WHITE)
        fault = "" if body else "b"
        fault = fault or ("d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))
        faults.append(fault)
    step = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
    best = [{} for _ in range(len(rows) + 1)]
    for i in range(len(rows), -1, -1):
        here = {q: (0, "") for q in (0, 3)} if i == len(rows) else {}
        for p in range(4) if i < len(rows) else ():
            found = [(3 + best[i + 1][p][0], "D" + best[i + 1][p][1])] if p in best[i + 1] else []
            more = faults[i] == "t"
            for (c, s), q in step.items():
                if s == p and faults[i] not in ("b", "d") and q in best[i + 1]:
                    cost, rest = best[i + 1][q]
                    if rows[i][1][:1] == c:
                        found.append((cost + more, "K" + rest))
                    if c != "s":
                        found.append((cost + 2 + more, "R" + rest))
            if found:
                here[p] = min(found)
        for _ in range(4):  # inserting
            for (c, p), q in step.items():
                if c != "s" and q in here:
                    here[p] = min(here.get(p, (9**9, "")), (here[q][0] + 2, "I" + here[q][1]))
        best[i] = here
    cost, audit = best[0][0]
    state, i = 0, 0
    for e in audit:
        if e == "D":
            i += 1
            continue
        role, text = (rows[i][1:] if e == "K" else ("assistant" if state == 2 else "user", "" if e == "I" else rows[i][2]))
        live.append(f"{role}:{text}")
        state, i = step[role[0], state], i + (e != "I")
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, sha("\n".join(live))


def ordered(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        convs[conv].append((turn is not None, turn or 0, sha(f"{len(role)}:{role}{text}"), turn, role, text))
    return {c: [x[3:] for x in sorted(v, key=lambda x: x[:3])] for c, v in convs.items()}


def chat(rng, n):
    role = lambda: rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
    text = lambda: rng.choice(["Yes.", "No!", "so", "", " \t", None, "Why? ", "é…", "x" * rng.randrange(9) + "."])
    return [(rng.choice([None, rng.randrange(n + 2), i]), role(), text()) for i in range(n)]


@pytest.mark.parametrize("block", [conversation_repair.BLOCK, 3])
def test_repair_equals_plain_repair(spark, block):
    rng = random.Random(11)
    rows = [(c, *r) for c in range(150) for r in chat(rng, rng.randrange(1, 9))]
    rows += [(None, *r) for r in chat(rng, 20)] + [(1000, *r) for r in chat(rng, 300)]
    rows += [(1001, 4, "user", "Same.")] * 20 + [(1002, t, "user", "Same.") for t in range(20)]
    rows += [(1003, t, "ua"[t % 2], f"{t}.") for t in range(50)] + [(1004, 0, "system", "x" * 3_000_000 + "."), (1004, 1, "user", "y" * 2_000_000)]
    rng.shuffle(rows)
    want = {c: plain_repair(r) for c, r in ordered(rows).items()}
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.summaries(table(spark, rows), block).collect()}
    assert got == want


def test_blocks_of_a_conversation_combine():
    """Costs and orders of blocks pick the same edits as one parse, and one split does what all splits do."""
    rng = random.Random(2)
    for _ in range(300):
        kinds = "".join(rng.choice("suaoSUAOxy") for _ in range(rng.randrange(1, 12)))
        size = rng.randrange(1, 5)
        cells = [conversation_repair.parse(kinds[i:i + size]) for i in range(0, len(kinds), size)]
        order = [{a: i for i, a in enumerate(sorted({c[1] for c in cell if c}))} for cell in cells]
        picks = conversation_repair.choose([([c and c[0] for c in cell], [c and o[c[1]] for c in cell]) for cell, o in zip(cells, order)])
        assert "".join(cell[i][1] + tail for cell, (i, tail) in zip(cells, picks)) == conversation_repair.whole(kinds)
        spans = {(i, i + 1): conversation_repair.parse(k) for i, k in enumerate(kinds)}
        for length in range(2, len(kinds) + 1):
            for i in range(len(kinds) - length + 1):
                ways = [conversation_repair.combine(spans[i, k], spans[k, i + length]) for k in range(i + 1, i + length)]
                spans[i, i + length] = ways[0]
                assert all(w == ways[0] for w in ways)
        assert spans[0, len(kinds)] == conversation_repair.parse(kinds)


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "assistant", "cut"), (1, 2, "user", ""), (1, 3, "user", "Go."), (1, 4, "user", "Go."), (2, 0, "user", "So?"), (2, 1, "tool", "It.")]
    out = conversation_repair.repaired(table(spark, rows)).collect()
    assert [(r.conv_id, r.edit, r.fault, r.was, r.role, r.text) for r in sorted(out, key=lambda r: (r.conv_id, r.place))] == [
        (1, "R", None, "assistant", "user", "Hi."), (1, "K", "truncated", "assistant", "assistant", "cut"), (1, "D", "blank", "user", "user", ""),
        (1, "K", None, "user", "user", "Go."), (1, "D", "duplicate", "user", "user", "Go."), (1, "I", None, None, "assistant", ""),
        (2, "K", None, "user", "user", "So?"), (2, "R", None, "tool", "assistant", "It.")]
    assert conversation_repair.repaired(table(spark, [])).count() == 0


def damaged_rows(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        what = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if what == 1 else "".join(c for c in text if c not in ".!?") if what == 2 else text
        out += [(conv, turn, "user" if what == 4 else role, text)] * (0 if what == 0 else 2 if what == 3 else 1)
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "edges"])
def test_repair_query_equals_plain_version(spark, sf, tmp_path):
    folder = f"/root/testdata/{sf}"
    if sf == "edges":
        folder = str(tmp_path)
        rows = [(c, t, "user", None) for c in [None, -3, *range(40)] for t in [None, 0, 9, -9]] + [(9999, 0, None, "x")] * 3
        table(spark, rows).write.parquet(f"{folder}/conversations.parquet")
    out = conversation_repair.op11_conversation_repair(spark, folder)
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = dict.fromkeys({r[0] for r in rows}, (0, 0, 0, 0, 0, 0, "", sha("")))
    want.update({c: plain_repair(r) for c, r in ordered(damaged_rows(rows)).items()})
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r.conv_id: tuple(r)[1:] for r in out.collect()} == want
