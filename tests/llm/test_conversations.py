"""Conversation repair and the prefix trie against brute force."""

import hashlib
import itertools
import re
import zlib

import pytest

from offerloom.llm import conv_repair as r
from offerloom.llm import conv_trie as t

SCHEMA = "conv_id long, turn long, role string, text string"
ROLES = ["system", "user", "assistant", "tool", "user", "assistant", ""]
TEXTS = ["Yes.", "No", "Why?", " ", "", "Right!\n", "so, then", "x" * 200 + "."]


def in_order(rows):
    key = lambda x: hashlib.sha256(f"{len(x[1])}:{x[1]}{x[2]}".encode()).digest()
    return sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1][:16], x[2][:64], key(x)))


def slow_repair(rows):
    """All edits of a few turns, with inserts anywhere."""
    turns, seen, kinds, counts = [x[0] for x in rows if x[0] is not None], set(), [], [0, 0, 0]
    for _, role, text in rows:
        said = text.strip(" \t\n\v\f\r")
        kind = 0 if not said else 1 if (role, text) in seen else 2 if said[-1] not in ".!?" else 3
        seen.add((role, text))
        kinds.append(kind)
        if kind < 3:
            counts[kind] += 1
    ways = [(0, "", "", ())]  # cost, audit, initials, repaired
    for (_, role, text), kind in zip(rows, kinds):
        edits = [(4, "D", ())]
        if kind > 1:
            more = 3 * (kind == 2)
            edits += [(more, "K", ((role, text),))] * bool(role) + [(3 + more, "R", ((new, text),)) for new in ("user", "assistant")]
        inserts = [()] + [(a,) for a in ("user", "assistant")] + list(itertools.product(("user", "assistant"), repeat=2))
        grown = []
        for cost, audit, initials, made in ways:
            for extra in inserts:
                for c, e, out in edits:
                    new = initials + "".join(x[0] for x in extra) + "".join(x[0][0] for x in out)
                    if re.fullmatch("s?(ua)*u?", new):
                        grown.append(
                            (cost + 3 * len(extra) + c, audit + "I" * len(extra) + e, new, made + tuple((x, "") for x in extra) + out)
                        )
        ways = grown
    ended = []
    for cost, audit, initials, made in ways:
        for extra in [()] + [(a,) for a in ("user", "assistant")] + [("user", "assistant")]:
            whole = initials + "".join(x[0] for x in extra)
            if re.fullmatch("(s?(ua)+)?", whole):
                ended.append((cost + 3 * len(extra), audit + "I" * len(extra), made + tuple((x, "") for x in extra)))
    cost, audit, made = min(ended)
    initials = [x[1][:1] for x in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in made).encode()).hexdigest()


def pick(*of):
    return zlib.crc32("/".join(map(str, of)).encode())


def some(conv, n):
    out = []
    for i in range(n):
        turn = None if pick(conv, i, "n") % 17 == 0 else pick(conv, i) % 6
        out.append((turn, ROLES[pick(conv, i, "r") % len(ROLES)], TEXTS[pick(conv, i, "t") % len(TEXTS)]))
    return out


def results(df):
    return {
        x["conv_id"]: tuple(x)[1:] if "gaps" not in x.asDict() else tuple(
            x[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
        ) for x in df.collect()
    }


@pytest.mark.parametrize("piece_rows", [20_000, 2])
def test_repairs_equal_all_edits(spark, piece_rows):
    convs = {c: some(c, pick(c) % 5) for c in range(120)}
    rows = [(c, *x) for c, held in convs.items() for x in held]
    got = results(r.repair_conversations(spark.createDataFrame(rows, SCHEMA).repartition(3), piece_rows=piece_rows, fan=2))
    assert got == {c: slow_repair(in_order(held)) for c, held in convs.items() if held}


def fold_repair(rows):
    """The same for any number of turns: the best way to each state, turn by turn."""
    marks = [f"{x[1]}\0{x[2]}".encode() for x in rows]
    kinds, facts = r.judged([x[0] for x in rows], [x[1] for x in rows], [x[2] for x in rows], marks, set())
    total = r.turn_matrix(kinds[0]) if kinds else r.product("")
    for kind in kinds[1:]:
        total = r.times(total, r.turn_matrix(kind))
    _, cost, audit = r.best(total)
    return facts.gaps(), facts.blank, facts.duplicate, facts.truncated, facts.illegal, cost, audit, r.digest(
        r.edited(audit, r.START, [x[1] for x in rows], [x[2] for x in rows])
    )


def test_one_long_conversation_crosses_partitions(spark):
    """A conversation of most rows: pieces, the tree and repeats seen in earlier pieces."""
    held = [(i // 2, ROLES[pick(i, "r") % 6], f"{pick(i, 't') % 900} {TEXTS[pick(i) % 8]}") for i in range(3000)]
    rows = [(5, *x) for x in held] + [(c, 0, "user", "Hi.") for c in range(40) if c != 5] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    key = "spark.sql.adaptive.enabled"
    spark.conf.set(key, "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = results(r.repair_conversations(df, piece_rows=50, fan=3))
    finally:
        spark.conf.set(key, "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[5] == fold_repair(in_order(held))
    assert got[6] == slow_repair([(0, "user", "Hi.")]) and got[6][5:7] == (3, "KI")
    assert got[None] == (0, 1, 0, 0, 0, 4, "D", hashlib.sha256(b"").hexdigest())


def test_products_are_associative():
    for n in range(60):
        kinds = "".join("suaxSUAXD"[pick(n, i) % 9] for i in range(n))
        cut = pick(n) % (n + 1)
        assert r.times(r.product(kinds[:cut]), r.product(kinds[cut:])) == r.product(kinds)


def test_repair_edges(spark):
    assert r.repair_conversations(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [
        (1, 3, "user", "a.", 1, True), (2, 0, "user", "a.", 2, False), (2, 0, "user", "a.", 2, False),
        (2, 9, "assistant", "b" * 300_000, 3, False)
    ]
    df = spark.createDataFrame(rows, SCHEMA + ", cost long, dropped boolean")
    got = results(r.repair_conversations(df, dropped_col="dropped"))
    assert got[1] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[2] == slow_repair([x[1:4] for x in rows[1:]]) and got[2][6] == "KDK"
    damaged = r.damaged(spark.createDataFrame([(c, 0, "assistant", "A. B!") for c in range(200)], SCHEMA)).collect()
    code = {c: pick_code(c) for c in range(200)}
    assert len(damaged) == 200 + sum(x == 3 for x in code.values())
    for x in damaged:
        c = code[x["conv_id"]]
        assert (x["dropped"], x["text"], x["role"]) == (c == 0, {1: "", 2: "A B"}.get(c, "A. B!"), "user" if c == 4 else "assistant")


def pick_code(conv, turn=0):
    return zlib.crc32(f"{conv}:{turn}".encode()) % 20


def slow_trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn, role or "", text or ""))
    convs = {c: [x[1:] for x in in_order(held)] for c, held in convs.items()}
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    nodes = {}
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            nodes.setdefault(tuple(made[c][:d]), []).append(c)
    out = set()
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        ends = ",".join(str(c) for c in members if len(made[c]) == len(path))
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[:-1] == p for q in nodes)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p)
        children = sum(len(q) == len(path) + 1 and q[:-1] == path for q in nodes)
        out.add(
            (
                members[0], len(path), nodes[path[:-1]][0] if path else None, len(members), children, len(leaves),
                saved, hashlib.sha256(ends.encode()).hexdigest()
            )
        )
    return out


def trie_rows(n):
    rows = []
    for c in list(range(0, n)) + [100, 101, 102, 150, 300, 917]:
        for turn in range(pick(c, "n") % 8):
            rows.append(
                (c, None if pick(c, turn) % 19 == 0 else turn, ROLES[turn % 3], TEXTS[pick(c % 3, turn) % 4] + ("" if turn < 6 else str(c)))
            )
    return rows


@pytest.mark.parametrize("first_turns", [1, 4])
def test_trie_equals_all_prefixes(spark, first_turns):
    rows = trie_rows(60) + [(None, 0, "user", "no conversation"), (7, 2, "user", "again"), (7, 2, "user", "again"), (8, 1, None, None)]
    got = t.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(4), first_turns=first_turns, most_turns=2)
    want = slow_trie(rows)
    found = [
        tuple(
            x[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
        ) for x in got.collect()
    ]
    assert len(found) == len(want) and set(found) == want


def test_trie_of_long_equal_conversations(spark):
    """Two conversations that agree for 300 turns, one twice as long; numbers run on where a conversation crosses partitions."""
    rows = [(c, i, "user", f"turn {i}" if i < 300 else f"{c} {i}") for c in (0, 600) for i in range(300 + c)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = t.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    by = {(x["conv_id"], x["depth"]): x for x in got}
    assert len(got) == 901 and by[0, 300]["n_convs"] == 2 and by[600, 301]["parent_conv_id"] == 0
    assert by[0, 0]["n_leaves"] == 1 and by[0, 0]["saved_tokens"] == sum(len(f"turn {i}") for i in range(300))
    assert by[600, 900]["n_children"] == 0 and by[600, 899]["n_children"] == 1


def test_members_of_a_class_cross_partitions(spark):
    rows = [(1, b"a", c) for c in range(5000)] + [(1, b"b", 7), (2, b"a", -3), (2, b"a", 10), (2, b"a", 9)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = t.member_digests(spark.createDataFrame(rows, "depth long, class binary, conv long").repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want = {}
    for depth, key, conv in sorted(rows):
        want.setdefault((depth, key), []).append(str(conv))
    assert {(x["depth"], bytes(x["class"])): x["ends_sha256"] for x in got} == {
        k: hashlib.sha256(",".join(v).encode()).hexdigest() for k, v in want.items()
    }


def test_trie_edges(spark):
    assert t.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(5, 0, "user", "y" * 100_000, 1)], SCHEMA + ", depth long")
    h = zlib.crc32(b"5") % 6
    assert len(t.prefix_trie(df).collect()) == (1 if h else 2)  # no conversation 0 to borrow from
