import hashlib
import itertools
import random
import re
import zlib

import pytest
from brute import SPACES
from compare import connect, spark_rows, sql_rows

from marquee.llm import conversations
from tests.conftest import MIDDLE, SMALL

SCHEMA = "conv_id bigint, turn bigint, role string, text string, dropped boolean"


def faults(rows):
    """(role, text, fault) of a conversation's rows in order."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
    out, seen = [], set()
    for _, role, text in rows:
        found = "".join(SPACES.findall(text))
        out.append((role, text, "blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1] not in ".!?" else None))
        seen.add((role, text))
    return out


def every_repair(rows, limit):
    """The least (cost, audit, repaired) over all edits with at most ``limit`` insertions, by trying all of them."""
    best = None
    n = len(rows)
    for gaps in itertools.product(range(3), repeat=n + 1):
        if sum(gaps) > limit:
            continue
        for edits in itertools.product("DKR", repeat=n):
            if any(e != "D" and rows[i][2] in ("blank", "duplicate") for i, e in enumerate(edits)):
                continue
            cost, audit, said = 2 * gaps[0], "I" * gaps[0], ["*:"] * gaps[0]
            for i, e in enumerate(edits):
                role, text, fault = rows[i]
                cost += {"D": 3, "K": 0, "R": 2}[e] + (fault == "truncated" and e != "D") + 2 * gaps[i + 1]
                audit += e + "I" * gaps[i + 1]
                said += ([] if e == "D" else [f"{role}:{text}" if e == "K" else f"*:{text}"]) + ["*:"] * gaps[i + 1]
            if best is not None and (cost, audit) >= best[:2]:
                continue
            first = 1 if said and said[0][0] == "s" else 0
            for i in range(first, len(said)):
                want = "user" if (i - first) % 2 == 0 else "assistant"
                if said[i][0] == "*":
                    said[i] = want + said[i][1:]
            if re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in said)):
                best = (cost, audit, "\n".join(said))
    return best


def want(rows, limit=4):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired."""
    turns = [t for t, _, _ in rows if t is not None]
    found = faults(rows)
    kinds = [x[2] for x in found]
    pairs = [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(found)]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")], sum(p not in ("su", "ua", "au") for p in pairs), *every_repair(found, limit))


def some(seed, most=5):
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "cut", " ", "", "Yes.", "why?", "end. \n", None]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    return [(rnd.choice([None, 0, 1, 2, 3, 7]), rnd.choice(roles), rnd.choice(texts)) for _ in range(rnd.randint(0, most))]


@pytest.mark.parametrize("chunk", [conversations.CHUNK, 2])
def test_against_every_repair(spark, chunk):
    """All edits of 250 short conversations, folded at once and in chunks of two turns."""
    cases = {i: some(i) for i in range(250)} | {900: [], None: some(901), 902: [(0, "system", "One."), (1, "system", "Two.")], 903: [(0, "system", "cut")]}
    rows = [(i, t, r, x, False) for i, c in cases.items() for t, r, x in c]
    rows += [(i, 50, "user", "gone", True) for i in cases]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "'x' AS fault", "1.5 AS at", "'y' AS turns", "'z' AS best")
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.repair(docs, chunk).collect()}
    assert got.keys() == cases.keys()
    for i, c in cases.items():
        assert got[i] == want(c), c


def damage(rows):
    """The contract's damage of (conv_id, turn, role, text), by conversation."""
    out = {}
    for c, t, role, text in rows:
        kept = out.setdefault(c, [])
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 0:
            continue
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def test_damage(spark):
    rows = [(c, t, r, "A. b! c?") for c in [None, *range(40)] for t, r in ((None, "system"), (0, "user"), (1, None), (2, "assistant"))]
    rows += [(77, 1, "user", None), (77, 1, "user", None)]
    found = {}
    for r in conversations.damaged(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect():
        found.setdefault(r["conv_id"], []).extend([] if r["dropped"] else [(r["turn"], r["role"], r["text"])])
    order = lambda x: sorted(x, key=str)
    assert {c: order(x) for c, x in found.items()} == {c: order(x) for c, x in damage(rows).items()}


def test_long_conversations(spark):
    """A conversation of 20,000 turns and a very long text, in chunks, against one fold over lists."""
    rnd = random.Random(5)
    rows = [(1, i, rnd.choice(["user", "assistant", "tool"]), rnd.choice([f"Turn {i}.", f"turn {i}", " "]), False) for i in range(20_000)]
    rows += [(2, 0, "user", "word " * 300_000 + ".", False), (2, 1, "assistant", "." + " " * 1_000_000 + "x", False)]
    got = {r["conv_id"]: r for r in conversations.repair(spark.createDataFrame(rows, SCHEMA)).collect()}
    # cost only, in plain numbers
    inf, cost = 1 << 40, [0, 1 << 40, 2, 4]
    for role, _, fault in faults([(t, r, x) for c, t, r, x, _ in rows if c == 1]):
        extra, new = (fault == "truncated"), [c + 3 for c in cost]
        if fault not in ("blank", "duplicate"):
            new[2] = min(new[2], min(cost[0], cost[1], cost[3]) + extra + 2 * (role[0] != "u"))
            new[3] = min(new[3], cost[2] + extra + 2 * (role[0] != "a"))
            new[1] = min(new[1], cost[0] + extra if role[0] == "s" else inf)
        new[2] = min(new[2], min(new[0], new[1], new[3]) + 2)
        new[3] = min(new[3], new[2] + 2)
        cost = new
    assert got[1]["cost"] == min(cost[0], cost[3])
    assert sum(c != "I" for c in got[1]["audit"]) == 20_000
    assert (got[2]["cost"], got[2]["audit"], got[2]["truncated"]) == (1, "KK", 1)
    assert got[2]["repaired"] == "user:" + "word " * 300_000 + ".\nassistant:." + " " * 1_000_000 + "x"


def test_empty_table(spark):
    assert conversations.repair(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("folder", [SMALL, MIDDLE])
def test_against_sql(spark, folder):
    names, rows = spark_rows(conversations.op11_conversation_repair(spark, folder))
    want_names, want_rows = sql_rows(connect(folder), conversations.ORACLE_SQL)
    assert names == want_names and rows == want_rows


def test_query_against_every_repair(spark):
    """The whole query on the smallest table, conversations of up to six turns after damage by trying all edits."""
    import duckdb

    whole = damage(duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SMALL}/conversations.parquet'").fetchall())
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.op11_conversation_repair(spark, SMALL).collect()}
    assert got.keys() == whole.keys()
    short = {c: rows for c, rows in whole.items() if len(rows) <= 5}
    assert short
    for c, rows in short.items():
        w = want(rows, 3)
        assert got[c] == (*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest())
