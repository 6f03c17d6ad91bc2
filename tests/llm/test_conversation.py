from __future__ import annotations

import hashlib
import heapq
import random
import re

import duckdb
import pytest

from driftwell.llm.conversation import cheapest, conversation_digests, power, product, repair, repaired, times, turn
from driftwell.llm.q_conversation import SQL, op13_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string"
FORM = re.compile(r"(s?(ua)+)?")


def slow_repair(rows):
    """Cheapest edits of (initial, fault) rows by trying all, in order of (cost, audit)."""
    heap = [(0, "", 0, "")]
    while heap:
        cost, audit, i, out = heapq.heappop(heap)
        if i == len(rows) and FORM.fullmatch(out):
            return cost, audit, out
        if len(audit) - i < 6:
            heap += [(cost + 2, audit + "I", i, out + r) for r in "ua"]
        if i < len(rows):
            initial, fault = rows[i]
            heap.append((cost + 3, audit + "D", i + 1, out))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                heap.append((cost + extra, audit + "K", i + 1, out + (initial or "-")))
                heap += [(cost + 2 + extra, audit + "R", i + 1, out + r) for r in "ua"]
        heap = [h for h in heap if re.fullmatch(r"s?(ua)*u?", h[3])]
        heapq.heapify(heap)


def cases(count, seed=3):
    rng = random.Random(seed)
    for _ in range(count):
        yield [(rng.choice("suatu"), rng.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(rng.randrange(7))]


def test_product_is_the_cheapest_repair():
    for rows in cases(400):
        assert cheapest(product([turn(*r) for r in rows])) == slow_repair(rows)[:2], rows


def test_products_are_associative():
    for rows in cases(60, seed=4):
        a, b, c = (product([turn(*r) for r in part]) for part in (rows[:2], rows[2:4], rows[4:]))
        assert times(times(a, b), c) == times(a, times(b, c)) == product([turn(*r) for r in rows])
    m = turn("u", "duplicate")
    assert power(m, 0) == product([]) and power(m, 5) == product([m] * 5)


@pytest.fixture
def many_parts(spark):
    names = {"spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def run_plainly(rows):
    """Faults, counts and repair of the rows (turn, role, text) of one conversation."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, judged, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\f\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        judged.append((role[:1], fault))
        if fault:
            counts[fault] += 1
    pairs = [a[0] + b[0] for a, b in zip(judged, judged[1:])]
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit = cheapest(product([turn(*j) for j in judged]))
    out, i = [], 0
    system = (len(audit) - audit.count("D")) % 2
    for edit in audit:
        if edit != "I":
            _, role, text = rows[i]
            i += 1
        want = "system" if system and not out else ("user", "assistant")[(len(out) - system) % 2]
        if edit != "D":
            out.append({"I": f"{want}:", "R": f"{want}:{text}", "K": f"{role}:{text}"}[edit])
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *counts.values(), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def collected(rows):
    told, ordered = repair(rows)
    told = told.cache()
    digests = {r.conv_id: r.sha256 for r in conversation_digests(repaired(rows, told, ordered)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, digests.get(r.conv_id, empty)) for r in told.collect()}


def conversation(rng, n):
    out = [[t, rng.choice(["user", "assistant", "assistant", "system", "tool"]), rng.choice(["yes.", "no", "", " \n", f"{t} words.", f"{t} cut", "ok!"])] for t in range(n)]
    for row in out:
        if rng.random() < 0.1:
            row[rng.randrange(3)] = None
    return [tuple(r) for r in out] + [tuple(r) for r in rng.sample(out, n // 5)]


def test_long_conversations_lie_in_many_partitions(spark, many_parts):
    rng = random.Random(5)
    convs = {1: conversation(rng, 700), 2: conversation(rng, 3), None: conversation(rng, 300), 4: [(0, "user", "same.")] * 90 + [(1, "assistant", "x.")] * 40}
    rows = spark.createDataFrame([(c, *r) for c, rs in convs.items() for r in rs], SCHEMA)
    got = collected(rows)
    assert got == {c: run_plainly(rs) for c, rs in convs.items()}
    _, ordered = repair(rows)
    assert {r.p for r in ordered.filter("conv_id = 1").selectExpr("shiftright(at, 33) p").distinct().collect()}.__len__() > 1


def test_many_small_conversations(spark):
    rng = random.Random(6)
    convs = {c: conversation(rng, rng.randrange(1, 9)) for c in range(120)}
    rows = spark.createDataFrame([(c, *r) for c, rs in convs.items() for r in rs], SCHEMA)
    assert collected(rows) == {c: run_plainly(rs) for c, rs in convs.items()}


def test_empty_and_clashing(spark):
    none = spark.createDataFrame([], SCHEMA)
    told, ordered = repair(none)
    assert told.count() == 0 and conversation_digests(repaired(none, told, ordered)).count() == 0
    rows = spark.createDataFrame([(1, 0, "user", "a.", "z", 5)], SCHEMA + ", audit string, at int")
    told, ordered = repair(rows)
    assert [(r.cost, r.audit) for r in told.collect()] == [(2, "KI")]
    assert sorted((r.position, r.role, r.text) for r in repaired(rows, told, ordered).collect()) == [(0, "user", "a."), (1, "assistant", "")]


def test_large_ids_beside_nulls_stay_exact(spark):
    big = 2**60 + 1
    rows = spark.createDataFrame([(c, t, r, x) for c in (big, big + 1, None) for t, r, x in ((None, "user", "a."), (big, "assistant", "b."), (big + 1, "user", "c."))], SCHEMA)
    got = collected(rows)
    want = run_plainly([(None, "user", "a."), (big, "assistant", "b."), (big + 1, "user", "c.")])
    assert got == {big: want, big + 1: want, None: want} and want[0] == 0


def test_sql_gives_the_same(spark, tmp_path):
    rng = random.Random(7)
    convs = {c: conversation(rng, rng.randrange(1, 9)) for c in [None, *range(80)]} | {900: [(1, "user", "lost.")] * 2}
    rows = spark.createDataFrame([(c, *r) for c, rs in convs.items() for r in rs], SCHEMA)
    rows.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(SQL)
    names = [c[0] for c in want.description]
    got = op13_conversation_repair(spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)
