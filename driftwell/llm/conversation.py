"""Conversation structure repair: a min-plus scan over 4x4 matrices whose elements are (cost, audit).

A conversation is well formed if the initials of its roles are ``(s?(ua)+)?``. Four states read that: nothing yet, after
s, after u, after a; the first and the last accept. Each turn is the matrix of what its edits (Keep, Rerole, Delete) do
to the state, times the closure of Inserts before it. Elements are (cost, audit): sums of costs beside joined initials;
the sum of two elements is the cheaper one, of equal cost the ASCII-least. That is a semiring on what meets in a cell:
all audits of a cell have the same number of edits but for Inserts, and each Insert costs, so of two with equal cost
none begins the other. Products are associative, so a conversation may be cut anywhere: each task multiplies what it
has of a conversation, and what lies across partitions is multiplied by a tree of groups, 16 partitions at a time.

How it runs: equal rows are counted together before they move (a row of m copies is one matrix power). Only digests and
the first 64 characters of texts are sorted, by ranges of (conversation, turn, role, text), so that one conversation may
lie in many partitions; at most two conversations of a partition reach into others. ``repair`` gives the edits row by
row, and ``repaired`` the new rows; texts join by their digest. Only ``conversation_digests`` needs a conversation's
lines in one task, since SHA-256 can't be cut; it reads them sorted, one at a time.

Order and odd rows: turns ascend, nulls first; rows of one turn by role, then text (its first 64 characters, then its
digest). Null roles and texts count as one space, null conversation ids are one conversation. A blank row has nothing
but ASCII white space; a duplicate has role and text of an earlier row; a truncated one doesn't end in ``.!?``. Columns
beside the four named ones aren't read. An empty table gives empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialise, text_batches

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States, and the moves that an s, u or a makes.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
MOVES = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: Partitions whose parts of one conversation are multiplied together.
FAN = 16
SPACE = " \t\n\x0b\f\r"
HEAD = 64

Element = tuple[int, str]
Matrix = list[dict[int, Element]]  # by row: column to element; what is missing is infinite


def identity() -> Matrix:
    return [{i: (0, "")} for i in range(4)]


def times(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product."""
    out: Matrix = []
    for row in a:
        best: dict[int, Element] = {}
        for k, (cost, audit) in row.items():
            for j, (more, rest) in b[k].items():
                c = cost + more
                if j not in best or c < best[j][0] or c == best[j][0] and audit + rest < best[j][1]:
                    best[j] = (c, audit + rest)
        out.append(best)
    return out


def plus(a: Matrix, b: Matrix) -> Matrix:
    return [{j: min(x[j] for x in (r, s) if j in x) for j in r.keys() | s.keys()} for r, s in zip(a, b)]


def closure(step: Matrix) -> Matrix:
    """I + S + S^2 + ...; three squarings are enough for four states, as each step costs."""
    out = plus(identity(), step)
    return times(times(out, out), times(out, out))


INSERTS = closure([{MOVES[r][i]: (INSERT, "I") for r in "ua" if i in MOVES[r]} for i in range(4)])


def turn(initial: str, fault: str) -> Matrix:
    """The matrix of a row, with Inserts before it."""
    out = [{i: (DELETE, "D")} for i in range(4)]
    if fault not in ("blank", "duplicate"):
        extra = TRUNCATED * (fault == "truncated")
        for role, cost, edit in [(initial, 0, "K"), ("u", REROLE, "R"), ("a", REROLE, "R")]:
            out = plus(out, [{MOVES[role][i]: (cost + extra, edit)} if i in MOVES.get(role, ()) else {} for i in range(4)])
    return times(INSERTS, out)


def power(m: Matrix, n: int) -> Matrix:
    out = identity()
    while n:
        out, m, n = times(out, m) if n & 1 else out, times(m, m) if n > 1 else m, n >> 1
    return out


def product(matrices: list[Matrix]) -> Matrix:
    """By a balanced tree, so that audits are copied log n times."""
    while len(matrices) > 1:
        matrices = [times(*matrices[i : i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    return matrices[0] if matrices else identity()


def cheapest(m: Matrix) -> Element:
    """Cost and audit of a whole conversation."""
    row = times(m, INSERTS)[NOTHING]
    return min(row[j] for j in (NOTHING, ASSISTANT) if j in row)


def _ordered(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies, in order: ``at`` grows, by one within a partition."""
    text = F.col("text")
    bare = F.rtrim(text, F.lit(SPACE))
    narrow = rows.select(
        "conv_id", "turn", "role", F.substring(text, 1, HEAD).alias("head"), _key().alias("key"),
        F.when(bare == "", "blank").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated").alias("fault"),
    )
    distinct = materialise(narrow.groupBy(*narrow.columns).agg(F.count("*").alias("copies")))
    again = distinct.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("turn")).alias("first")).filter("n > 1").select("key", "first")
    later = F.col("first").isNotNull() & (F.col("first")["turn"].eqNullSafe(F.col("turn")) == False) & ~F.col("fault").eqNullSafe("blank")  # noqa: E712
    flagged = distinct.join(again, "key", "left").select("conv_id", "turn", "role", "head", "key", F.when(later, "duplicate").otherwise(F.col("fault")).alias("fault"), "copies")
    order = ["conv_id", "turn", "role", "head", "key"]
    return materialise(flagged.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))


def _key() -> Column:
    """A digest of conversation, role and text, the same for rows that repeat one another."""
    return F.unhex(F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))


#: Ids and turns are strings in here: beside nulls pandas would make floats of them, which aren't exact beyond 2^53.
PART = """conv_id string, part long, edge boolean, matrix array<struct<i:int,j:int,cost:long,audit:string>>,
    places array<struct<at:long,copies:array<long>>>, blank long, duplicate long, truncated long, illegal long,
    first string, last string, low string, high string, turns long"""
LEGAL = {"su", "ua", "au"}


def _packed(m: Matrix) -> list[dict]:
    return [{"i": i, "j": j, "cost": c, "audit": a} for i, row in enumerate(m) for j, (c, a) in row.items()]


def _unpacked(cells: list[dict]) -> Matrix:
    m: Matrix = [{} for _ in range(4)]
    for x in cells:
        m[x["i"]][x["j"]] = (x["cost"], x["audit"])
    return m


def _missing(x: object) -> bool:
    return x is None or x is pd.NA or x != x


def _whole(x: object) -> int | None:
    return None if _missing(x) else int(x)


def _summary(conv: object, rows: list[tuple]) -> dict:
    """What a stretch of a conversation's distinct rows (at, turn, initial, fault, copies) comes to."""
    matrices, counts, illegal, turns = [], dict.fromkeys(("blank", "duplicate", "truncated"), 0), 0, set()
    for k, (_, t, initial, fault, copies) in enumerate(rows):
        rest = "blank" if fault == "blank" else "duplicate"  # of the row's further copies
        matrices.append(turn(initial, fault))
        if copies > 1:
            matrices.append(power(turn(initial, rest), copies - 1))
        if fault:
            counts[fault] += 1
        counts[rest] += copies - 1
        illegal += (copies - 1) * (initial * 2 not in LEGAL) + (k > 0 and rows[k - 1][2] + initial not in LEGAL)
        if t is not None:
            turns.add(t)
    return {
        "conv_id": conv, "part": rows[0][0] >> 33, "matrix": _packed(product(matrices)), "places": [{"at": rows[0][0], "copies": [r[4] for r in rows]}],
        **counts, "illegal": illegal, "first": rows[0][2], "last": rows[-1][2], "low": str(min(turns)) if turns else None, "high": str(max(turns)) if turns else None, "turns": len(turns),
    }


def _merged(parts: list[dict]) -> dict:
    """Neighbouring stretches of one conversation, in order, as one."""
    out = dict(parts[0])
    out["matrix"] = _packed(product([_unpacked(p["matrix"]) for p in parts]))
    out["places"] = [x for p in parts for x in p["places"]]
    for p in parts[1:]:
        for c in ("blank", "duplicate", "truncated", "illegal", "turns"):
            out[c] += p[c]
        out["illegal"] += out["last"] + p["first"] not in LEGAL
        out["last"] = p["last"]
        low = _whole(p["low"])
        if low is not None:
            known = _whole(out["high"])
            out["turns"] -= known == low
            out["low"], out["high"] = p["low"] if known is None else out["low"], p["high"]
    return out


def _frame(rows: list[dict]) -> pd.DataFrame:
    columns = ["conv_id", "part", "edge", "matrix", "places", "blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns"]
    frame = pd.DataFrame(rows, columns=columns)
    for c in ("conv_id", "low", "high"):
        frame[c] = pd.Series([r[c] for r in rows], dtype=object)
    return frame


def _stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One summary for each conversation of a partition; the first and the last may go on elsewhere."""
    open_conv, rows, done, seen = None, [], [], False

    def close(last: bool) -> None:
        nonlocal seen
        done.append(_summary(open_conv, rows) | {"edge": last or not seen})
        seen = True

    for batch in batches:
        for conv, at, t, initial, fault, copies in zip(*(batch[c].tolist() for c in ("conv_id", "at", "turn", "initial", "fault", "copies"))):
            conv = None if _missing(conv) else conv
            if rows and conv != open_conv:
                close(False)
                rows = []
            open_conv = conv
            rows.append((int(at), _whole(t), initial, "" if _missing(fault) else fault, int(copies)))
        if done:
            yield _frame(done)
            done = []
    if rows:
        close(True)
        yield _frame(done)


def _told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The cheapest repair of each conversation."""
    for batch in batches:
        rows = []
        for p in batch.to_dict("records"):
            cost, audit = cheapest(_unpacked(p["matrix"]))
            low, high = _whole(p["low"]), _whole(p["high"])
            gaps = 0 if low is None else high - low + 1 - p["turns"]
            rows.append({"conv_id": None if _missing(p["conv_id"]) else p["conv_id"], "gaps": gaps, **{c: p[c] for c in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": audit, "places": p["places"]})
        yield pd.DataFrame(rows, columns=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "places"])


def _edits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows that a repair leaves: place in the conversation, ``at`` of the row kept (null: inserted), and its new role (null: its own)."""
    for batch in batches:
        conv_id, position, at_of, roles = [], [], [], []
        for conv, audit, places in zip(batch["conv_id"].tolist(), batch["audit"], batch["places"]):
            rows = [(p["at"] + k, int(n)) for p in places for k, n in enumerate(p["copies"])]
            state, out, k, left = NOTHING, 0, 0, rows[0][1] if rows else 0
            for edit in audit:
                if edit != "I":
                    while left == 0:
                        k, left = k + 1, rows[k + 1][1]
                    at, left = rows[k][0], left - 1
                if edit == "D":
                    continue
                # a system row is only ever the first that stays, and only kept; what comes next follows from the state
                kept_system = edit == "K" and state == NOTHING and _is_system(audit)
                state = SYSTEM if kept_system else ASSISTANT if state == USER else USER
                conv_id.append(conv)
                position.append(out)
                at_of.append(None if edit == "I" else at)
                roles.append(None if edit == "K" else "user" if state == USER else "assistant")
                out += 1
        yield pd.DataFrame({"conv_id": pd.Series(conv_id, dtype=object), "position": position, "at": pd.array(at_of, dtype="Int64"), "new_role": pd.Series(roles, dtype=object)})


def _is_system(audit: str) -> bool:
    """Whether what an audit leaves begins with a system row: then its number of rows is odd."""
    return (len(audit) - audit.count("D")) % 2 == 1


def _plain(rows: DataFrame) -> DataFrame:
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows with conv_id, turn, role and text: the conversations (faults, cost, audit), and the ordered distinct rows."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    ordered, schema = _ordered(_plain(rows)), PART
    narrow = ordered.select(F.col("conv_id").cast("string").alias("conv_id"), "at", F.col("turn").cast("string").alias("turn"), F.substring("role", 1, 1).alias("initial"), "fault", "copies")
    parts = materialise(narrow.mapInPandas(_stretches, schema))
    edges = parts.filter("edge")  # two a partition at most
    # a conversation with one part needs no tree
    several = edges.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("part").alias("top")).filter("n > 1").withColumnRenamed("conv_id", "c")
    joined = edges.join(several, F.col("c").eqNullSafe(F.col("conv_id")), "left")
    tree = joined.filter("n is not null").select(*parts.columns)
    top = several.agg(F.max("top")).first()[0]
    while top:
        tree = materialise(tree.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("conv_id", "part").applyInPandas(_merge_group, schema))
        top //= FAN
    whole = parts.filter("not edge").unionByName(joined.filter("n is null").select(*parts.columns)).unionByName(tree)
    told = "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, places array<struct<at:long,copies:array<long>>>"
    return materialise(whole.mapInPandas(_told, told).withColumn("conv_id", F.col("conv_id").cast(kind))), ordered


def _merge_group(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    parts = sorted(group.to_dict("records"), key=lambda p: p["places"][0]["at"])
    return _frame([_merged(parts) | {"conv_id": None if _missing(key[0]) else key[0], "part": key[1], "edge": True}])


def repaired(rows: DataFrame, told: DataFrame, ordered: DataFrame) -> DataFrame:
    """conv_id, position, role and text of what the repairs leave; inserted rows have an empty text."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    named = told.select(F.col("conv_id").cast("string").alias("conv_id"), "audit", "places")
    edits = materialise(named.mapInPandas(_edits, "conv_id string, position long, at long, new_role string").withColumn("conv_id", F.col("conv_id").cast(kind)))
    kept = edits.filter("at is not null").join(ordered.select("at", "role", "key"), "at")
    texts = _plain(rows).select(_key().alias("key"), "text").groupBy("key").agg(F.first("text").alias("text"))
    stay = kept.join(texts, "key").select("conv_id", "position", F.coalesce("new_role", "role").alias("role"), "text")
    return stay.unionByName(edits.filter("at is null").select("conv_id", "position", F.col("new_role").alias("role"), F.lit("").alias("text")))


def conversation_digests(rows: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's ``role:text`` lines, joined by newlines; sorted lines are read one at a time."""
    text_batches(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType.simpleString()
    lines = rows.select(F.col("conv_id").cast("string").alias("conv_id"), "position", F.concat("role", F.lit(":"), "text").cast("binary").alias("line"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, state = None, None
        for batch in batches:
            out = []
            for c, at, line in zip(batch["conv_id"].tolist(), batch["position"].tolist(), batch["line"]):
                c = None if _missing(c) else c
                if at == 0:
                    if state is not None:
                        out.append((conv, state.hexdigest()))
                    conv, state = c, hashlib.sha256(line)
                else:
                    state.update(b"\n" + line)
            yield pd.DataFrame({"conv_id": pd.Series([c for c, _ in out], dtype=object), "sha256": pd.Series([s for _, s in out], dtype=object)})
        if state is not None:
            yield pd.DataFrame({"conv_id": pd.Series([conv], dtype=object), "sha256": [state.hexdigest()]})

    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "position").mapInPandas(digest, "conv_id string, sha256 string").withColumn("conv_id", F.col("conv_id").cast(kind))
