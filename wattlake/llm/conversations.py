"""Repair of a conversation's structure by the cheapest edits, found in a DAG from both ends.

A node is a number of rows read and a state of the role grammar `(s?(ua)+)?`; an
arc is an edit. Forward least costs come from the start and backward ones from
the end; an arc is tight if the two and its own cost make the least total, and
the tight arcs are all cheapest repairs. The traversal carries the set of nodes
that the letters so far lead to and takes the least letter of their tight arcs.

Rows are sorted by conversation and turn over the whole table. A conversation
that lies within one partition is repaired there. One that is cut, or fills
many partitions, is repaired in runs: each run gives its 4 x 4 least costs, these
are joined by conversation, each run's tight arcs follow from the costs of what
comes after it, and the runs' letters and lines are joined in their order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlake.llm.shared import Scratch

FAR = 1 << 60
STATES = range(4)
#: What the rows so far spell: nothing, s, (s)(ua)*u, (s)(ua)+. The first and the last are whole.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
WHOLE = (0, 3)
SPEAKER = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
COST = {"delete": 4, "insert": 3, "rerole": 3, "truncated": 3}
SPACE = " \t\n\x0b\x0c\r"

Row = tuple[str, str, str, int]  # role, text, fault, copies


def fault_of(text: str) -> str:
    """blank, truncated or nothing."""
    t = text.rstrip(SPACE)
    return BLANK if not t else "" if t[-1] in ".!?" else TRUNCATED


def steps(role: str, fault: str) -> list[tuple[str, int, int, int, str]]:
    """Arcs that read a row: letter, state before, state after, cost and the role written (empty: none)."""
    out = [("D", q, q, COST["delete"], "") for q in STATES]
    if fault in (BLANK, DUPLICATE):
        return out
    more = COST["truncated"] if fault == TRUNCATED else 0
    for q in STATES:
        for initial, to in NEXT[q].items():
            if role[:1] == initial:
                out.append(("K", q, to, more, role))
            elif initial in SPEAKER:
                out.append(("R", q, to, more + COST["rerole"], SPEAKER[initial]))
    return out


#: Arcs that read no row.
INSERTS = [("I", q, to, COST["insert"], SPEAKER[c]) for q in STATES for c, to in NEXT[q].items() if c in SPEAKER]


def _inserted(cost: list[int]) -> list[int]:
    """Least costs of a column's states once rows may be inserted; a chain of them is never longer than two."""
    cost = list(cost)
    for _ in range(2):
        for _, q, to, c, _ in INSERTS:
            cost[to] = min(cost[to], cost[q] + c)
    return cost


def _insertable(cost: list[int]) -> list[int]:
    """The same from behind: least costs to the end."""
    cost = list(cost)
    for _ in range(2):
        for _, q, to, c, _ in INSERTS:
            cost[q] = min(cost[q], cost[to] + c)
    return cost


def _arcs(rows: Sequence[Row], known: dict) -> Iterator[list[tuple[str, int, int, int, str]]]:
    """The arcs of each row; further copies of a row are duplicates, or blank as it is."""
    for role, _, fault, copies in rows:
        for k in range(copies):
            key = (role, fault if k == 0 or fault == BLANK else DUPLICATE)
            if key not in known:
                known[key] = steps(*key)
            yield known[key]


def forward(arcs: Sequence[list], start: list[int]) -> list[list[int]]:
    """Least costs of every node from those of the first column."""
    out = [_inserted(start)]
    for row in arcs:
        cost = [FAR] * 4
        for _, q, to, c, _ in row:
            cost[to] = min(cost[to], out[-1][q] + c)
        out.append(_inserted(cost))
    return out


def backward(arcs: Sequence[list], end: list[int]) -> list[list[int]]:
    """Least costs of every node to the end from those of the last column."""
    out = [_insertable(end)]
    for row in reversed(arcs):
        cost = [FAR] * 4
        for _, q, to, c, _ in row:
            cost[q] = min(cost[q], out[-1][to] + c)
        out.append(_insertable(cost))
    return out[::-1]


def traverse(arcs: Sequence[list], ahead: list[list[int]], behind: list[list[int]], start: set[int], last: bool) -> tuple[list[tuple[str, str]], set[int]]:
    """Letters and roles along the least tight path from ``start`` through all rows, and the states that it ends in.

    All nodes of the frontier have read as many rows, as their letters are the same. In the ``last`` run
    rows may be inserted after all others, until a whole state is reached.
    """
    total = min(ahead[0][q] + behind[0][q] for q in start)
    out: list[tuple[str, str]] = []
    i, front = 0, set(start)
    while i < len(arcs) or last:
        if i == len(arcs) and any(q in WHOLE and ahead[i][q] == total for q in front):
            break
        tight = [(letter, False, to, role) for letter, q, to, c, role in INSERTS if q in front and ahead[i][q] + c + behind[i][to] == total]
        if i < len(arcs):
            tight += [(letter, True, to, role) for letter, q, to, c, role in arcs[i] if q in front and ahead[i][q] + c + behind[i + 1][to] == total]
        letter = min(t[0] for t in tight)
        chosen = [t for t in tight if t[0] == letter]
        out.append((letter, chosen[0][3]))
        front = {t[2] for t in chosen}
        i += chosen[0][1]
    return out, front


def written(rows: Sequence[Row], path: Sequence[tuple[str, str]]) -> Iterator[str]:
    """The lines of the repaired rows."""
    texts = (text for _, text, _, copies in rows for _ in range(copies))
    for letter, role in path:
        if letter == "I":
            yield f"{role}:"
        else:
            text = next(texts)
            if letter != "D":
                yield f"{role}:{text}"


def repair(rows: Sequence[Row]) -> tuple[int, str, Iterator[str]]:
    """Least cost, letters and lines of a whole conversation."""
    arcs = list(_arcs(rows, {}))
    ahead, behind = forward(arcs, [0, FAR, FAR, FAR]), backward(arcs, [0 if q in WHOLE else FAR for q in STATES])
    path, _ = traverse(arcs, ahead, behind, {0}, True)
    return behind[0][0], "".join(letter for letter, _ in path), written(rows, path)


def measures(rows: Sequence[Row]) -> tuple[int, int, int, int]:
    """Counts of blank, duplicate and truncated rows and of illegal neighbours."""
    count = {BLANK: 0, DUPLICATE: 0, TRUNCATED: 0, "": 0}
    illegal, last = 0, None
    for role, _, fault, copies in rows:
        count[fault] += 1
        count[BLANK if fault == BLANK else DUPLICATE] += copies - 1
        illegal += (last is not None and last + role[:1] not in LEGAL) + (copies - 1) * (role[:1] * 2 not in LEGAL)
        last = role[:1]
    return count[BLANK], count[DUPLICATE], count[TRUNCATED], illegal


def span_of(turns: Sequence[int | None]) -> tuple[int | None, int | None, int]:
    """Least, greatest and number of distinct turns; nulls are left out, equal turns stand together."""
    known = [t for t in turns if t is not None]
    return (known[0], known[-1], sum(a != b for a, b in zip(known, [None, *known], strict=False))) if known else (None, None, 0)


DONE = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
OPEN = "conv_id long, run long, at long, turn long, role string, text string, copies long"
_DONE = [(c.split()[0], pa.string() if "string" in c else pa.int64()) for c in DONE.split(", ")]
_OPEN = [(c.split()[0], pa.string() if "string" in c else pa.int64()) for c in OPEN.split(", ")]
_ALL = pa.schema([("whole", pa.bool_()), *_OPEN, *_DONE])


def _solved(conv: int | None, rows: list[tuple]) -> dict:
    """Result of a conversation of (turn, role, text, copies) in order."""
    seen: set[tuple[str, str]] = set()
    full: list[Row] = []
    for _, role, text, copies in rows:
        fault = fault_of(text)
        full.append((role, text, DUPLICATE if fault != BLANK and (role, text) in seen else fault, copies))
        seen.add((role, text))
    low, high, distinct = span_of([r[0] for r in rows])
    cost, audit, lines = repair(full)
    found = (high - low + 1 - distinct if distinct else 0, *measures(full), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return {"whole": True, "conv_id": conv, **dict(zip([c for c, _ in _DONE], found, strict=True))}


def _by_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations' results; rows of the first and the last conversation of a partition, which may go on elsewhere."""
    run, at = TaskContext.get().partitionId(), 0
    first, conv, rows, out = True, object(), [], []

    def open_rows() -> list[dict]:
        nonlocal at
        found = [{"whole": False, "conv_id": conv, "run": run, "at": at + k, "turn": t, "role": role, "text": text, "copies": n} for k, (t, role, text, n) in enumerate(rows)]
        at += len(found)
        return found

    for batch in batches:
        for c, *row in zip(*[x.to_pylist() for x in batch.columns], strict=True):
            if c != conv and rows:
                out += open_rows() if first else [_solved(conv, rows)]
                first, rows = False, []
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist(out, _ALL)
                    out = []
            conv = c
            rows.append(tuple(row))
    while rows:  # in parts, as a run may fill the partition
        held, rows = rows[1000:], rows[:1000]
        out += open_rows()
        yield pa.RecordBatch.from_pylist(out, _ALL)
        out, rows = [], held
    if out:
        yield pa.RecordBatch.from_pylist(out, _ALL)


def _run_rows(t: pa.Table) -> tuple[list[Row], list]:
    t = t.sort_by("at")
    role, text, copies, turn, seen = (t.column(c).to_pylist() for c in ("role", "text", "copies", "turn", "seen"))
    rows = []
    for r, x, n, s in zip(role, text, copies, seen, strict=True):
        fault = fault_of(x)
        rows.append((r, x, DUPLICATE if fault != BLANK and s else fault, n))
    return rows, turn


COSTS = ", ".join(f"c{q}{to} long" for q in STATES for to in STATES)
RUN = f"conv_id long, run long, {COSTS}, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, first string, last string"


def _costs(key: tuple, t: pa.Table) -> pa.Table:
    """A run's least costs from each state before it to each after it, and its counts."""
    rows, turns = _run_rows(t)
    arcs = list(_arcs(rows, {}))
    out = {"conv_id": key[0].as_py(), "run": key[1].as_py()}
    for q in STATES:
        end = forward(arcs, [0 if x == q else FAR for x in STATES])[-1]
        out |= {f"c{q}{to}": min(end[to], FAR) for to in STATES}
    out |= dict(zip(("low", "high", "turns"), span_of(turns), strict=True)) | dict(zip(("blank", "duplicate", "truncated", "illegal"), measures(rows), strict=True))
    return pa.Table.from_pylist([out | {"first": rows[0][0][:1], "last": rows[-1][0][:1]}], pa.schema([(c.split()[0], pa.string() if "string" in c else pa.int64()) for c in RUN.split(", ")]))


PLAN = "conv_id long, run long, is_last boolean, e0 long, e1 long, e2 long, e3 long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _plan(key: tuple, t: pa.Table) -> pa.Table:
    """For each run of a conversation the least costs from its end on; the conversation's counts. A row a run."""
    runs = sorted(t.to_pylist(), key=lambda r: r["run"])
    # Rows that are inserted at a border belong to the run after it: the last column's costs are from its states as they are.
    end = _insertable([0 if q in WHOLE else FAR for q in STATES])
    ends = [[0 if q in WHOLE else FAR for q in STATES]]
    for r in reversed(runs):
        end = [min(FAR, *(r[f"c{q}{to}"] + end[to] for to in STATES)) for q in STATES]
        ends.append(end)
    ends = ends[-2::-1]
    low = next((r["low"] for r in runs if r["low"] is not None), None)
    high, turns = None, 0
    for r in runs:
        if r["low"] is not None:
            turns += r["turns"] - (high == r["low"])
            high = r["high"]
    total = {k: sum(r[k] for r in runs) for k in ("blank", "duplicate", "truncated", "illegal")}
    total["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(runs, runs[1:], strict=False))
    total |= {"gaps": high - low + 1 - turns if turns else 0, "cost": end[0]}
    out = [{"conv_id": key[0].as_py(), "run": r["run"], "is_last": r is runs[-1], **{f"e{q}": e[q] for q in STATES}, **total} for r, e in zip(runs, ends, strict=True)]
    return pa.Table.from_pylist(out, pa.schema([(c.split()[0], pa.bool_() if "boolean" in c else pa.int64()) for c in PLAN.split(", ")]))


def _paths(rows: list[Row], plan: dict, starts: Sequence[int]) -> Iterator[tuple[int, list[tuple[str, str]], set[int]]]:
    """The least tight path of a run from each of the states ``starts``: state, path, states after it."""
    arcs = list(_arcs(rows, {}))
    behind = backward(arcs, [plan[f"e{q}"] for q in STATES])
    if not plan["is_last"]:  # what is inserted at the border is the next run's
        cost = [plan[f"e{q}"] for q in STATES]
        behind = [*backward(arcs, cost)[:-1], cost]
    for q in starts:
        if behind[0][q] < FAR:
            path, end = traverse(arcs, forward(arcs, [0 if x == q else FAR for x in STATES]), behind, {q}, plan["is_last"])
            yield q, path, end


LETTERS = "conv_id long, run long, start long, end long, letters string"


def _letters(key: tuple, t: pa.Table, plan: pa.Table) -> pa.Table:
    """A run's letters from each state before it."""
    rows, _ = _run_rows(t)
    out = [{"conv_id": key[0].as_py(), "run": key[1].as_py(), "start": q, "end": min(end), "letters": "".join(x for x, _ in path)} for q, path, end in _paths(rows, plan.to_pylist()[0], STATES)]
    return pa.Table.from_pylist(out, pa.schema([(c.split()[0], pa.string() if "string" in c else pa.int64()) for c in LETTERS.split(", ")]))


def _linked(key: tuple, t: pa.Table) -> pa.Table:
    """The state in which each run of a conversation begins, and on its first run all letters."""
    by_run: dict[int, dict[int, dict]] = {}
    for r in t.to_pylist():
        by_run.setdefault(r["run"], {})[r["start"]] = r
    state, starts, letters = 0, [], []
    for run in sorted(by_run):
        starts.append((run, state))
        letters.append(by_run[run][state]["letters"])
        state = by_run[run][state]["end"]
    audit = [["".join(letters)], [None] * (len(starts) - 1)]
    return pa.table({"conv_id": pa.array([key[0].as_py()] * len(starts), pa.int64()), "run": pa.array([r for r, _ in starts], pa.int64()), "start": pa.array([s for _, s in starts], pa.int64()), "audit": pa.array(audit[0] + audit[1], pa.string())})


def _lines(key: tuple, t: pa.Table, plan: pa.Table) -> pa.Table:
    """A run's repaired lines, as one piece of bytes, each line but a conversation's first after a line end."""
    rows, _ = _run_rows(t)
    own = plan.to_pylist()[0]
    lines = [line for _, path, _ in _paths(rows, own, [own["start"]]) for line in written(rows, path)]
    data = "".join(f"\n{x}" for x in lines).encode()
    return pa.table({"conv_id": pa.array([key[0].as_py()], pa.int64()), "run": pa.array([key[1].as_py()], pa.int64()), "data": pa.array([data], pa.binary())})


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each conversation's pieces, which come in order; only its state is held."""
    conv, own, blank = object(), None, True
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    for batch in batches:
        out = []
        for c, data in zip(batch.column("conv_id").to_pylist(), batch.column("data"), strict=True):
            if c != conv:
                if own is not None:
                    out.append({"conv_id": conv, "repaired_sha256": own.hexdigest()})
                conv, own, blank = c, hashlib.sha256(), True
            data = data.as_py()
            own.update(data[1:] if blank else data)
            blank = blank and not data
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    if own is not None:
        yield pa.RecordBatch.from_pylist([{"conv_id": conv, "repaired_sha256": own.hexdigest()}], schema)


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """conv_id, turn, role, text of a table's rows after a damage that a hash of conversation and turn picks, with copies.

    Of 20 cases 0 drops the row, 1 empties its text, 2 takes its full stops,
    exclamation and question marks, 3 repeats it, 4 gives it to the user. Null
    roles and texts, and nulls in the hashed key, count as one space.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = (F.crc32(F.concat(text(conv), F.lit(":"), text(turn)).cast("binary")) % 20).alias("case")
    src = rows.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), case).where("case <> 0")
    changed: Column = F.when(F.col("case") == 1, F.lit("")).when(F.col("case") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return src.select("conv_id", "turn", F.when(F.col("case") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), changed.alias("text"), F.when(F.col("case") == 3, 2).otherwise(1).cast("long").alias("copies"))


def repair_conversations(rows: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row per conv_id with rows: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows`` has conv_id, turn, role, text, none but the first two null, and
    copies (how often the row stands, one after the other). Rows are taken by
    turn, nulls first, ties by role and text. A null conv_id is a conversation.
    No rows give none. What is held at once is a conversation's part of one
    partition; a conversation's letters, as they are one value of the result;
    and of its lines only the state of their digest, which is taken in order.
    """
    spark, scratch = rows.sparkSession, scratch or Scratch(rows.sparkSession)
    once = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    parted = once.repartitionByRange(*order[:3], F.substring("text", 1, 64)).sortWithinPartitions(*order)
    both = scratch.write(parted.mapInArrow(_by_partition, f"whole boolean, {OPEN}, {DONE}"), "both")
    names = [c for c, _ in _DONE]
    whole = both.where("whole").select("conv_id", *names)
    cut = both.where("not whole").select(*[c for c, _ in _OPEN])
    # A row has been seen if one of its role and text stands at an earlier turn; rows of one turn differ.
    key = ["conv_id", "role", "digest"]
    cut = cut.withColumn("digest", F.md5("text"))
    first = cut.groupBy(*key).agg(F.min(F.struct("turn")).alias("first"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
    marked = cut.alias("a").join(first.alias("b").hint("merge"), same).select(*[f"a.{c}" for c, _ in _OPEN], (~F.col("a.turn").eqNullSafe(F.col("b.first.turn"))).alias("seen"))
    marked = scratch.write(marked, "marked")
    by_run = marked.groupBy("conv_id", "run")
    plan = scratch.write(by_run.applyInArrow(_costs, RUN).groupBy("conv_id").applyInArrow(_plan, PLAN), "plan")
    letters = by_run.cogroup(plan.groupBy("conv_id", "run")).applyInArrow(_letters, LETTERS)
    linked = scratch.write(letters.groupBy("conv_id").applyInArrow(_linked, "conv_id long, run long, start long, audit string"), "linked")
    starts = plan.join(linked.drop("audit").hint("merge"), [plan.conv_id.eqNullSafe(linked.conv_id), plan.run == linked.run]).select(plan["*"], "start")
    lines = by_run.cogroup(starts.groupBy("conv_id", "run")).applyInArrow(_lines, "conv_id long, run long, data binary")
    hashes = lines.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), "run").mapInArrow(_hashed, "conv_id long, repaired_sha256 string")
    parts = [
        plan.where("is_last").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", F.lit(None).cast("string").alias("audit"), F.lit(None).cast("string").alias("repaired_sha256")),
        linked.where("audit is not null").select("conv_id", *[F.lit(None).cast("long").alias(c) for c in names[:6]], "audit", F.lit(None).cast("string").alias("repaired_sha256")),
        hashes.select("conv_id", *[F.lit(None).cast("long").alias(c) for c in names[:6]], F.lit(None).cast("string").alias("audit"), "repaired_sha256"),
    ]
    done = parts[0].union(parts[1]).union(parts[2]).groupBy("conv_id").agg(*[F.max(c).alias(c) for c in names])
    return whole.union(done)


def audit_damaged(rows: DataFrame) -> DataFrame:
    """Damages a table of conversations and repairs it: a row for every conv_id, as ``repair_conversations`` gives.

    A conversation of which no row is left has zeros, no letters and the digest
    of nothing. Other columns do not matter.
    """
    scratch = Scratch(rows.sparkSession)
    found = repair_conversations(damaged(rows), scratch)
    every = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().alias("e")
    out = every.join(found.alias("f").hint("merge"), F.col("e.conv_id").eqNullSafe(F.col("f.conv_id")), "left")
    nothing = {c: F.lit(hashlib.sha256().hexdigest() if c == "repaired_sha256" else "") if kind == pa.string() else F.lit(0).cast("long") for c, kind in _DONE}
    return out.select("e.conv_id", *[F.coalesce(F.col(f"f.{c}"), x).alias(c) for c, x in nothing.items()])
