"""The repair of conversations against a search of all edits, in one and in many runs."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

SPACE = " \t\n\x0b\x0c\r"
NOTHING = hashlib.sha256().hexdigest()


def by_search(rows):
    """Least cost, letters and lines by a search in order of cost and letters over all edits of (role, text, fault)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, letters, i, said, lines = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", said):
            return cost, letters, lines
        key = (i, re.sub("(ua)+", "ua", said[-3:]) if said else "", bool(said))
        if (key, letters) in done or cost > 4 * len(rows):
            continue
        done.add((key, letters))
        fits = lambda c: re.fullmatch("s|s?(ua)*u?", said + c) is not None
        for role in ("user", "assistant"):
            if fits(role[0]) and len(letters) < 2 * len(rows) + 2:
                heapq.heappush(heap, (cost + 3, letters + "I", i, said + role[0], (*lines, f"{role}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, letters + "D", i + 1, said, lines))
            if fault in ("", "truncated"):
                more = 3 * (fault == "truncated")
                if role and fits(role[0]):
                    heapq.heappush(heap, (cost + more, letters + "K", i + 1, said + role[0], (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if fits(new[0]):
                        heapq.heappush(heap, (cost + more + 3, letters + "R", i + 1, said + new[0], (*lines, f"{new}:{text}")))
    raise AssertionError


def expected(table):
    convs = {}
    for conv, turn, role, text in table:
        own = convs.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if case == 0:
            continue
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        own += [(turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, rows = set(), []
        for _, role, text in own:
            bare = text.rstrip(SPACE)
            rows.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"))
            seen.add((role, text))
        turns = {t for t, *_ in own if t is not None}
        cost, letters, lines = by_search(rows)
        faults = [f for *_, f in rows]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def found(df):
    rows = df.collect()
    out = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(out) == len(rows)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def small_table(rng, convs, turns):
    texts = ["Yes.", "No?", "Well", "", " \n", "A b c!", "Ça va.", "…", "ends\x85", None]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    return [(c, rng.choice([t, t, t, t + 1, None]), rng.choice(roles), rng.choice(texts)) for c in convs for t in range(rng.randrange(turns))]


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_matches_a_search_of_all_edits(spark, partitions):
    from wattlake.llm.conversations import audit_damaged

    rng = random.Random(7)
    table = small_table(rng, [None, *range(60)], 7) + [(1000, None, "user", "Hi.")] * 3
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert found(audit_damaged(frame(spark, table))) == expected(table)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_conversation_over_many_partitions(spark):
    """One run gives what many runs give, where a search of all edits would take too long."""
    from wattlake.llm import conversations as c

    rng = random.Random(8)
    table = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["One.", "Two?", "Three", "", f"{t}."])) for t in range(3000)]
    rows = []
    seen = set()
    for _, _, role, text in table:
        fault = c.fault_of(text)
        rows.append((role, text, c.DUPLICATE if fault != c.BLANK and (role, text) in seen else fault, 1))
        seen.add((role, text))
    cost, audit, lines = c.repair(rows)
    want = (0, *c.measures(rows), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = found(c.repair_conversations(frame(spark, table).selectExpr("*", "1L AS copies")))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got == {1: want}


def test_repair_against_search_on_random_rows():
    from wattlake.llm.conversations import repair

    rng = random.Random(9)
    for _ in range(400):
        rows = [(rng.choice(["user", "assistant", "system", "x"]), f"t{k}", rng.choice(["", "", "", "blank", "duplicate", "truncated"])) for k in range(rng.randrange(7))]
        cost, audit, lines = repair([(*r, 1) for r in rows])
        assert (cost, audit, tuple(lines)) == by_search(rows), rows


def test_edges(spark):
    from wattlake.llm.conversations import audit_damaged

    assert audit_damaged(frame(spark, [])).collect() == []
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    kept = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 > 4)
    long = "word " * 400_000 + "."
    table = [(dropped, 0, "user", "Gone."), (kept, 0, "user", long)]
    got = found(audit_damaged(frame(spark, table).selectExpr("*", "1 AS copies", "'x' AS at", "true AS whole", "2 AS run")))
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", NOTHING)
    assert got[kept] == (0, 0, 0, 0, 0, 3, "KI", hashlib.sha256(f"user:{long}\nassistant:".encode()).hexdigest())
    # Repeated rows of one turn are told apart only by their number.
    many = [(kept, 0, "user", "Again.")] * 500
    assert found(audit_damaged(frame(spark, many)))[kept] == (0, 0, 499, 0, 499, 4 * 499 + 3, "K" + "D" * 499 + "I", hashlib.sha256(b"user:Again.\nassistant:").hexdigest())
