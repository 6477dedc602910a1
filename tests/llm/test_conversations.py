import hashlib
import heapq
import itertools
import zlib

import pytest

from siltstone.llm import conversations as cv


def cheapest(signature):
    """Least (cost, audit) over all edits, by search over (row, grammar state), whole strings compared."""
    best, heap = {}, [(0, "", 0, "")]
    legal = lambda roles: roles == "" or (roles[1:] if roles[0] == "s" else roles) == ("ua" * len(roles))[: len(roles) - (roles[0] == "s")]
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        if i == len(signature) and (roles == "" or (legal(roles) and roles[-1] == "a")):
            return cost, audit
        if best.setdefault((i, roles[-1:], audit), cost) < cost or len(audit) > 2 * len(signature) + 3:
            continue
        moves = [("I", 3, i, r) for r in "ua"]
        if i < len(signature):
            ch = signature[i]
            moves.append(("D", 4, i + 1, ""))
            if ch != "x":
                extra = 3 * ch.isupper()
                moves += [("R", 3 + extra, i + 1, r) for r in "ua"] + [("K", extra, i + 1, ch.lower())] * (ch.lower() in "sua")
        for letter, c, j, r in moves:
            if legal(roles + r):
                heapq.heappush(heap, (cost + c, audit + letter, j, roles + r))
    raise AssertionError


def test_solve_is_cheapest_and_least():
    for n in range(4):
        for s in itertools.product("suaoxUSA", repeat=n):
            assert cv.solve("".join(s)) == cheapest("".join(s)), s


def test_long_signatures():
    assert cv.solve("ua" * 20_000) == (0, "KK" * 20_000)
    cost, audit = cv.solve("x" * 5001)
    assert cost == 4 * 5001 and audit == "D" * 5001
    assert cv.solve("u" * 3000)[0] == 3 * 3000 - 3 * 1500


def brute(rows):
    crc = lambda *p: zlib.crc32(":".join(" " if x is None else str(x) for x in p).encode()) % 20
    convs = {}
    for conv, turn, role, text in rows:
        role, text, kind = " " if role is None else role, " " if text is None else text, crc(conv, turn)
        out = convs.setdefault(conv, [])
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    done = []
    for conv, out in convs.items():
        out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults, signature = set(), [], ""
        for _, role, text in out:
            ends = text.rstrip(" \t\n\x0b\f\r")
            fault = "b" if not ends else "d" if (role, text) in seen else "t" if ends[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            signature += cv.code(role[:1] if role[:1] and role[:1] in "sua" else "o", fault)
        turns = {t for t, _, _ in out if t is not None}
        pairs = [(a[1][:1] + b[1][:1]) for a, b in zip(out, out[1:], strict=False)]
        cost, audit = cv.solve(signature)
        said, left, before = [], iter(out), ""
        for e in audit:
            _, role, text = ("", "", "") if e == "I" else next(left)
            if e == "D":
                continue
            if e != "K":
                role = "assistant" if before == "u" else "user"
            before = role[0]
            said.append(f"{role}:{text}")
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        done.append((conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest(), said))
    return sorted(done, key=str)


SCHEMA = "conv_id long, turn long, role string, text string, gone string, fault int"


def fixture():
    texts = ["Fine.", "Cut off", "", " \t\r\n\x0b\f", "What? ", "Wait!\n", "é…", " ", ". . ", None]
    roles = ["system", "user", "assistant", "tool", "", "System", None]
    rows = [(c, t, roles[(c * 7 + t * 3 + c // 5) % 7] if (c + t) % 4 else ("user", "assistant")[t % 2], texts[(c * 3 + t * 5) % 10] if (c * t) % 3 else f"Text {c} {t}.") for c in range(120) for t in range(c % 9)]
    rows += [(500, None, "user", "A."), (500, None, "assistant", "B."), (500, 3, "user", "A."), (500, 7, "user", None)]
    rows += [(None, 1, "user", "Of no conversation."), (None, None, None, None), (501, None, "user", "x")]
    rows += [(502, 1, "user", "Same."), (502, 1, "user", "Same."), (502, 1, "assistant", "Same."), (502, 10**12, "assistant", "End.")]
    rows.append((next(c for c in range(600, 900) if zlib.crc32(f"{c}:1".encode()) % 20 == 0), 1, "user", "Dropped."))
    return rows + [(503, t, "user", "One common text.") for t in range(400)] + [(504, 1, "user", "long " * 100_000 + "end.")]


def test_equals_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    damaged = cv.damage(df.repartition(5))
    want = brute(rows)
    assert any(not r[7] for r in want) and {e for r in want for e in r[7]} == set("KRDI")
    assert sorted((tuple(r) for r in cv.repair(damaged).collect()), key=str) == [r[:-1] for r in want]
    texts = {}
    for r in sorted(cv.repaired_rows(damaged).collect(), key=lambda r: r.position):
        assert r.position == len(texts.setdefault(r.conv_id, []))
        texts[r.conv_id].append(f"{r.role}:{r.text}")
    assert texts == {r[0]: r[-1] for r in want if r[-1]}


def test_empty_and_small_batches(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cv.repair(cv.damage(empty)).count() == 0 and cv.repaired_rows(cv.damage(empty)).count() == 0
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 3)  # conversations go over batches
    try:
        rows = [(c, t, ("user", "assistant")[t % 2], f"Text {t}") for c in range(4) for t in range(11)]
        df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
        assert sorted((tuple(r) for r in cv.repair(cv.damage(df)).collect()), key=str) == [r[:-1] for r in brute(rows)]
    finally:
        spark.conf.set(name, before)


@pytest.mark.parametrize("text,blank,truncated", [("a.", 0, 0), ("a. \r", 0, 0), ("a", 0, 1), (" ", 1, 0), ("?!", 0, 0), ("　", 0, 1)])
def test_faults(spark, text, blank, truncated):
    df = spark.createDataFrame([(1, 1, "user", text, False)], "conv_id long, turn long, role string, text string, gone boolean")
    r = cv.signatures(cv.faults(df)).first()
    assert (r.blank, r.truncated) == (blank, truncated)
