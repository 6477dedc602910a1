"""Conversation structure repair by signature deduplication.

A conversation is its rows by turn. A row's fault is the first of blank (no character but blanks), duplicate (role and
text were seen earlier) and truncated (the last character that is no blank is not one of `.!?`). Edits keep a row, give it
the role user or assistant, delete it, or insert an empty row of user or assistant, so that the initials of the roles read
`(s?(ua)+)?`; blank and duplicate rows must go, and a truncated row that stays costs extra.

1. Rows are dealt by conversation and streamed in order: a row becomes one character of its conversation's signature, which
   tells all that the cost depends on (initial, must go, truncated). Texts are not part of it.
2. Conversations that share a signature share their edits: each distinct signature is solved once, by recursion over (rest of
   the signature, state of the grammar) with memoised results, and its audit string joins back.
3. Rows are streamed once more, each conversation's audit before them, and the edits are replayed into a running hash.

An audit holds a character a row, and a hash is taken in order, so a conversation passes through one task; but as a stream out of a
sort that spills: what is held in memory of a conversation is its signature, one byte a row. The join of audits is salted.

Defined cases: null roles and texts are one space, as are null ids and turns in the damage rule; null turns come first; rows
of equal turn go by role, then text, both compared by bytes; a null conv_id is a conversation of its own; rows may repeat (one of them stays, the
others are duplicates); a role's initial is its first character, and one other than s, u and a fits nowhere; if several edits cost the
same, the audit that is least by ASCII counts (D, I, K, R); conversations of which no row is left have zeros, an empty audit and the empty
text's hash; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import lean
from .common import attach, crc32_text, materialise, small_batches

#: Blank characters.
BLANKS = " \t\n\x0b\f\r"
#: Costs of the edits; TRUNCATED is added for a truncated row that is not deleted.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States of the grammar: nothing yet, after s, after u, after a. `(s?(ua)+)?` may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: The state that user or assistant, whichever may come next, leads to.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Rows of a signature that one recursion goes through at most.
DEPTH = 200


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with nulls of role and text filled, rows damaged by crc32(conv_id:turn) % 20, and `gone` for dropped rows.

    0 drops the row, 1 empties its text, 2 removes `.!?`, 3 repeats it, 4 sets the role user.
    """
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.col("kind")
    r = rows.select("conv_id", "turn", filled[2].alias("role"), filled[3].alias("text"), (crc32_text(F.concat(filled[0], F.lit(":"), filled[1])) % 20).alias("kind"))
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    r = r.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (kind == 0).alias("gone"), F.when(kind == 3, 2).otherwise(1).alias("copies"))
    return r.withColumn("copies", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).drop("copies")


def faults(rows: DataFrame) -> DataFrame:
    """Rows with their initial (s, u, a or o) and fault (b, d, t or none), in partitions by conversation, in order."""
    ends = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    seen = Window.partitionBy("conv_id", "role", "text", "gone").orderBy(F.col("turn").asc_nulls_first())
    fault = F.when(ends == "", "b").when(F.row_number().over(seen) > 1, "d").when(~F.substring(ends, -1, 1).isin(".", "!", "?"), "t").otherwise("")
    r = rows.repartition("conv_id").select("*", F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"), fault.alias("fault"))
    return in_order(r)


def in_order(rows: DataFrame, *first: str) -> DataFrame:
    """Sorted by conversation and turn; of equal rows the first is the one that is no duplicate."""
    last = [F.col("fault") == "d"] if "fault" in rows.columns else []
    return rows.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *first, F.col("turn").asc_nulls_first(), "role", "text", *last)


def code(initial: str, fault: str) -> str:
    """A row's character in a signature: x must go, capitals are truncated."""
    return "x" if fault in ("b", "d") else initial.upper() if fault == "t" else initial


class _Open:
    """What is known of the conversation whose rows are passing."""

    def __init__(self, conv: object):
        self.conv, self.low, self.high, self.turns, self.last = conv, None, None, 0, None
        self.count = {"b": 0, "d": 0, "t": 0, "": 0}
        self.illegal, self.before, self.signature = 0, "", bytearray()

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        self.count[fault] += 1
        self.illegal += bool(self.before) and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        self.signature += code(initial, fault).encode()

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv, gaps, self.count["b"], self.count["d"], self.count["t"], self.illegal, self.signature.decode()


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]


def signatures(rows: DataFrame) -> DataFrame:
    """Rows of `faults` -> one row a conversation: its counts and its signature."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: _Open | None = None
        schema = None

        def table(done: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            return pa.record_batch([pa.array(columns[0], schema), *(pa.array(c, pa.int64()) for c in columns[1:6]), pa.array(columns[6], pa.string())], ["conv_id", *_COUNTS, "signature"])

        for b in batches:
            schema, done = b.schema.field(0).type, []
            for conv, turn, initial, fault, gone in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if open_ is None or conv != open_.conv:
                    if open_ is not None:
                        done.append(open_.row())
                    open_ = _Open(conv)
                if not gone:
                    open_.add(turn, initial, fault)
            if done:
                yield table(done)
        if open_ is not None:
            yield table([open_.row()])

    narrow = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "initial", "fault", "gone")
    return narrow.mapInArrow(run, f"conv_id {kind}, {', '.join(f'{c} long' for c in _COUNTS)}, signature string")


def solve(signature: str) -> tuple[int, str]:
    """The least cost of edits that repair a signature, and their initials; of equal ones the least by ASCII.

    From a state each edit leads to one state, and the edits' letters differ, so of equal costs the first letter decides.
    """
    memo: dict[tuple[int, int], tuple[int, str, int]] = {}

    def best(at: int, state: int, inserts: int = 2) -> tuple[int, str, int]:
        """(cost of the rest, letter of the first edit, state after it); more than two inserts in a row never pay."""
        known = memo.get((at, state)) if inserts == 2 else None
        if known:
            return known
        found = []
        if at == len(signature):
            if state in ENDS:
                found.append((0, "", state))
        else:
            row = signature[at]
            found.append((DELETE + best(at + 1, state)[0], "D", state))
            if row != "x":
                extra, initial = TRUNCATED * row.isupper(), row.lower()
                to = SYSTEM if initial == "s" and state == START else NEXT[state] if initial == ROLES[NEXT[state]][0] else None
                if to is not None:
                    found.append((KEEP + extra + best(at + 1, to)[0], "K", to))
                found.append((REROLE + extra + best(at + 1, NEXT[state])[0], "R", NEXT[state]))
        if inserts:
            rest = best(at, NEXT[state], inserts - 1)[0]
            found.append((INSERT + rest, "I", NEXT[state]))
        out = min(found, default=(1 << 60, "", state))
        if inserts == 2:
            memo[at, state] = out
        return out

    for at in range(len(signature), 0, -DEPTH):  # the end first, so that no recursion goes deeper than DEPTH rows
        for state in range(4):
            best(at, state)
    cost, letters, at, state = best(0, START)[0], [], 0, START
    while True:
        _, letter, to = best(at, state)
        if not letter:
            return cost, "".join(letters)
        letters.append(letter)
        at, state = at + (letter != "I"), to


def solved(signatures: DataFrame) -> DataFrame:
    """Distinct signatures with cost and audit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [solve(s) for s in b.column(0).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], ["signature", "cost", "audit"])

    return signatures.select("signature").distinct().mapInArrow(run, "signature string, cost long, audit string")


def replayed(rows: DataFrame, audits: DataFrame, texts: bool = False) -> DataFrame:
    """Damaged rows and (conv_id, counts, cost, audit) -> one row a conversation, with the hash of its repaired text; or,
    with `texts`, the repaired rows themselves: conv_id, position (from 0), role, text."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = [*_COUNTS, "cost", "audit"]
    nothing = [F.lit(None).cast(audits.schema[c].dataType).alias(c) for c in names]
    left = rows.where("not gone").select("conv_id", F.lit(1).alias("what"), "turn", "role", "text", *nothing)
    heads = audits.select("conv_id", F.lit(0).alias("what"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), *names)
    both = in_order(heads.unionByName(left).repartition("conv_id"), "what").drop("turn")
    fields = {"conv_id": kind} | ({"position": "long", "role": "string", "text": "string"} if texts else {c: "string" if c == "audit" else "long" for c in names} | {"repaired_sha256": "string"})

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: tuple | None = None
        replay: Replay | None = None
        done: list[tuple] = []
        kinds: list[pa.DataType] = []

        def say(role: str, text: str) -> None:
            done.append((head[0], replay.said, role, text))

        def close() -> None:
            if head is not None:
                digest = replay.end()
                if not texts:
                    done.append((*head, digest))

        def table() -> pa.RecordBatch:
            out = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)]
            done.clear()
            return pa.record_batch(out, list(fields))

        for b in batches:
            kinds = [b.schema.field(0).type, *(pa.string() if t == "string" else pa.int64() for t in list(fields.values())[1:])]
            about = [b.column(i) for i in (0, *range(4, 11))]
            for i, (what, role, text) in enumerate(zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)):
                if what == 0:
                    close()
                    head = tuple(a[i].as_py() for a in about)
                    replay = Replay(head[-1], say if texts else None)
                else:
                    replay.row(role, text)
            if done:
                yield table()
        close()
        if done:
            yield table()

    return both.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in fields.items()))


class Replay:
    """Edits applied to rows as they come; `emit` takes the repaired rows, otherwise they are hashed."""

    def __init__(self, audit: str, emit: Callable[[str, str], None] | None = None):
        self.audit, self.at, self.state, self.said = audit, 0, START, 0
        self.hash, self.emit = hashlib.sha256(), emit or self._hashed

    def _hashed(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.said else ''}{role}:{text}".encode())

    def _say(self, role: str, text: str) -> None:
        self.emit(role, text)
        self.said += 1

    def _inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at, self.state = self.at + 1, NEXT[self.state]
            self._say(ROLES[self.state], "")

    def row(self, role: str, text: str) -> None:
        self._inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = SYSTEM if role[0] == "s" else NEXT[self.state]
            self._say(role, text)
        elif letter == "R":
            self.state = NEXT[self.state]
            self._say(ROLES[self.state], text)

    def end(self) -> str:
        self._inserted()
        return self.hash.hexdigest()


def audited(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) -> conv_id, counts, cost, audit: one row a conversation."""
    small_batches(rows.sparkSession)
    found = materialise(signatures(faults(rows)), "conversations-signatures")
    return attach(found, solved(found), ["signature"], F.col("conv_id")).drop("signature")


def repair(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) -> conv_id, counts, cost, audit, repaired_sha256."""
    return replayed(rows, audited(rows))


def repaired_rows(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) -> the rows of the repaired conversations: conv_id, position, role, text."""
    return replayed(rows, audited(rows), texts=True)


def sql() -> str:
    """DuckDB: the damage, the faults, the cheapest edits by recursion over each signature from its end, and their replay."""
    least = "list_sort([{}])[1]"
    pair = "{{'c': {}, 'a': '{}' || {}}}"
    edit = lambda letter, cost, rest: pair.format(f"{cost} + {rest}.c", letter, f"{rest}.a")
    kept = {0: ["CASE WHEN lower(ch) = 's' THEN f1 WHEN lower(ch) = 'u' THEN f2 END"], 1: ["CASE WHEN lower(ch) = 'u' THEN f2 END"], 2: ["CASE WHEN lower(ch) = 'a' THEN f3 END"], 3: ["CASE WHEN lower(ch) = 'u' THEN f2 END"]}
    # own edit of a row in each state, then up to two inserts before it
    g = ", ".join(
        least.format(", ".join([edit("D", DELETE, f"f{q}"), f"CASE WHEN ch <> 'x' THEN {edit('R', f'{REROLE} + extra', f'f{NEXT[q]}')} END", f"CASE WHEN ch <> 'x' AND ({kept[q][0]}) IS NOT NULL THEN {edit('K', 'extra', f'({kept[q][0]})')} END"])) + f" AS g{q}"
        for q in range(4)
    )
    inserted = ", ".join(least.format(f"g{q}, {edit('I', INSERT, f'g{NEXT[q]}')}, {edit('II', 2 * INSERT, f'g{NEXT[NEXT[q]]}')}") + f" AS f{q}" for q in range(4))
    return f"""WITH RECURSIVE crc_of_byte AS MATERIALIZED (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS of FROM range(256) r(b)),
filled AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT) AS key FROM conversations),
kinds AS (SELECT conv_id, turn, role, text,
  xor(list_reduce(list_prepend(4294967295, key), lambda c, b: xor(c >> 8, of[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM filled CROSS JOIN crc_of_byte),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM kinds JOIN (SELECT unnest([1, 2]) AS copy) ON copy = 1 OR kind = 3 WHERE kind <> 0),
placed AS (SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ends,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM damaged),
faulty AS (SELECT conv_id, turn, role, text,
  CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS initial,
  CASE WHEN ends = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(ends, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM placed),
ordered AS MATERIALIZED (SELECT *, row_number() OVER w AS i, lag(initial) OVER w || initial AS two,
  CASE WHEN fault IN ('b', 'd') THEN 'x' WHEN fault = 't' THEN upper(initial) ELSE initial END AS ch
  FROM faulty WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, fault = 'd')),
counted AS MATERIALIZED (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
  count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal, string_agg(ch, '' ORDER BY i) AS signature FROM ordered GROUP BY conv_id),
steps AS (
  SELECT signature, length(signature) AS pos, {{'c': 0, 'a': ''}} AS f0, {{'c': {2 * INSERT}, 'a': 'II'}} AS f1, {{'c': {INSERT}, 'a': 'I'}} AS f2, {{'c': 0, 'a': ''}} AS f3
  FROM (SELECT DISTINCT signature FROM counted)
  UNION ALL
  SELECT signature, pos - 1, {inserted}
  FROM (SELECT signature, pos, {g} FROM (SELECT *, signature[pos] AS ch, CASE WHEN signature[pos] BETWEEN 'A' AND 'Z' THEN {TRUNCATED} ELSE 0 END AS extra FROM steps WHERE pos > 0))),
audits AS MATERIALIZED (SELECT conv_id, f0.c AS cost, f0.a AS audit FROM counted JOIN steps USING (signature) WHERE pos = 0),
replay AS (
  SELECT conv_id, audit, 0 AS k, 0 AS i, 's' AS state, []::VARCHAR[] AS said FROM audits
  UNION ALL
  SELECT r.conv_id, audit, k + 1, CASE e WHEN 'I' THEN r.i ELSE r.i + 1 END, CASE WHEN e = 'D' THEN state WHEN e = 'K' AND o.initial = 's' THEN 's' ELSE next END,
    CASE e WHEN 'D' THEN said WHEN 'K' THEN list_append(said, o.role || ':' || o.text) ELSE list_append(said, full_role || ':' || CASE e WHEN 'R' THEN o.text ELSE '' END) END
  FROM (SELECT *, audit[k + 1] AS e, CASE state WHEN 'u' THEN 'a' ELSE 'u' END AS next, CASE state WHEN 'u' THEN 'assistant' ELSE 'user' END AS full_role FROM replay WHERE k < length(audit)) r
  LEFT JOIN ordered o ON o.conv_id IS NOT DISTINCT FROM r.conv_id AND o.i = r.i + 1)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(s.audit, '') AS audit,
  sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN audits s ON s.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN replay r ON r.conv_id IS NOT DISTINCT FROM a.conv_id AND k = length(r.audit)"""
