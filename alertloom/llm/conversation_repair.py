"""Conversation structure repair by iterative-deepening A*.

A conversation should read: perhaps a system turn, then user and assistant turns in alternation, ending with an answer;
or be empty.  Every row is kept, given another role or deleted, and empty turns may be inserted.  The search runs depth
first over (rows done, last role) in the ASCII order of the edits' initials (D, I, K, R) under a cost bound.  The
heuristic is the cost of the same problem without a condition on the end, summed up from the back.  When no path fits
the bound, the bound becomes the least cost that exceeded it.  States that failed are kept in a transposition table with
the budget they failed with, also over bounds, and are not entered again with less.  As edits are tried in ASCII order
and bounds never pass the least cost, the first accepting path is the cheapest and the least of the cheapest.

Rows meet in the order of their turn by one shuffle on the conversation.  A conversation is streamed: the task keeps a
few bytes per row, and the texts only up to ``held_bytes``.  A longer conversation is read once more, its audit in
front, and its repaired text is hashed as it passes.  The audit and the hash are one value of one row each, so the rows
of one conversation are read by one task; other conversations of its partition wait for it.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from alertloom.llm.rows import arrow_map, as_bytes, fields, sliced
from alertloom.session import stage

# Costs of the edits (fixed values)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
# Last role so far: none, system, user, assistant; and by it the role that may come next besides a leading system turn
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}

_SPACE = b" \t\n\v\f\r"
SOUND, CUT, GONE = range(3)  # a row: good, truncated, or to be deleted


def _after(state: int, initial: str) -> int | None:
    """The state after keeping a row of that role, if it may stand here."""
    return STATE[initial] if initial == NEXT[state] or initial == "s" and state == START else None


def _lower_bounds(rows: list[tuple[int, str]]) -> list[tuple[int, int, int, int]]:
    """By row and state the least cost of the rows from there on, wherever the conversation then ends."""
    out = [(0, 0, 0, 0)]
    for kind, initial in reversed(rows):
        rest, best = out[-1], []
        for state in (START, USER, ASSISTANT):
            cost = DELETE + rest[state]
            if kind != GONE:
                extra = TRUNCATED * (kind == CUT)
                cost = min(cost, REROLE + extra + rest[STATE[NEXT[state]]])
                if (kept := _after(state, initial)) is not None:
                    cost = min(cost, KEEP + extra + rest[kept])
            best.append(cost)
        start, user, assistant = best
        user, assistant = min(user, INSERT + assistant), min(assistant, INSERT + user)
        out.append((min(start, INSERT + user), min(assistant, INSERT + user), user, assistant))
    return out[::-1]


def _choices(rows: list[tuple[int, str]], at: int, state: int) -> Iterator[tuple[str, int, int, int]]:
    """``(initial, cost, row, state)`` of the edits possible, in ASCII order."""
    if at < len(rows):
        yield "D", DELETE, at + 1, state
    yield "I", INSERT, at, STATE[NEXT[state]]
    if at < len(rows) and rows[at][0] != GONE:
        extra = TRUNCATED * (rows[at][0] == CUT)
        if (kept := _after(state, rows[at][1])) is not None:
            yield "K", KEEP + extra, at + 1, kept
        yield "R", REROLE + extra, at + 1, STATE[NEXT[state]]


def search(rows: list[tuple[int, str]]) -> tuple[int, str]:
    """The least cost, and the ASCII-least audit of that cost, for rows of (kind, role's initial)."""
    bounds, failed = _lower_bounds(rows), {}
    limit = bounds[0][START]
    while True:
        beyond = None
        path: list[str] = []
        stack = [(0, START, 0, _choices(rows, 0, START))]
        if not rows:
            return 0, ""
        while stack:
            at, state, cost, choices = stack[-1]
            for letter, price, row, then in choices:
                total = cost + price
                least = total + max(bounds[row][then], failed.get((row, then), -1) + 1)
                if least > limit:
                    beyond = least if beyond is None else min(beyond, least)
                    continue
                path.append(letter)
                if row == len(rows) and then in (START, ASSISTANT):
                    return total, "".join(path)
                stack.append((row, then, total, _choices(rows, row, then)))
                break
            else:
                failed[at, state] = max(failed.get((at, state), -1), limit - cost)
                stack.pop()
                if path:
                    path.pop()
        limit = beyond


class Repair:
    """Applies an audit to a conversation's rows as they pass: gives the turns to write, as (role, text)."""

    def __init__(self, audit: str):
        self.letters, self.state = iter(audit), START

    def _turn(self, role: bytes | None, text: bytes) -> tuple[bytes, bytes]:
        role = ROLES[NEXT[self.state]].encode() if role is None else role
        self.state = STATE[chr(role[0])]
        return role, text

    def row(self, role: bytes, text: bytes) -> Iterator[tuple[bytes, bytes]]:
        """The turns up to a row's own edit."""
        for letter in self.letters:
            if letter == "I":
                yield self._turn(None, b"")
                continue
            if letter != "D":
                yield self._turn(role if letter == "K" else None, text)
            return

    def end(self) -> Iterator[tuple[bytes, bytes]]:
        """Turns inserted behind the last row."""
        for _ in self.letters:
            yield self._turn(None, b"")


class _Digest:
    """SHA-256 of ``role:text`` lines."""

    def __init__(self):
        self.sha, self.first = hashlib.sha256(), True

    def add(self, turns: Iterator[tuple[bytes, bytes]]) -> None:
        for role, text in turns:
            self.sha.update((b"" if self.first else b"\n") + role + b":" + text)
            self.first = False


def _kind(text: bytes, again: bool) -> int:
    last = text.rstrip(_SPACE)[-1:]
    return GONE if not last or again else SOUND if last in b".!?" else CUT


class _Conversation:
    """What is kept of one conversation while its rows pass in order."""

    def __init__(self, held_bytes: int):
        self.rows: list[tuple[int, str]] = []
        self.seen: set[bytes] = set()
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.low = self.high = self.last_turn = self.last = None
        self.turns, self.room = 0, held_bytes
        self.texts: list[tuple[bytes, bytes]] | None = []

    def add(self, turn: int | None, role: bytes, text: bytes) -> None:
        if turn is not None:
            self.low, self.high = turn if self.low is None else self.low, turn
            self.turns += turn != self.last_turn
            self.last_turn = turn
        mark = hashlib.blake2b(b"%d:%s%s" % (len(role), role, text), digest_size=16).digest()
        blank, again = not text.strip(_SPACE), mark in self.seen
        self.seen.add(mark)
        kind, initial = _kind(text, again), role[:1].decode("latin-1")
        self.counts["blank"] += blank
        self.counts["duplicate"] += again and not blank
        self.counts["truncated"] += kind == CUT
        if self.last is not None:
            self.counts["illegal"] += self.last + initial not in ("su", "ua", "au")
        self.last = initial
        self.rows.append((kind, initial))
        self.room -= len(role) + len(text) + 100
        if self.room < 0:
            self.texts = None
        if self.texts is not None:
            self.texts.append((role, text))

    def result(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.low is not None else 0
        cost, audit = search(self.rows)
        if self.texts is None:
            return gaps, *self.counts.values(), cost, audit, None
        edits, digest = Repair(audit), _Digest()
        for role, text in self.texts:
            digest.add(edits.row(role, text))
        digest.add(edits.end())
        return gaps, *self.counts.values(), cost, audit, digest.sha.hexdigest()


def _grouped(batches: Iterator[pa.RecordBatch], texts: tuple[int, ...], rows: int = 512) -> Iterator[tuple]:
    """Rows as tuples, with whether a row's conversation differs from the one before.  Texts are given as bytes."""
    last, any_yet = None, False
    for batch in sliced(batches, rows):
        columns = [as_bytes(c) if i in texts else c.to_pylist() for i, c in enumerate(batch.columns)]
        for row in zip(*columns):
            yield not any_yet or row[0] != last, row
            last, any_yet = row[0], True


def _chunks(rows: Iterator[tuple], most: int = 512) -> Iterator[list]:
    out = []
    for row in rows:
        out.append(row)
        if len(out) == most:
            yield list(map(list, zip(*out)))
            out = []
    if out:
        yield list(map(list, zip(*out)))


def _audit_columns(held_bytes: int):
    """Reads (_id, turn, role, text, absent) by conversation and turn; a row per conversation."""
    def found(batches):
        name, now = None, None
        for new, (conversation, turn, role, text, absent) in _grouped(batches, (2, 3)):
            if new:
                if now is not None:
                    yield name, *now.result()
                name, now = conversation, _Conversation(held_bytes)
            if not absent:
                now.add(turn, role, text)
        if now is not None:
            yield name, *now.result()
    return lambda batches: _chunks(found(batches))


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(new, conversation, turns)`` from rows (_id, audit, role, text), a conversation's audit before its rows."""
    name, edits = None, None
    for new, (conversation, audit, role, text) in _grouped(batches, (2, 3)):
        if new:
            if edits is not None:
                yield False, name, edits.end()
            name, edits = conversation, Repair(audit)
            yield True, name, iter(())
        else:
            yield False, name, edits.row(role, text)
    if edits is not None:
        yield False, name, edits.end()


def _digest_columns(batches):
    def found():
        last, digest = None, None
        for new, name, turns in _applied(batches):
            if new:
                if digest is not None:
                    yield last, digest.sha.hexdigest()
                last, digest = name, _Digest()
            digest.add(turns)
        if digest is not None:
            yield last, digest.sha.hexdigest()
    return _chunks(found())


def _turn_columns(batches):
    def found():
        place = 0
        for new, name, turns in _applied(batches):
            place = 0 if new else place
            for role, text in turns:
                yield name, place, role.decode("utf-8", "replace"), text.decode("utf-8", "replace")
                place += 1
    return _chunks(found(), 256)


STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_ORDER = ("_id", "_turn", "_role", "_text")


def _rows(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, absent_col: str | None) -> DataFrame:
    absent = F.coalesce(conversations[absent_col], F.lit(False)) if absent_col else F.lit(False)
    return conversations.select(
        conversations[id_col].alias("_id"), conversations[turn_col].cast("long").alias("_turn"),
        F.coalesce(conversations[role_col], F.lit(" ")).alias("_role"),
        F.when(absent, "").otherwise(F.coalesce(conversations[text_col], F.lit(" "))).alias("_text"), absent.alias("_absent"))


def repair(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", absent_col: str | None = None, held_bytes: int = 32 << 20) -> DataFrame:
    """``(<id>, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` per conversation.

    Rows stand by turn, null turns first, rows of one turn by role and text.  A null role or text counts as one space.
    A row is blank, else a duplicate (role and text stand earlier), else truncated (its last character that is not white
    space is none of ``.!?``).  ``audit`` has the initials of the cheapest edits, the ASCII-least of equally cheap ones.
    Rows marked in ``absent_col`` count only as naming their conversation, which then has zeros, an empty audit and the
    hash of the empty text if it has no other rows.  Rows without a conversation id are one conversation of their own.
    Repeated rows are duplicates.  An empty table gives an empty result.
    """
    rows = _rows(conversations, id_col, turn_col, role_col, text_col, absent_col)
    placed = rows.repartition("_id").sortWithinPartitions(*_ORDER)
    audits = stage(arrow_map(placed, _audit_columns(held_bytes), fields(
        rows, *(StructField(c, LongType()) for c in STATS), StructField("audit", StringType()),
        StructField("_sha256", StringType()))), "audits")
    done = audits.select(F.col("_id").alias(id_col), *STATS, "audit", F.col("_sha256").alias("repaired_sha256"))
    late = audits.where("_sha256 is null")
    if late.isEmpty():
        return done
    digests = arrow_map(_behind_audits(rows, late), _digest_columns, fields(rows, StructField("_late", StringType())))
    digests = digests.withColumnRenamed("_id", "_lid")
    return done.where("repaired_sha256 is not null").union(
        late.join(digests, F.col("_id").eqNullSafe(F.col("_lid"))).select("_id", *STATS, "audit", "_late"))


def _behind_audits(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """``(_id, audit, _role, _text)``: the audit of each conversation that has one, then the conversation's rows in order."""
    named = audits.select(F.col("_id").alias("_lid"))
    kept = rows.where("not _absent").join(named, F.col("_id").eqNullSafe(F.col("_lid")), "left_semi").select(
        "_id", F.lit(None).cast("string").alias("audit"), "_turn", "_role", "_text", F.lit(1).alias("_place"))
    front = audits.select("_id", "audit", F.lit(None).cast("long"), F.lit(""), F.lit(""), F.lit(0))
    lined = front.union(kept.select("_id", "audit", "_turn", "_role", "_text", "_place")).toDF(
        "_id", "audit", "_turn", "_role", "_text", "_place")
    return lined.repartition("_id").sortWithinPartitions("_id", "_place", "_turn", "_role", "_text").select(
        "_id", "audit", "_role", "_text")


def repaired_turns(conversations: DataFrame, audits: DataFrame, id_col: str = "conv_id", turn_col: str = "turn",
                   role_col: str = "role", text_col: str = "text", absent_col: str | None = None) -> DataFrame:
    """``(<id>, place, role, text)``: the turns of every conversation after the edits of :func:`repair`'s result.

    Conversations whose audit leaves nothing have no rows.
    """
    rows = _rows(conversations, id_col, turn_col, role_col, text_col, absent_col)
    found = audits.select(audits[id_col].alias("_id"), "audit")
    out = arrow_map(_behind_audits(rows, found), _turn_columns, fields(
        rows, StructField("place", LongType()), StructField("role", StringType()), StructField("text", StringType())))
    return out.withColumnRenamed("_id", id_col)


def damaged(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """The rows with faults put in, by the CRC-32 of ``<id>:<turn>`` modulo 20 (nulls count as one space).

    0 marks a row as ``absent``, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats the row, 4 makes it a user's.
    """
    def known(c: str):
        return F.coalesce(conversations[c].cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(known(id_col), F.lit(":"), known(turn_col)).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(known(text_col), ".!?", "")).otherwise(known(text_col))
    return conversations.select(
        conversations[id_col].alias(id_col), conversations[turn_col].alias(turn_col),
        F.when(fault == 4, "user").otherwise(known(role_col)).alias(role_col), text.alias(text_col),
        (fault == 0).alias("absent"),
        F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def repair_sql(crc_table: str, crc: str) -> str:
    """:func:`repair` of :func:`damaged` ``conversations`` in SQL: all states row by row, keeping the cheapest and ASCII-least.

    ``crc`` is the CRC-32 of the column ``text`` of a table that ``crc_table`` serves.
    """
    return rf"""
with recursive {crc_table},
 source as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as body,
   coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as text from conversations),
 faults as (select conv_id, turn, role, body, {crc} % 20 as k from source, crc_table),
 damaged as (select conv_id, turn, case when k = 4 then 'user' else role end as role,
     case k when 1 then '' when 2 then translate(body, '.!?', '') else body end as text,
     unnest(case when k = 3 then [0, 1] else [0] end) as copy from faults where k <> 0),
 ordered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as p from damaged),
 judged as (select *, not regexp_matches(text, '[^ 	-]') as blank,
     row_number() over (partition by conv_id, role, text order by p) > 1 as again,
     not regexp_matches(text, '[.!?][ 	-]*\z') as cut, role[1] as initial,
     lag(role[1]) over (partition by conv_id order by p) as before from ordered),
 stats as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
     count(*) filter (blank) as blank, count(*) filter (again and not blank) as duplicate,
     count(*) filter (cut and not again and not blank) as truncated,
     count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal
   from judged group by conv_id),
 inserted(q, q1, c1, a1, t1) as (values
   (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
   (0, 2, 5, 'I', 'user:' || chr(10)), (1, 2, 5, 'I', 'user:' || chr(10)), (3, 2, 5, 'I', 'user:' || chr(10)),
   (2, 3, 5, 'I', 'assistant:' || chr(10)), (0, 3, 10, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)),
   (1, 3, 10, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (3, 3, 10, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)),
   (2, 2, 10, 'II', 'assistant:' || chr(10) || 'user:' || chr(10))),
 fold as (
   select conv_id, 0::bigint as p, 0 as q, {{'c': 0::bigint, 'a': '', 't': ''}} as best from stats
   union all
   select conv_id, p, q, min({{'c': c, 'a': a, 't': t}}) from (
     select j.conv_id, j.p, case e.e when 'D' then q1 when 'K' then case initial when 's' then 1 when 'u' then 2 else 3 end
         else case when q1 = 2 then 3 else 2 end end as q,
       best.c + c1 + case e.e when 'D' then 2 when 'R' then 1 else 0 end + case when e.e <> 'D' and cut then 5 else 0 end as c,
       best.a || a1 || e.e as a,
       best.t || t1 || case e.e when 'D' then '' when 'K' then j.role || ':' || j.text || chr(10)
         else case when q1 = 2 then 'assistant' else 'user' end || ':' || j.text || chr(10) end as t
     from fold join inserted using (q) join judged j on j.conv_id is not distinct from fold.conv_id and j.p = fold.p + 1
       join (values ('D'), ('K'), ('R')) e(e) on e.e = 'D' or not (blank or again) and (e.e = 'R'
         or initial = 's' and q1 = 0 or initial = 'u' and q1 in (0, 1, 3) or initial = 'a' and q1 = 2)) x
   group by conv_id, p, q),
 ended as (select fold.conv_id, min({{'c': best.c + c1, 'a': best.a || a1, 't': best.t || t1}}) as best
   from fold join inserted using (q) join stats on stats.conv_id is not distinct from fold.conv_id and fold.p = n
   where q1 in (0, 3) group by fold.conv_id)
select w.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
  coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(best.c, 0)::bigint as cost,
  coalesce(best.a, '') as audit, sha256(coalesce(substr(best.t, 1, length(best.t) - 1), '')) as repaired_sha256
from (select distinct conv_id from conversations) w left join stats on stats.conv_id is not distinct from w.conv_id
  left join ended on ended.conv_id is not distinct from w.conv_id"""
