import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from alertloom.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()


def plain(rows):
    """Least (cost, audit) of all edit sequences with at most two insertions at a place, judged by the pattern."""
    best = None
    per_row = ["D" if kind == repair.GONE else "DKua" for kind, _ in rows]
    for edits in itertools.product(*per_row):
        kept = ["" if e == "D" else initial if e == "K" else e for e, (_, initial) in zip(edits, rows)]
        base = sum({"D": 2, "K": 0}.get(e, 1) + 5 * (kind == repair.CUT and e != "D") for e, (kind, _) in zip(edits, rows))
        if best is not None and base > best[0]:
            continue
        for places in itertools.product(("", "u", "a", "ua", "au"), repeat=len(rows) + 1):
            cost = base + 5 * sum(map(len, places))
            if best is not None and cost > best[0]:
                continue
            roles = "".join(p + k for p, k in zip(places, kept + [""]))
            if re.fullmatch("(s?(ua)+)?", roles) and all(len(k) == (e != "D") for k, e in zip(kept, edits)):
                audit = "".join("I" * len(p) + (e if e in "DK" else "R") for p, e in zip(places, list(edits) + [""]))
                best = min(best, (cost, audit)) if best else (cost, audit)
    return best


def brute(rows):
    """Result columns of a conversation's rows (turn, role, text) in order."""
    kinds, seen, counts, edited = [], set(), [0, 0, 0, 0], []
    for _, role, text in rows:
        last = re.sub(r"[\x20\x09-\x0D]", "", text)[-1:]
        fault = 0 if not last else 1 if (role, text) in seen else 2 if last not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        kinds.append((repair.SOUND if fault is None else repair.CUT if fault == 2 else repair.GONE, role[:1]))
    counts[3] = sum(a + b not in ("su", "ua", "au") for (_, a), (_, b) in zip(kinds, kinds[1:]))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit = plain(kinds)
    rest, before = iter(rows), ""
    for letter in audit:
        role, text = next(rest)[1:] if letter != "I" else ("", "")
        if letter != "D":
            role = role if letter == "K" else "assistant" if before == "u" else "user"
            before = role[0]
            edited.append(f"{role}:{text}")
    return gaps, *counts, cost, audit, hashlib.sha256("\n".join(edited).encode()).hexdigest()


def random_rows(seed, conversations=30, most=4):
    rnd, rows = random.Random(seed), []
    for c in range(conversations):
        for t in range(rnd.randint(1, most)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rnd.choice(["Yes.", "No!", "cut", "a, b ", "", " \n", "fine? \t", "x.", "é。", None])
            rows.append((c, rnd.choice([t, t, t, t + 2, None]), role, text))
    return rows


def grouped(rows):
    out = {}
    for c, turn, role, text in rows:
        out.setdefault(c, []).append((turn, " " if role is None else role, " " if text is None else text))
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, v in out.items()}


def test_search_finds_the_cheapest_and_least():
    rnd = random.Random(4)
    for _ in range(250):
        rows = [(rnd.choice([0, 0, 0, 1, 2]), rnd.choice("uuaasx")) for _ in range(rnd.randint(0, 4))]
        assert repair.search(rows) == plain(rows), rows


def test_long_conversations_take_linear_time():
    rows = [(repair.CUT if i % 7 == 0 else repair.SOUND, "u" if i % 3 else "a") for i in range(50_000)]
    cost, audit = repair.search(rows)
    assert len(audit) >= len(rows) and cost > 0


def test_repair_against_brute_force(spark):
    rows = random_rows(1)
    frame = spark.createDataFrame(rows, SCHEMA)
    want = {c: brute(v) for c, v in grouped(rows).items()}
    wide = frame.withColumns({c: F.lit("x") for c in ("_id", "_turn", "_text", "audit", "absent", "cost")})
    for held in (32 << 20, 100, 0):  # texts held, partly held, and read again
        got = {r.conv_id: tuple(r)[1:] for r in repair.repair(wide, held_bytes=held).collect()}
        assert got == want
    turns = {}
    for r in repair.repaired_turns(wide, repair.repair(wide)).orderBy("conv_id", "place").collect():
        assert r.place == len(turns.setdefault(r.conv_id, []))
        turns[r.conv_id].append(f"{r.role}:{r.text}")
    assert all(hashlib.sha256("\n".join(turns.get(c, [])).encode()).hexdigest() == w[-1] for c, w in want.items())


def test_damage(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"Is. it! {c}{t}?") for c in range(40) for t in range(4)]
    rows += [(None, 0, "user", "a."), (None, None, None, None), (7, None, "user", "b.")]
    got = repair.damaged(spark.createDataFrame(rows, SCHEMA)).collect()
    want, seen = [], set()
    for c, t, role, text in rows:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        seen.add(fault)
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        want += [(c, t, "user" if fault == 4 else role, text, fault == 0)] * (1 + (fault == 3))
    assert set(range(5)) <= seen and sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_odd_rows(spark):
    long = "word " * 200_000 + "."
    rows = [(1, None, None, None), (1, None, None, None), (2, 0, "user", long), (2, 1, "assistant", long), (2, 1, "assistant", long),
            (3, 5, "system", "s."), (3, 9, "user", "u."), (None, 1, "user", "q."), (None, 2, "assistant", "a.")]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("gone", F.expr("case when conv_id = 3 then true end"))
    for held in (32 << 20, 1000):
        got = {r.conv_id: tuple(r)[1:] for r in repair.repair(frame, absent_col="gone", held_bytes=held).collect()}
        assert got[1] == (0, 2, 0, 0, 1, 4, "DD", EMPTY)
        assert got[2] == (0, 0, 1, 0, 1, 2, "KKD", hashlib.sha256(f"user:{long}\nassistant:{long}".encode()).hexdigest())
        assert got[3] == (0, 0, 0, 0, 0, 0, "", EMPTY)
        assert got[None] == (0, 0, 0, 0, 0, 0, "KK", hashlib.sha256(b"user:q.\nassistant:a.").hexdigest())
    assert repair.repair(frame.limit(0)).collect() == []
    assert repair.repair(repair.damaged(frame.limit(0)), absent_col="absent").collect() == []
