import hashlib
import itertools
import random
import re
import zlib
from functools import cache

from cliplane.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, edit string, symbols int, gid string, kind int"
LEGAL = re.compile(r"(s?(ua)+)?")


def faults(rows):
    """(blank, duplicate, truncated) of each (role, text)."""
    out, seen = [], set()
    for role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        blank = not bare
        again = not blank and (role, text) in seen
        seen.add((role, text))
        out.append((blank, again, not blank and not again and bare[-1] not in ".!?"))
    return out


def least(rows):
    """(cost, audit, repaired) of the cheapest edits, by trying edits turn by turn."""
    marks = faults(rows)

    @cache
    def best(t, made):
        # What follows depends on what was made only by its last initial and whether it has more than none.
        options = [(0, "", ())] if t == len(rows) and LEGAL.fullmatch(prefix(made)) else []
        for role in ("user", "assistant"):
            if made[-2:].count("+") < 2 and ok(made + role[0]):
                c, a, r = best_inserted(t, made, role)
                options.append((2 + c, "I" + a, (f"{role}:", *r)))
        if t < len(rows):
            (role, text), (blank, again, cut) = rows[t], marks[t]
            c, a, r = best(t + 1, made.replace("+", ""))
            options.append((3 + c, "D" + a, r))
            for edit, new, price in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                if not blank and not again and new[:1] and ok(made.replace("+", "") + new[:1]):
                    c, a, r = best(t + 1, short(made.replace("+", "") + new[:1]))
                    options.append((price + cut + c, edit + a, (f"{new}:{text}", *r)))
        return min(options, default=(10**6, "", ()))

    def best_inserted(t, made, role):
        return best(t, short(made.replace("+", "") + role[0]) + "+" * (made.count("+") + 1))

    # From the end, so that no call goes deep.
    for t in range(len(rows), -1, -1):
        for made in ("", "s", "u", "su", "ua", "sua", "uau", "suau"):
            best(t, made)
    return best(0, "")


def prefix(made):
    return made.replace("+", "")


def ok(made):
    made = made.replace("+", "")
    return re.fullmatch(r"s?(ua)*u?", made) is not None


def short(made):
    """Longer strings of pairs are like one pair."""
    return re.sub(r"(ua)+", "ua", made)


def everything(rows):
    """(cost, audit) over all edits of a few turns, with up to two turns inserted at each place."""
    marks, best = faults(rows), None
    inserts = ["", "u", "a", "ua", "au", "uu", "aa"]
    for gaps in itertools.product(inserts, repeat=len(rows) + 1):
        for edits in itertools.product("DKua", repeat=len(rows)):
            made, cost, audit = gaps[0], 2 * len(gaps[0]), "I" * len(gaps[0])
            for (role, _), (blank, again, cut), e, gap in zip(rows, marks, edits, gaps[1:], strict=True):
                if e != "D" and (blank or again):
                    break
                made += {"D": "", "K": role[:1] or "?"}.get(e, e)
                cost += {"D": 3, "K": cut}.get(e, 2 + cut) + 2 * len(gap)
                audit += {"D": "D", "K": "K"}.get(e, "R") + "I" * len(gap)
                made += gap
            else:
                if LEGAL.fullmatch(made):
                    best = min(best, (cost, audit)) if best else (cost, audit)
    return best


def plain(rows, ids):
    """Digests of (conv_id, turn, role, text) rows."""
    out = []
    for conv in ids:
        own = sorted(((r[1] is not None, r[1] or 0), r[2] or " " if r[2] is None else r[2], " " if r[3] is None else r[3]) for r in rows if r[0] == conv)
        said = [(r[1], r[2]) for r in own]
        marks = faults(said)
        turns = [r[0][1] for r in own if r[0][0]]
        cost, audit, repaired = least(tuple(said))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(said))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *(sum(m[i] for m in marks) for i in range(3)), illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest()))
    return sorted(out, key=str)


def made_up(rng, conv, n):
    texts = ["Yes.", "no", "What?", "", " \n", "Go on!", "well \t", "ok.\n"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "ursula", None]
    return [(conv, rng.choice([i, i, i, i + 3, None]), rng.choice(roles), rng.choice([*texts, f"{i}.", f"{i} a.", None])) for i in range(n)]


def test_least_is_least():
    rng = random.Random(5)
    for n in (0, 1, 1, 2, 2, 2, 3, 3, 3):
        rows = tuple((r[2] or "", r[3] or "") for r in made_up(rng, 1, n))
        assert least(rows)[:2] == everything(rows), rows


def test_repair_equals_plain(spark):
    rng = random.Random(6)
    rows = [r for conv in range(60) for r in made_up(rng, conv, rng.choice([1, 2, 4, 5, 9, 17, 30]))]
    # Null ids, repeated rows, a conversation over several segments, and one without rows.
    rows += made_up(rng, None, 7) + rows[3:9]
    rows += [(900, i, rng.choice(["user", "assistant"]), f"{i}{rng.choice(['.', ''])}") for i in range(2600)]
    ids = sorted({r[0] for r in rows} - {None}) + [None, 901]
    df = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA).repartition(5)
    named = spark.createDataFrame([(i,) for i in [*ids, 901]], "conv_id long")
    edits = repair.repair(df, named)
    got = sorted((tuple(r) for r in repair.digests(edits).collect()), key=str)
    assert got == plain(rows, ids)
    texts = [(e["role"], e["text"]) for e in edits.filter("conv_id = 900 and edit <> 'D'").collect()]
    assert LEGAL.fullmatch("".join(r[0] for r, _ in texts)) and len(texts) > 1300


def test_none_and_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.repair(none).count() == 0 and repair.digests(repair.repair(none, none)).count() == 0
    one = repair.digests(repair.repair(none, spark.createDataFrame([(7,)], "conv_id long"))).collect()
    assert [tuple(r) for r in one] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_damage(spark):
    rows = [(c, t, "assistant", "a.b!") for c in [*range(30), None] for t in [*range(6), None]]
    want = []
    for c, t, role, text in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want += [] if h == 0 else [(c, t, "user" if h == 4 else role, "" if h == 1 else "ab" if h == 2 else text)] * (2 if h == 3 else 1)
    got = [tuple(r) for r in repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_blocks_equal_single_steps():
    t = repair.tables()
    rng = random.Random(7)
    assert len(t.vectors) < 200
    for n in (0, 1, 3, 4, 5, 64, 1023):
        symbols = bytes(rng.randrange(repair.SYMBOLS) for _ in range(n))
        after = rng.randrange(len(t.vectors))
        one = after
        for s in reversed(symbols):
            one = int(t.step[one, s])
        assert t.past(symbols, after)[-1] == one
