"""Conversation repair: the search against every edit sequence, whole conversations against plain code, odd tables."""

import hashlib
import itertools
import random
import zlib

import pytest

from geoctx.llm.conversations import ENDS, _between, _joined, _moves, _turn, damaged, repair, repaired_rows, search


def exhaustive(codes, most=4):
    """The least of all edit sequences with up to ``most`` inserts."""
    found = []

    def go(i, state, cost, audit, inserts):
        if i == len(codes) and state in ENDS:
            found.append((cost, audit))
        for edit, price, behind in _moves(codes[i] if i < len(codes) else None, state):
            if edit != "I":
                go(i + 1, behind, cost + price, audit + edit, inserts)
            elif inserts < most:
                go(i, behind, cost + price, audit + edit, inserts + 1)

    go(0, 0, 0, "", 0)
    return min(found)


def walked(codes):
    """The same by keeping the least prefix of every state, row by row."""
    here = {0: (0, "")}

    def inserted(states):
        states = dict(states)
        for _, (q, found) in itertools.product(range(4), list(states.items())):
            found = states[q]
            new = (found[0] + 3, found[1] + "I")
            b = _turn(q)[1]
            states[b] = min(states.get(b, new), new)
            if b not in here:
                c = _turn(b)[1]
                more = (states[b][0] + 3, states[b][1] + "I")
                states[c] = min(states.get(c, more), more)
        return states

    for code in codes:
        after = {}
        for q, (cost, audit) in inserted(here).items():
            for edit, price, b in _moves(code, q):
                if edit != "I":
                    new = (cost + price, audit + edit)
                    after[b] = min(after.get(b, new), new)
        here = after
    states = inserted(here)
    return min(states[q] for q in ENDS if q in states)


def test_search_finds_the_least_of_all_edits():
    for n in range(4):
        for codes in itertools.product("suaSUA-.", repeat=n):
            assert search("".join(codes)) == exhaustive("".join(codes))


def test_search_of_longer_conversations_and_of_pieces():
    rng = random.Random(5)
    for _ in range(400):
        codes = "".join(rng.choice("suauauaUA-+.") for _ in range(rng.randrange(60)))
        k = rng.randrange(len(codes) + 1)
        assert search(codes) == walked(codes) == _joined([_between(codes[:k]), _between(codes[k:])])


def plain(rows):
    """Counts, cheapest repair and hash of one conversation's rows (turn, role, text) after damage, in order."""
    blank = duplicate = truncated = illegal = 0
    codes, seen, before = "", set(), None
    for _, role, text in rows:
        bare = text.translate({c: None for c in (32, 9, 10, 11, 12, 13)})
        initial = role[:1]
        illegal += before is not None and before + initial not in ("su", "ua", "au")
        before = initial
        code = initial if initial in ("s", "u", "a") else "-"
        if not bare:
            blank, code = blank + 1, "."
        elif (role, text) in seen:
            duplicate, code = duplicate + 1, "."
        elif bare[-1] not in ".!?":
            truncated, code = truncated + 1, "+" if code == "-" else code.upper()
        seen.add((role, text))
        codes += code
    cost, audit = walked(codes)
    lines = [f"{r}:{t}" for r, t in repaired_rows(audit, iter([(r, t) for _, r, t in rows]))]
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def hurt(rows):
    """The contract's damage in plain code, grouped by conversation and put in order."""
    out = {}
    blank = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        own = out.setdefault(conv, [])
        role, text = "user" if kind == 4 else blank(role), blank(text)
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        own.extend([(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    return out


def got(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = df.collect()
    assert len(rows) == len({r.conv_id for r in rows})
    return {r.conv_id: tuple(r[n] for n in names) for r in rows}


def odd_rows():
    rng = random.Random(9)
    rows = []
    for conv in range(150):
        turn = 0
        for _ in range(rng.randrange(1, 14)):
            turn += rng.choice((0, 1, 1, 1, 2, 7))
            role = rng.choice(("system", "user", "assistant", "user", "assistant", "tool", "", None, "ünder"))
            text = rng.choice(("Yes.", "no", "", " \t", None, "What?", "a b!", "ok. ", "é…", "x" * 3000))
            rows.append((conv, rng.choice((turn, turn, turn, turn, None)), role, text))
    rows += [(None, t, "user", "null id.") for t in range(6)] + [(None, None, None, None)] * 3
    rows += [(7_000, t, "user", "the same.") for t in range(400)] + [(7_001, 5, "user", "one row often.")] * 300
    rows += [(7_002, None, "assistant", f"no turn {i}.") for i in range(40)] + [(7_003, t, ("user", "assistant")[t % 2], f"long one {t}.") for t in range(900)]
    return rows


@pytest.mark.parametrize("segment", [2_000, 7])
def test_odd_conversations(spark, segment):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, part int, digest string").repartition(5)
    want = {conv: plain(own) for conv, own in hurt(rows).items()}
    assert got(repair(damaged(df), df, segment=segment)) == want


def test_conversations_without_rows(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair(damaged(empty), empty).collect() == []
    gone = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(1, gone, "user", "goes.")], "conv_id long, turn long, role string, text string")
    assert got(repair(damaged(df), df)) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_repaired_texts_and_text_ids(spark):
    df = spark.createDataFrame([("c", 1, "assistant", "Hello."), ("c", 2, "system", "Late."), ("c", 3, "user", "Bye.")], "conv_id string, turn int, role string, text string")
    row = repair(df, texts=True).first()
    assert (row.cost, row.audit) == search("asu")
    lines = [tuple(r) for r in row.repaired]
    assert lines == list(repaired_rows(row.audit, iter([("assistant", "Hello."), ("system", "Late."), ("user", "Bye.")])))
    assert row.repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
