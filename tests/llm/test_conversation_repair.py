"""Conversation repair against every sequence of edits, and whole tables against one parse a conversation."""

import hashlib
import itertools
import random
import re
import zlib

from quire.llm import conversation_repair as R

TALK = re.compile(r"(s?(ua)+)?\Z")


def brute(turns, most=2):
    """The cheapest audit, ASCII-least among equals, of all edits with up to `most` inserted turns in a row."""
    best = None
    options = [[("I" * k) + e for k in range(most + 1) for e in "KRD"] for _ in turns]
    for parts in itertools.product(*options, ["I" * k for k in range(most + 1)]):
        audit, cost, roles, at, ok = "".join(parts), 0, "", 0, True
        for e in audit:
            if e == "I":
                roles, cost = roles + ("a" if roles[-1:] == "u" else "u"), cost + 2
                continue
            initial, must_go, cut_off = turns[at]
            at += 1
            if e == "D":
                cost += 3
            elif must_go or e == "K" and not initial:
                ok = False
                break
            else:
                roles += initial if e == "K" else "a" if roles[-1:] == "u" else "u"
                cost += (e == "R") * 2 + cut_off
        if ok and TALK.match(roles) and (best is None or (cost, audit) < best):
            best = (cost, audit)
    return best


def test_every_sequence_of_edits():
    r = random.Random(7)
    for n in range(4):
        for _ in range(40):
            turns = [(r.choice("suaux"), r.random() < 0.2, r.random() < 0.3) for _ in range(n)]
            assert R.decided(R.table_of(turns, ["Empty"])) == brute(turns), turns


def test_pieces_give_what_the_whole_gives(monkeypatch):
    r = random.Random(9)
    for n in (1, 5, 40, 120):
        turns = [(r.choice("suau"), r.random() < 0.1, r.random() < 0.2) for _ in range(n)]
        whole = R.table_of(turns)
        for size in (1, 3, 17):
            monkeypatch.setattr(R, "STRETCH", size)
            assert R.table_of(turns) == whole
        monkeypatch.setattr(R, "STRETCH", 256)


SCHEMA = "conv_id long, turn long, role string, text string, no string, at string, digest string, key string"


def table():
    r = random.Random(11)
    rows = []
    text = lambda: r.choice(["Yes.", "No!", "why ", "", " \n", "a b. ", "Same?", "x" * r.randint(1, 40), None])
    for c in range(60):
        rows += [(c, t, r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), text()) for t in range(r.randint(1, 8)) if r.random() < 0.9]
    rows += [(500, t, "user" if t % 2 == 0 else "assistant", f"turn {t % 90}{r.choice('.,')}") for t in range(400)]  # reaches over several ranges
    rows += [(None, t, r.choice(["user", "assistant"]), text()) for t in (None, None, 3, 3, 9)] + [(501, None, "user", "a."), (501, None, "user", "a."), (502, 5, "system", "only.")]
    return [(*x, "no", "at", "digest", "key") for x in dict.fromkeys(rows)] + [(501, None, "user", "a.", "1", "2", "3", "4")]


def spoilt(rows):
    out = []
    for c, t, role, text, *_ in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(c, t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def expected(rows):
    out = []
    groups = {c: [] for c in {x[0] for x in rows}}
    for c, *rest in spoilt(rows):
        groups[c].append(rest)
    for c, held in groups.items():
        held.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashlib.md5(f"{len(x[1])}:{x[1]}:{x[2]}".encode()).hexdigest()))
        counts, turns, seen = {"blank": 0, "duplicate": 0, "truncated": 0}, [], set()
        for _, role, text in held:
            bare = text.strip(" \t\n\x0b\x0c\r")
            wrong = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            if wrong:
                counts[wrong] += 1
            turns.append((role[:1], wrong in ("blank", "duplicate"), wrong == "truncated"))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:], strict=False))
        numbers = {x[0] for x in held if x[0] is not None}
        cost, audit = R.decided({"Empty": R.parse(turns)})
        told = "\n".join(f"{role}:{text}" for role, text in R.repaired(((x[1], x[2]) for x in held), audit))
        out.append((c, max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *counts.values(), illegal, cost, audit, hashlib.sha256(told.encode()).hexdigest()))
    return sorted(out, key=str)


def test_tables(spark):
    turns = spark.createDataFrame(table(), SCHEMA).repartition(3)
    found = R.repaired_digests(turns)
    assert sorted(map(tuple, found.collect()), key=str) == expected(table())


def test_repaired_turns():
    rows = [(0, "user", "a."), (1, "user", "b."), (2, "assistant", "c.")]
    found = R.repair_one(rows)
    assert (found["cost"], found["audit"], found["illegal"]) == (2, "KIKK", 1)
    assert list(R.repaired([x[1:] for x in rows], "KIKK")) == [("user", "a."), ("assistant", ""), ("user", "b."), ("assistant", "c.")]


def test_empty_table(spark):
    assert R.repaired_digests(spark.createDataFrame([], SCHEMA)).collect() == []
