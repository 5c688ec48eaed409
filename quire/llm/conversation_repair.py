"""Repair of conversations' turn structure by error-correcting Earley parsing.

A conversation is an optional system turn and then pairs of a user's and an assistant's turn, or nothing. A weighted
grammar says so (RULES); error productions let a chart skip a turn (Delete), take one for another role (Rerole) and take
a role that isn't there (Insert). Each chart item keeps its least (cost, audit), an audit being the edits' initials in
order, so of equally cheap repairs the one whose audit comes first in ASCII stays. Two audits of one cost for the same
turns never begin one another (each Insert has its cost), so the least of two parts is the least of the whole.

The rules are left-linear: what is predicted is predicted at the first turn, so each item begins there, a chart has a
handful of items for each turn, and a parse takes time in proportion to the turns. A chart may also begin with one of
the nonterminals behind it. That gives, for any stretch of turns, a small table: from each nonterminal to each other the
least cost and audit. Tables of neighbouring stretches combine (as a product with sums for products and the least for
sums), so long conversations are parsed in pieces.

Rows are dealt by ranges of conversation, turn, role and text. A conversation that lies inside one range is repaired in
that task. At most two of a range reach beyond it: their rows, whole, go through a second round, in which duplicates are
found by grouping, each stretch is parsed where it lies, tables of stretches meet, and only the final hash, which can't
be taken in parts, runs through a conversation's rows one after another without holding them. So a conversation with a
third of all rows is sorted and parsed by many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch, arrow_schema, map_batches, split_join
from quire.plans.session import ship_package

#: The weighted grammar: a nonterminal and what it is made of; a, s and u stand for turns of roles with that initial.
RULES = (("Empty", ()), ("Led", ("Empty", "s")), ("Half", ("Empty", "u")), ("Half", ("Led", "u")), ("Half", ("Whole", "u")), ("Whole", ("Half", "a")))
#: A conversation may end as one of these.
ENDS = ("Empty", "Whole")
STATES = ("Empty", "Led", "Half", "Whole")
#: Costs of the error productions, and of a turn that is cut off and stays.
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
#: Roles that may be inserted, or given instead of another.
GIVEN = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
#: Turns that one chart takes; longer stretches are combined from tables.
STRETCH = 256

SPACE = " \t\n\x0b\x0c\r"
Least = tuple[int, str]
Table = dict[str, dict[str, Least]]
#: A turn for the grammar: its role's initial, and whether it must go or is cut off.
Turn = tuple[str, bool, bool]


def closed(heads: dict[str, Least]) -> dict[tuple[int, int], Least]:
    """Predictor and completer: chart items (rule, dot) after some turns, from the nonterminals that end there; Insert productions included."""
    items: dict[tuple[int, int], Least] = {}
    agenda = list(heads.items())
    while agenda:
        head, least = agenda.pop()
        done = (STATES.index(head), -1)  # a nonterminal itself, which error productions may carry on
        if done in items and items[done] <= least:
            continue
        items[done] = least
        for i, (made, body) in enumerate(RULES):
            if body[:1] == (head,) and ((i, 1) not in items or least < items[i, 1]):
                items[i, 1] = least
                if body[1] in GIVEN:
                    agenda.append((made, (least[0] + INSERT, least[1] + "I")))
    return items


def scanned(items: dict[tuple[int, int], Least], turn: Turn) -> dict[str, Least]:
    """Scanner: the nonterminals that end after one more turn, kept, reroled or deleted."""
    initial, must_go, cut_off = turn
    heads: dict[str, Least] = {}

    def add(head: str, least: Least, cost: int, edit: str) -> None:
        new = (least[0] + cost, least[1] + edit)
        if head not in heads or new < heads[head]:
            heads[head] = new

    for (rule, dot), least in items.items():
        if dot < 0:
            add(STATES[rule], least, DELETE, "D")
        elif not must_go:
            head, wanted = RULES[rule][0], RULES[rule][1][dot]
            if wanted == initial:
                add(head, least, CUT_OFF * cut_off, "K")
            elif wanted in GIVEN:
                add(head, least, REROLE + CUT_OFF * cut_off, "R")
    return heads


def parse(turns: Iterable[Turn], seed: str = "Empty") -> dict[str, Least]:
    """The least cost and audit with which each nonterminal ends after the turns, if they follow the seed."""
    items = closed({seed: (0, "")})
    for turn in turns:
        items = closed(scanned(items, turn))
    return {STATES[rule]: least for (rule, dot), least in items.items() if dot < 0}


def table_of(turns: list[Turn], seeds: Iterable[str] = STATES) -> Table:
    """From each seed to each nonterminal; long stretches by halves."""
    if len(turns) <= STRETCH:
        return {seed: parse(turns, seed) for seed in seeds}
    half = len(turns) // 2
    return combined(table_of(turns[:half], seeds), table_of(turns[half:]))


def combined(first: Table, second: Table) -> Table:
    """The table of two neighbouring stretches."""
    out: Table = {}
    for seed, middle in first.items():
        ends: dict[str, Least] = {}
        for state, (cost, audit) in middle.items():
            for end, (more, rest) in second[state].items():
                if end not in ends or (cost + more, audit + rest) < ends[end]:
                    ends[end] = (cost + more, audit + rest)
        out[seed] = ends
    return out


def decided(table: Table) -> Least:
    return min(table["Empty"][end] for end in ENDS if end in table["Empty"])


class Repair:
    """Turns in, repaired turns out, one at a time, as an audit says."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.last = audit, 0, ""

    def given(self) -> str:
        """The role that a turn must have here if it may not keep its own."""
        return GIVEN["a" if self.last == "u" else "u"]

    def inserted(self) -> Iterator[tuple[str, str]]:
        """The turns that are inserted before the next edit of another kind."""
        while self.audit[self.at : self.at + 1] == "I":
            role = self.given()
            self.at, self.last = self.at + 1, role[0]
            yield role, ""

    def fed(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            role = role if edit == "K" else self.given()
            self.last = role[:1]
            yield role, text


def repaired(turns: Iterable[tuple[str, str]], audit: str) -> Iterator[tuple[str, str]]:
    """Roles and texts after the edits of an audit."""
    repair = Repair(audit)
    for role, text in turns:
        yield from repair.fed(role, text)
    yield from repair.inserted()


def fault(end: str, seen: bool) -> str:
    """The first fault of a turn: blank, duplicate or truncated; else nothing. end: its last character that isn't white space."""
    if not end:
        return "blank"
    if seen:
        return "duplicate"
    return "" if end in ".!?" else "truncated"


FOUND = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair_one(rows: list[tuple[int | None, str, str]]) -> dict:
    """All that FOUND names for one conversation's rows (turn, role, text) in order."""
    seen: set[tuple[str, str]] = set()
    counts, turns, illegal = {"blank": 0, "duplicate": 0, "truncated": 0}, [], 0
    for i, (_, role, text) in enumerate(rows):
        wrong = fault(text.rstrip(SPACE)[-1:], (role, text) in seen)
        seen.add((role, text))
        if wrong:
            counts[wrong] += 1
        turns.append((role[:1], wrong in ("blank", "duplicate"), wrong == "truncated"))
        illegal += i > 0 and rows[i - 1][1][:1] + role[:1] not in LEGAL
    numbers = [t for t, _, _ in rows if t is not None]
    cost, audit = decided(table_of(turns, ["Empty"]))
    told = "\n".join(f"{role}:{text}" for role, text in repaired(((r, t) for _, r, t in rows), audit))
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    return {"gaps": gaps, **counts, "illegal": illegal, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(told.encode("utf-8", "surrogatepass")).hexdigest()}


def in_order() -> list[Column]:
    """By turn, nulls first; turns of one number by role, then by their bytes' digest. Rows that tie in all of it are equal."""
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def clean(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without nulls in the last two (one space), and digest."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, F.lit(":"), text))
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), digest.alias("digest"))


def repair(turns: DataFrame) -> DataFrame:
    """For each conv_id of turns (conv_id, turn, role, text): conv_id and FOUND.

    A null role or text is one space, so a turn with a null text is blank; a turn with an empty role is never kept as it
    is. Turns without a number come first. A null conv_id is a conversation of its own. Repeated rows are duplicates, but
    for the first; turns that tie in their number are taken by role, then by a digest. Very long texts are read whole.
    Other columns aren't read, whatever their names; an empty table gives no rows.
    """
    spark = turns.sparkSession
    scratch = Scratch(spark, "repair")
    rows = scratch.table(clean(turns), "turns")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_salt", F.monotonically_increasing_id())
    order = [F.col("conv_id"), *in_order(), F.col("_salt")]
    dealt = dealt.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text")
    first = scratch.table(_in_partitions(dealt), "first")
    inside = first.where("NOT open").drop("open")
    across = [r["conv_id"] for r in first.where("open").select("conv_id").distinct().collect()]  # at most two for each range
    return inside.unionByName(_across(scratch, rows, across))


def _in_partitions(dealt: DataFrame) -> DataFrame:
    """Conversations that lie inside a range, repaired; of the first and the last, which may not, only the id (open)."""
    ship_package(dealt.sparkSession)
    names = ["conv_id", "open", *(x.split()[0] for x in FOUND.split(", "))]

    def run(batches):
        held, at, out = [], None, {c: [] for c in names}
        several = False  # whether a conversation of this range has ended before

        def put(conv_id, found):
            for c in names:
                out[c].append({"conv_id": conv_id, "open": found is None, **(found or {})}.get(c))

        for batch in batches:
            columns = [batch.column(c) for c in ("conv_id", "turn", "role", "text")]
            for i in range(batch.num_rows):
                conv_id, turn, role, text = (c[i].as_py() for c in columns)
                if at is not None and at[0] != conv_id:
                    put(at[0], repair_one(held) if several else None)
                    several, held = True, []
                at = (conv_id,)
                if several:  # of the first conversation nothing is kept: it is open anyway
                    held.append((turn, role, text))
            if out["conv_id"]:
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)
                out = {c: [] for c in names}
        if at is not None:
            put(at[0], None)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    ddl = f"conv_id long, open boolean, {FOUND}"
    schema = arrow_schema(ddl)
    return dealt.mapInArrow(run, ddl)


STRETCHES = "no long, at long, n long, low long, high long, numbers long, first_turn long, last_turn long, first_role string, last_role string, blank long, duplicate long, truncated long, illegal long, seeds array<string>, ends array<string>, costs array<long>, audits array<string>"


def _across(scratch: Scratch, rows: DataFrame, ids: list) -> DataFrame:
    """The same for the conversations that reach over several ranges, whatever their size."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = spark.createDataFrame([(i, c) for i, c in enumerate(ids)], "no long, id long")
    own = rows.join(F.broadcast(numbered), F.col("conv_id").eqNullSafe(F.col("id"))).select("no", "turn", "role", "text", "digest").withColumn("_salt", F.monotonically_increasing_id())
    order = [F.col("no"), *in_order(), F.col("_salt")]
    placed = own.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("_salt").withColumn("at", F.monotonically_increasing_id())
    placed = scratch.table(placed, "placed")

    # equal rows are told by digests of 128 bits here
    keyed = placed.select("at", F.concat_ws(":", "no", "digest").alias("key"))
    often = scratch.table(keyed.groupBy("key").agg(F.min("at").alias("first"), F.count("*").alias("size")).where("size > 1"), "often")
    later = split_join(keyed, often, "key", "size", placed.count()).where("at > first").select("at", F.lit(True).alias("later"))
    later = scratch.table(later, "later")
    last = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    slim = placed.select("no", "at", "turn", F.substring("role", 1, 1).alias("initial"), last.alias("last")).join(later, "at", "left")
    slim = slim.repartitionByRange(n, "at").sortWithinPartitions("at")
    stretches = scratch.table(_stretches(slim), "stretches")
    meeting = stretches.groupBy("no").agg(F.array_sort(F.collect_list(F.struct("at", *[c.split()[0] for c in STRETCHES.split(", ") if c.split()[0] not in ("no", "at")]))).alias("parts"))
    decisions = scratch.table(map_batches(meeting, _met, f"no long, {FOUND.rsplit(', ', 1)[0]}"), "decisions")
    hashes = _hashes(placed, decisions, n)
    return decisions.join(hashes, "no").join(F.broadcast(numbered), "no").select(F.col("id").alias("conv_id"), *[x.split()[0] for x in FOUND.split(", ")])


def _stretches(slim: DataFrame) -> DataFrame:
    """A row for each conversation's stretch in each partition: its counts, and its table in arrays."""
    schema = arrow_schema(STRETCHES)

    def told(no, at, turns, numbers, counts, illegal, roles) -> pa.RecordBatch:
        table = table_of(turns)
        cells = [(seed, end, *least) for seed, ends in table.items() for end, least in ends.items()]
        known = [x for x in numbers if x is not None]
        row = {
            "no": no, "at": at, "n": len(turns), "low": min(known, default=None), "high": max(known, default=None), "numbers": len(set(known)), "first_turn": numbers[0], "last_turn": numbers[-1], "first_role": roles[0], "last_role": roles[-1],
            **counts, "illegal": illegal, "seeds": [c[0] for c in cells], "ends": [c[1] for c in cells], "costs": [c[2] for c in cells], "audits": [c[3] for c in cells],
        }
        return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in schema], schema=schema)

    def run(batches):
        no = at = None
        turns, numbers, roles = [], [], []
        for batch in batches:
            for own, place, turn, initial, last, later in zip(*(batch.column(c).to_pylist() for c in ("no", "at", "turn", "initial", "last", "later")), strict=True):
                if own != no:
                    if turns:
                        yield told(no, at, turns, numbers, counts, illegal, roles)
                    no, at, turns, numbers, roles, illegal, counts = own, place, [], [], [], 0, {"blank": 0, "duplicate": 0, "truncated": 0}
                wrong = fault(last, later)
                if wrong:
                    counts[wrong] += 1
                illegal += bool(roles) and roles[-1] + initial not in LEGAL
                turns.append((initial, wrong in ("blank", "duplicate"), wrong == "truncated"))
                numbers.append(turn)
                roles.append(initial)
        if turns:
            yield told(no, at, turns, numbers, counts, illegal, roles)

    return slim.mapInArrow(run, STRETCHES)


def _met(batch: pa.RecordBatch) -> Iterator[dict[str, list]]:
    """Stretches of a conversation put together."""
    for no, parts in zip(batch.column("no").to_pylist(), batch.column("parts"), strict=True):
        parts, tables = parts.as_py(), []
        for p in parts:
            table: Table = {}
            for seed, end, cost, audit in zip(p["seeds"], p["ends"], p["costs"], p["audits"], strict=True):
                table.setdefault(seed, {})[end] = (cost, audit)
            tables.append(table)
        while len(tables) > 1:  # neighbours first, so that audits are copied a few times only
            tables = [combined(*tables[i : i + 2]) if i + 1 < len(tables) else tables[i] for i in range(0, len(tables), 2)]
        cost, audit = decided(tables[0])
        known = [p for p in parts if p["low"] is not None]
        pairs = list(zip(parts, parts[1:], strict=False))
        gaps = 0
        if known:
            # turns are in order, so a number that two stretches share ends one and begins the next
            numbers = sum(p["numbers"] for p in parts) - sum(a["last_turn"] is not None and a["last_turn"] == b["first_turn"] for a, b in pairs)
            gaps = max(p["high"] for p in known) - min(p["low"] for p in known) + 1 - numbers
        illegal = sum(p["illegal"] for p in parts) + sum(a["last_role"] + b["first_role"] not in LEGAL for a, b in pairs)
        total = lambda c: [sum(p[c] for p in parts)]  # noqa: E731, B023
        yield {"no": [no], "gaps": [gaps], "blank": total("blank"), "duplicate": total("duplicate"), "truncated": total("truncated"), "illegal": [illegal], "cost": [cost], "audit": [audit]}


def _hashes(placed: DataFrame, decisions: DataFrame, n: int) -> DataFrame:
    """no, repaired_sha256: each conversation's audit, then its turns, run through one hash; none of them is held."""

    def run(batches):
        no, repair, sha, some = None, None, None, False

        def take(told) -> None:
            nonlocal some
            for role, text in told:
                sha.update((("\n" if some else "") + f"{role}:{text}").encode())
                some = True

        def ended() -> pa.RecordBatch:
            take(repair.inserted())
            return pa.RecordBatch.from_arrays([pa.array([no], pa.int64()), pa.array([sha.hexdigest()])], names=["no", "repaired_sha256"])

        for batch in batches:
            for own, role, text in zip(batch.column("no").to_pylist(), batch.column("role"), batch.column("text"), strict=True):
                if own != no:
                    if repair:
                        yield ended()
                    no, repair, sha, some = own, Repair(text.as_py()), hashlib.sha256(), False
                else:
                    take(repair.fed(role.as_py(), text.as_py()))
        if repair:
            yield ended()

    heads = decisions.select("no", F.lit(-1).cast("long").alias("at"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = heads.unionByName(placed.select("no", "at", "role", "text"))
    return both.repartition(n, "no").sortWithinPartitions("no", "at").mapInArrow(run, "no long, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with faults put in, by the crc32 of `conv_id:turn` modulo 20: 0 drops a turn, 1 empties it, 2 takes its ends of sentences, 3 repeats it, 4 makes it a user's. Nulls are one space."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind, text = F.crc32(key) % 20, F.coalesce("text", F.lit(" "))
    changed = turns.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"), F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), kind.alias("kind")
    )
    return changed.where("kind <> 0").withColumn("kind", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("kind")


def repaired_digests(turns: DataFrame) -> DataFrame:
    """repair() after damaged(), with a row for each conversation of turns, those that lost all rows too."""
    found = repair(damaged(turns)).withColumnRenamed("conv_id", "id")
    every = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    named = [x.split() for x in FOUND.split(", ")]
    none = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return joined.select("conv_id", *[F.coalesce(c, F.lit(none.get(c, 0)).cast(kind)).alias(c) for c, kind in named])


def _crc32(text: str) -> str:
    """crc32 of an ASCII text as DuckDB SQL; needs the table `crc`."""
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({text}, ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: xor(c >> 8, crc.x[(xor(c, b) & 255) + 1])), CAST(4294967295 AS BIGINT))"


_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE = f"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY b) AS x FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END) AS c FROM range(256) AS t(b))),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM k WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || ':' || text), copy) AS i, rtrim(text, {_SPACES}) AS e FROM d),
w AS (SELECT *, CASE WHEN e = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN e[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  i > 1 AND lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] NOT IN ('su', 'ua', 'au') AS illegal FROM o),
ins(a, b, inserted, told) AS (VALUES ('E', 'E', '', ''), ('E', 'H', 'I', 'user:' || chr(10)), ('E', 'W', 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), ('L', 'L', '', ''), ('L', 'H', 'I', 'user:' || chr(10)),
  ('L', 'W', 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), ('H', 'H', '', ''), ('H', 'W', 'I', 'assistant:' || chr(10)), ('W', 'W', '', ''), ('W', 'H', 'I', 'user:' || chr(10))),
moves(a, b, initial, role) AS (VALUES ('E', 'L', 's', NULL), ('E', 'H', 'u', 'user'), ('L', 'H', 'u', 'user'), ('W', 'H', 'u', 'user'), ('H', 'W', 'a', 'assistant'), ('E', 'E', NULL, NULL), ('L', 'L', NULL, NULL), ('H', 'H', NULL, NULL), ('W', 'W', NULL, NULL)),
s AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 'E' AS state, {{'cost': 0, 'audit': '', 'told': ''}} AS v FROM w
UNION ALL
  SELECT conv_id, i, b, min({{'cost': cost, 'audit': audit, 'told': told}}) FROM (
    SELECT s.conv_id, w.i, m.b, s.v.cost + 2 * length(ins.inserted) + CASE WHEN m.initial IS NULL THEN 3 ELSE CAST(fault = 'truncated' AS INTEGER) + CASE WHEN w.role[1] = m.initial THEN 0 ELSE 2 END END AS cost,
      s.v.audit || ins.inserted || CASE WHEN m.initial IS NULL THEN 'D' WHEN w.role[1] = m.initial THEN 'K' ELSE 'R' END AS audit,
      s.v.told || ins.told || CASE WHEN m.initial IS NULL THEN '' WHEN w.role[1] = m.initial THEN w.role || ':' || w.text || chr(10) ELSE m.role || ':' || w.text || chr(10) END AS told
    FROM s JOIN w ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = s.i + 1 JOIN ins ON ins.a = s.state JOIN moves AS m ON m.a = ins.b
    WHERE m.initial IS NULL OR fault NOT IN ('blank', 'duplicate') AND (w.role[1] = m.initial OR m.role IS NOT NULL)) GROUP BY conv_id, i, b),
n AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM w GROUP BY conv_id),
z AS (SELECT s.conv_id, min({{'cost': s.v.cost + 2 * length(ins.inserted), 'audit': s.v.audit || ins.inserted, 'told': s.v.told || ins.told}}) AS v FROM s JOIN n ON s.conv_id IS NOT DISTINCT FROM n.conv_id AND s.i = n.n JOIN ins ON ins.a = s.state AND ins.b IN ('E', 'W') GROUP BY s.conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(z.v.cost, 0) AS BIGINT) AS cost, coalesce(z.v.audit, '') AS audit,
  sha256(coalesce(substr(z.v.told, 1, length(z.v.told) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN n ON c.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN z ON c.conv_id IS NOT DISTINCT FROM z.conv_id"""
