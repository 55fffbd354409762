"""Cheapest repair of conversation structure, by lazy determinisation of a weighted automaton.

A repaired conversation has role initials (s?(ua)+)?: an automaton of four states. Reading a conversation from its last
row to its first, the costs to finish from each state are a vector. Less its least entry, a vector is a state of a
deterministic automaton; its transitions are computed once for each kind of row and kept in a table. So a scan of the table
gives the costs of a conversation, and a walk back over the scan, from the first row to the last, follows arcs that lose
nothing, the first letter of the alphabet where several do: that is the audit.

Rows are put in order by ranges, so a conversation of any length is spread over tasks. Blocks of a conversation that lies in
several are summed up by the costs between their states, folded from the right, and walked from the left.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States: at the start, after a system, user and assistant row. What a user or assistant row leads to, and where one may end.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES, NEXT, FINAL = 4, (USER, USER, ASSISTANT, USER), (0, 1 << 40, 1 << 40, 0)
NEVER = 1 << 40
#: Kinds of rows: the role's initial (none of s, u, a; s; u; a), plus 4 if the row must go, plus 8 if it is truncated.
MUST_GO, CUT_OFF = 4, 8
#: A block of one conversation holds so many rows, or bytes of text, at most.
BLOCK_ROWS, BLOCK_BYTES = 20_000, 8 << 20
_BLANK, _ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"


def _inserted(v: list[int]) -> tuple[int, ...]:
    """Costs from each state if rows may be inserted first."""
    u, a = min(v[USER], INSERT + v[ASSISTANT]), min(v[ASSISTANT], INSERT + v[USER])
    return tuple(min(x, NEVER) for x in (min(v[START], INSERT + u), min(v[SYSTEM], INSERT + u), u, a))


def _arcs(kind: int, q: int) -> Iterator[tuple[str, int, int]]:
    """The edits of a row in state q, in the order of their letters: letter, cost, next state. Inserts come between D and K."""
    yield "D", DELETE, q
    if not kind & MUST_GO:
        more = TRUNCATED if kind & CUT_OFF else 0
        role = kind & 3
        if role == SYSTEM and q == START or role > SYSTEM and role == NEXT[q]:
            yield "K", KEEP + more, role
        yield "R", REROLE + more, NEXT[q]


class Automaton:
    """Deterministic states, which are vectors of costs with least entry 0, and the table of what is known of them."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.table: list[list[tuple[int, int] | None]] = []
        self.moves: dict[tuple[int, int], list[tuple[str, int]]] = {}

    def state(self, v: tuple[int, ...]) -> tuple[int, int]:
        """The state of a vector, and what was taken off."""
        least = min(v)
        v = tuple(x - least if x < NEVER else NEVER for x in v)
        if v not in self.number:
            self.number[v] = len(self.vectors)
            self.vectors.append(v)
            self.table.append([None] * 12)
        return self.number[v], least

    def step(self, s: int, kind: int) -> tuple[int, int]:
        v = self.vectors[s]
        self.table[s][kind] = self.state(_inserted([min(cost + v[p] for _, cost, p in _arcs(kind, q)) for q in range(STATES)]))
        return self.table[s][kind]

    def scan(self, kinds: bytes, end: tuple[int, ...]) -> tuple[list[int], int]:
        """The states before each row and after the last, and the costs to add to the first one's vector."""
        s, total = self.state(end)
        table, out = self.table, [s]
        for kind in reversed(kinds):
            s, add = table[s][kind] or self.step(s, kind)
            total += add
            out.append(s)
        out.reverse()
        return out, total

    def best(self, s: int, kind: int) -> list[tuple[str, int]]:
        """From each state before a row of this kind, after which s holds: the least letters of the arcs that lose nothing, and the next state."""
        if (s, kind) not in self.moves:
            (before, add), after, out = self.table[s][kind], self.vectors[s], []
            now = [x + add for x in self.vectors[before]]
            for q in range(STATES):
                letters = ""
                while True:
                    tight = [(a, p) for a, cost, p in _arcs(kind, q) if now[q] == cost + after[p]]
                    if now[q] == INSERT + now[NEXT[q]]:
                        tight.append(("I", NEXT[q]))
                    a, q = min(tight)
                    letters += a
                    if a != "I":
                        break
                out.append((letters, q))
            self.moves[s, kind] = out
        return self.moves[s, kind]

    def walk(self, kinds: bytes, states: list[int], q: int) -> tuple[list[str], int]:
        """The letters of each row on the walk from state q, and the state after the last row."""
        moves, out = self.moves, []
        for s, kind in zip(states[1:], kinds, strict=True):
            letters, q = (moves.get((s, kind)) or self.best(s, kind))[q]
            out.append(letters)
        return out, q


_automaton = Automaton()
END = _inserted(list(FINAL))


def _between(kinds: bytes) -> list[int]:
    """The least costs from each state before the rows (major) to each state after them."""
    columns = []
    for p in range(STATES):
        states, total = _automaton.scan(kinds, tuple(0 if q == p else NEVER for q in range(STATES)))
        columns.append([min(x + total, NEVER) for x in _automaton.vectors[states[0]]])
    return [columns[p][q] for q in range(STATES) for p in range(STATES)]


def _last(q: int) -> str:
    """The inserts after the last row."""
    return {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}[q]


def _written(kinds: bytes, places: list[int], roles: list[str], texts: list[str], states: list[int], q: int, last: bool) -> tuple[str, list[str]]:
    """The audit and the lines of a walk. places: which of the roles and texts a row has."""
    letters, end = _automaton.walk(kinds, states, q)
    lines = []
    for row, place in zip([*letters, _last(end)] if last else letters, [*places, 0] if last else places, strict=True):
        for a in row:
            if a == "D":
                continue
            if a == "K":
                lines.append(f"{roles[place]}:{texts[place]}")
                q = _role(roles[place])
                continue
            q = NEXT[q]
            lines.append(("user:" if q == USER else "assistant:") + (texts[place] if a == "R" else ""))
    return "".join(letters) + (_last(end) if last else ""), lines


def _role(role: str) -> int:
    return "sua".find(role[:1]) + 1 if role else 0


_BLOCK = pa.schema([
    ("conv_id", pa.int64()), ("pid", pa.int32()), ("idx", pa.int32()), ("open", pa.bool_()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
    ("first", pa.string()), ("last", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("lines", pa.list_(pa.string())),
    ("between", pa.list_(pa.int64())), ("kinds", pa.binary()), ("places", pa.list_(pa.int32())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
])
_BLOCK_SQL = (
    "conv_id long, pid int, idx int, open boolean, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, cost long, "
    "audit string, lines array<string>, between array<long>, kinds binary, places array<int>, roles array<string>, texts array<string>"
)


def _pair_is_legal(x: str, y: str) -> bool:
    return x + y in ("su", "ua", "au")


class _Block:
    """Rows of one conversation that follow one another."""

    def __init__(self, conv: int | None, idx: int) -> None:
        self.conv, self.idx, self.size = conv, idx, 0
        self.kinds, self.places, self.roles, self.texts = bytearray(), [], [], []
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.first = self.last = self.low = self.high = None

    def add(self, turn: int | None, role: str, text: str, times: int, blank: bool, seen: bool, ended: bool) -> None:
        """A row that stands here `times` times; all but the first are repeats."""
        c, initial = self.counts, role[:1]
        kind = _role(role) | (MUST_GO if blank or seen else 0 if ended else CUT_OFF)
        c["blank"] += times if blank else 0
        c["duplicate"] += 0 if blank else times - (not seen)
        c["truncated"] += kind >= CUT_OFF
        c["illegal"] += (self.last is not None and not _pair_is_legal(self.last, initial)) + (times - 1)
        if turn is not None and turn != self.high:
            c["turns"] += 1
            self.high = turn
            self.low = turn if self.low is None else self.low
        self.first = initial if self.first is None else self.first
        self.last = initial
        self.kinds += bytes([kind]) + bytes([MUST_GO]) * (times - 1)
        self.places += [len(self.roles)] * times
        self.roles.append(role)
        self.texts.append("" if kind & MUST_GO else text)
        self.size += len(self.texts[-1])

    def full(self) -> bool:
        return len(self.kinds) >= BLOCK_ROWS or self.size >= BLOCK_BYTES

    def row(self, pid: int, open_: bool) -> dict:
        kinds = bytes(self.kinds)
        out = dict(conv_id=self.conv, pid=pid, idx=self.idx, open=open_, first=self.first, last=self.last, low=self.low, high=self.high, **self.counts)
        if open_:
            return out | dict(between=_between(kinds), kinds=kinds, places=self.places, roles=self.roles, texts=self.texts)
        states, total = _automaton.scan(kinds, END)
        audit, lines = _written(kinds, self.places, self.roles, self.texts, states, START, True)
        return out | dict(cost=total + _automaton.vectors[states[0]][START], audit=audit, lines=lines)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order. A conversation that neither opens nor ends the partition and fits into one block is finished here."""
    pid, held, now, begun, cut, seen = TaskContext.get().partitionId(), [], None, 0, False, False
    names = ("conv_id", "turn", "role", "text", "n", "blank", "ended", "seen")
    for batch in batches:
        for conv, turn, role, text, n, blank, ended, mark in zip(*(batch.column(x).to_pylist() for x in names), strict=True):
            if mark:
                seen = True
                continue
            if now is not None and (now.conv != conv or now.full()):
                same = now.conv == conv
                held.append(now.row(pid, same or cut or begun == 1))
                cut, now = same, _Block(conv, now.idx + 1)
                begun += not same
            if now is None:
                now, begun = _Block(conv, 0), 1
            while n > 0:
                part = min(n, BLOCK_ROWS)
                now.add(turn, role, text, part, blank, seen, ended)
                seen, n = True, n - part
                if n:
                    held.append(now.row(pid, True))
                    cut, now = True, _Block(conv, now.idx + 1)
            seen = False
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=_BLOCK)
            held = []
    if now is not None:
        yield pa.RecordBatch.from_pylist([now.row(pid, True)], schema=_BLOCK)


def _from_right(table: pa.Table) -> pa.Table:
    """The blocks of one conversation: the vector after each, and the conversation's costs with the first."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["pid"], r["idx"]), reverse=True)
    after, out = END, []
    for i, r in enumerate(rows):
        m = r["between"]
        before = [min(m[STATES * q + p] + after[p] for p in range(STATES)) for q in range(STATES)]
        out.append({"pid": r["pid"], "idx": r["idx"], "after": after, "cost": before[START] if i == len(rows) - 1 else 0, "final": i == 0})
        after = tuple(min(x, NEVER) for x in before)
    return pa.Table.from_pylist(out, schema=pa.schema([("pid", pa.int32()), ("idx", pa.int32()), ("after", pa.list_(pa.int64())), ("cost", pa.int64()), ("final", pa.bool_())]))


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the walk through a block ends, from each state."""
    for batch in batches:
        ends = []
        for kinds, after in zip(batch.column("kinds").to_pylist(), batch.column("after").to_pylist(), strict=True):
            states, _ = _automaton.scan(kinds, tuple(after))
            ends.append([_automaton.walk(kinds, states, q)[1] for q in range(STATES)])
        yield pa.RecordBatch.from_arrays([batch.column(x) for x in ("conv_id", "pid", "idx", "first", "last", "low", "high")] + [pa.array(ends, pa.list_(pa.int32()))], names=["conv_id", "pid", "idx", "first", "last", "low", "high", "ends"])


def _from_left(table: pa.Table) -> pa.Table:
    """The blocks of one conversation: the state before each, pairs of roles across its start, and a turn that began before it."""
    q, role, turn, out = START, None, None, []
    for r in sorted(table.to_pylist(), key=lambda r: (r["pid"], r["idx"])):
        there = r["first"] is not None
        across = there and role is not None and not _pair_is_legal(role, r["first"])
        out.append({"pid": r["pid"], "idx": r["idx"], "entry": q, "across": int(across), "again": int(r["low"] is not None and r["low"] == turn)})
        q, role, turn = r["ends"][q], r["last"] if there else role, turn if r["high"] is None else r["high"]
    return pa.Table.from_pylist(out, schema=pa.schema([(c, pa.int32()) for c in ("pid", "idx", "entry", "across", "again")]))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audit and lines of each block, from the state that the walk enters it with."""
    names = ("kinds", "places", "roles", "texts", "after", "entry", "final")
    for batch in batches:
        rows = [(_written(kinds, places, roles, texts, _automaton.scan(kinds, tuple(after))[0], entry, final)) for kinds, places, roles, texts, after, entry, final in zip(*(batch.column(x).to_pylist() for x in names), strict=True)]
        kept = [c for c in batch.schema.names if c not in names]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array([a for a, _ in rows]), pa.array([t for _, t in rows], pa.list_(pa.string()))], names=[*kept, "audit", "lines"])


def ordered(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n, blank, ended, seen: different rows in order over ranges, n of each. A row with `seen` has no
    text: it says that the next one's role and text stood in an earlier turn, so that texts move but twice."""
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    texts = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("n"))
    texts = texts.select("conv_id", "turn", "role", "text", "n", (~F.rlike("text", F.lit(_BLANK))).alias("blank"), F.rlike("text", F.lit(_ENDED)).alias("ended"), F.lit(False).alias("seen"), digest)
    turn = F.struct(F.isnotnull("turn").alias("some"), F.col("turn").alias("turn"))
    short = rows.filter("times > 0").select("conv_id", "turn", "role", digest).distinct()
    often = short.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(turn).alias("first"), F.count("*").alias("m")).filter("m > 1")
    again = short.join(often, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))).filter(turn > F.col("first"))
    marks = again.select("conv_id", "turn", "role", F.lit(None).cast("string"), F.lit(0).cast("long"), F.lit(False), F.lit(False), F.lit(True), "digest")
    key = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    return texts.unionAll(marks).repartitionByRange(*key).sortWithinPartitions(*key, F.col("seen").desc()).drop("digest")


def repair(conversations: DataFrame, times: str | None = None) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired.

    conversations: conv_id, turn (integers), role, text; other columns are not read. `times` names a column that says how often
    a row stands there; with 0 it does not, but its conversation is still listed. Null roles and texts count as one space; null
    turns come first; rows of one turn are ordered by role, then by the SHA-256 of their texts; all rows without a conv_id are
    one conversation; an empty role has no initial, so such a row cannot be kept. A conversation without rows has counts of 0,
    an empty audit and an empty text. Of equal rows, which are counted before they are sent, all but one are duplicates.
    Very long texts and conversations are whole; a conversation of more than one block has one row in the result, which holds all
    of its audit and repaired text. An empty table gives an empty result.
    """
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"), (F.col(times) if times else F.lit(1)).cast("long").alias("times"))
    found = stored(ordered(rows).mapInArrow(_blocks, _BLOCK_SQL))
    counts = ["blank", "duplicate", "truncated", "illegal"]
    whole = found.filter("NOT open").select("conv_id", *counts, "low", "high", "turns", "cost", "audit", F.array_join("lines", "\n").alias("repaired"))

    blocks = found.filter("open").drop("cost", "audit", "lines")
    after = blocks.select("conv_id", "pid", "idx", "between").groupBy("conv_id").applyInArrow(_from_right, "pid int, idx int, after array<long>, cost long, final boolean")
    blocks = stored(blocks.drop("between").join(after, ["pid", "idx"]))
    ways = blocks.select("conv_id", "pid", "idx", "first", "last", "low", "high", "kinds", "after").mapInArrow(_ways, "conv_id long, pid int, idx int, first string, last string, low long, high long, ends array<int>")
    entered = ways.groupBy("conv_id").applyInArrow(_from_left, "pid int, idx int, entry int, across int, again int")
    given = blocks.drop("first", "last").join(entered, ["pid", "idx"])
    kept = [c for c in given.columns if c not in ("kinds", "places", "roles", "texts", "after", "entry", "final")]
    types = {f.name: f.dataType.simpleString() for f in given.schema}
    pieces = given.mapInArrow(_pieces, ", ".join(f"{c} {types[c]}" for c in kept) + ", audit string, lines array<string>")
    part = F.sort_array(F.collect_list(F.struct("pid", "idx", "audit", "lines")))
    sums = [F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"), F.sum("truncated").alias("truncated"), F.sum(F.col("illegal") + F.col("across")).alias("illegal")]
    joined = pieces.groupBy("conv_id").agg(*sums, F.min("low").alias("low"), F.max("high").alias("high"), F.sum(F.col("turns") - F.col("again")).alias("turns"), F.sum("cost").alias("cost"), part.alias("p"))
    split = joined.select("conv_id", *counts, "low", "high", "turns", "cost", F.array_join("p.audit", "").alias("audit"), F.array_join(F.flatten("p.lines"), "\n").alias("repaired"))
    gaps = F.coalesce(F.try_subtract(F.try_add(F.try_subtract("high", "low"), F.lit(1)), F.col("turns")), F.lit(0)).alias("gaps")
    return whole.unionAll(split).select("conv_id", gaps, *counts, "cost", "audit", "repaired")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with a fault in each of five of twenty classes of crc32(conv_id:turn), and how often they stand there."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    part = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.when(part.isin(0, 1), "").when(part == 2, F.regexp_replace(name("text"), "[.!?]", "")).otherwise(name("text"))
    role = F.when(part.isin(0, 4), "user").otherwise(name("role"))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(part == 0, 0).when(part == 3, 2).otherwise(1).alias("times"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of all conversations after the damage."""
    fixed = repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), times="times")
    return fixed.withColumn("repaired_sha256", F.sha2("repaired", 256)).drop("repaired")


#: The least of (cost, audit) from each state, row by row from the last; a key is the cost, filled to ten digits, then the
#: audit. DuckDB has no CRC-32, so its table is derived here, and a crc is taken sign by sign.
OP12_SQL = r"""
WITH RECURSIVE bits(i, k, c) AS (SELECT i::UBIGINT, 0, i::UBIGINT FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM bits WHERE k < 8),
lookup AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
keys AS (SELECT DISTINCT conv_id, turn, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
parts AS (SELECT conv_id, turn, xor(list_reduce(list_prepend(4294967295::UBIGINT, [ascii(x)::UBIGINT FOR x IN string_split(s, '')]), lambda c, b: xor(c >> 8, t[(xor(c, b) % 256 + 1)::BIGINT])), 4294967295::UBIGINT) % 20 AS part FROM keys, lookup),
given AS (SELECT c.conv_id, c.turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, part FROM conversations c JOIN parts p ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.turn IS NOT DISTINCT FROM p.turn WHERE part <> 0),
hurt AS (SELECT conv_id, turn, CASE WHEN part = 4 THEN 'user' ELSE role END AS role, CASE part WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN part = 3 THEN 2 ELSE 1 END)) AS copy FROM given),
placed AS (SELECT *, row_number() OVER w AS pos, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen, lag(left(role, 1)) OVER w || left(role, 1) AS pair, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS ended
  FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
kinds AS (SELECT *, blank OR seen AS gone, NOT (blank OR seen OR ended) AS cut, left(role, 1) AS r FROM placed),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (seen AND NOT blank) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n FROM kinds GROUP BY 1),
walk(conv_id, pos, q0, q1, q2, q3) AS (
  SELECT conv_id, n + 1, {'k': '0000000000', 't': ''}, {'k': '0000000010II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}, {'k': '0000000005I', 't': chr(10) || 'assistant:'}, {'k': '0000000000', 't': ''} FROM counts
  UNION ALL
  SELECT conv_id, pos, least(a0, add5(a2, 'user')), least(a1, add5(a2, 'user')), a2, a3 FROM (
    SELECT conv_id, pos, a0, a1, least(b2, add5(b3, 'assistant')) AS a2, least(b3, add5(b2, 'user')) AS a3 FROM (
      SELECT w.conv_id, k.pos,
        least(edit(q0, 2, 'D', NULL), CASE WHEN NOT gone AND r = 's' THEN edit(q1, x, 'K', line) END, CASE WHEN NOT gone AND r = 'u' THEN edit(q2, x, 'K', line) END, CASE WHEN NOT gone THEN edit(q2, x + 1, 'R', 'user:' || text) END) AS a0,
        least(edit(q1, 2, 'D', NULL), CASE WHEN NOT gone AND r = 'u' THEN edit(q2, x, 'K', line) END, CASE WHEN NOT gone THEN edit(q2, x + 1, 'R', 'user:' || text) END) AS a1,
        least(edit(q2, 2, 'D', NULL), CASE WHEN NOT gone AND r = 'a' THEN edit(q3, x, 'K', line) END, CASE WHEN NOT gone THEN edit(q3, x + 1, 'R', 'assistant:' || text) END) AS b2,
        least(edit(q3, 2, 'D', NULL), CASE WHEN NOT gone AND r = 'u' THEN edit(q2, x, 'K', line) END, CASE WHEN NOT gone THEN edit(q2, x + 1, 'R', 'user:' || text) END) AS b3
      FROM walk w JOIN (SELECT *, CASE WHEN cut THEN 5 ELSE 0 END AS x, role || ':' || text AS line FROM kinds) k ON w.conv_id IS NOT DISTINCT FROM k.conv_id AND k.pos = w.pos - 1)))
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(left(q0.k, 10)::BIGINT, 0) AS cost, coalesce(q0.k[11:], '') AS audit, sha256(coalesce(q0.t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN walk w ON o.conv_id IS NOT DISTINCT FROM w.conv_id AND w.pos = 1
"""


def _spelled(sql: str) -> str:
    """The SQL without its two shorthands: edit(q, cost, letter, line) puts an edit in front, add5(q, role) an inserted row."""
    import re

    edit = r"""{'k': printf('%010d', left(\1.k, 10)::BIGINT + \2) || '\3' || \1.k[11:], 't': coalesce(chr(10) || \4, '') || \1.t}"""
    sql = re.sub(r"edit\((q\d), ([^,]+), '(\w)', ((?:[^()])*?)\)", edit, sql)
    return re.sub(r"add5\((\w\d), '(\w+)'\)", r"""{'k': printf('%010d', left(\1.k, 10)::BIGINT + 5) || 'I' || \1.k[11:], 't': chr(10) || '\2:' || \1.t}""", sql)


OP12_SQL = _spelled(OP12_SQL)
