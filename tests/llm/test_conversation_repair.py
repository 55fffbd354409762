"""Cheapest repairs against a search over all edits, whole and cut into blocks."""

import hashlib
import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import conversation_repair as R

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def brute(rows):
    """Counts, cost, audit and text of rows in order, by the least (cost, audit) from each state."""
    seen, kinds, lines = set(), [], []
    counts = dict(blank=0, duplicate=0, truncated=0, illegal=0)
    for i, (_, role, text) in enumerate(rows):
        fault = "blank" if not text.strip(SPACE) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(SPACE)[-1] not in ".!?" else None
        seen.add((role, text))
        kinds.append(fault)
        if fault:
            counts[fault] += 1
        counts["illegal"] += i > 0 and rows[i - 1][1][:1] + role[:1] not in ("su", "ua", "au")
    after = {"": "u", "s": "u", "u": "a", "a": "u"}

    def inserts(best):
        for _ in range(3):
            for q, p in after.items():
                c, audit, text = best[p]
                best[q] = min(best[q], (c + 5, "I" + audit, [("user:" if p == "u" else "assistant:"), *text]))
        return best

    no = (10**9, "", [])
    best = inserts({"": (0, "", []), "s": no, "u": no, "a": (0, "", [])})
    for (_, role, text), fault in zip(rows[::-1], kinds[::-1]):
        now = {}
        for q, p in after.items():
            ways = [(best[q][0] + 2, "D" + best[q][1], best[q][2])]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                name = "user" if p == "u" else "assistant"
                ways.append((best[p][0] + 1 + more, "R" + best[p][1], [f"{name}:{text}", *best[p][2]]))
                if role[:1] == p or (q == "" and role[:1] == "s"):
                    r = role[:1]
                    ways.append((best[r][0] + more, "K" + best[r][1], [f"{role}:{text}", *best[r][2]]))
            now[q] = min(ways)
        best = inserts(now)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *counts.values(), best[""][0], best[""][1], "\n".join(best[""][2])


def arranged(rows):
    out = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))


def talks(n, seed, most=14):
    rng = random.Random(seed)
    roles = ["user", "user", "assistant", "assistant", "system", "tool", "", None, "assistant "]
    texts = ["Yes.", "No!", "why?", "cut off", "", " \n", None, "one. ", "zwei", "ü.", "two\nlines."]
    return {c: [(rng.choice([None, *range(8)]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"text {rng.randrange(99)}" + rng.choice([".", "!", ""])) for _ in range(rng.randrange(1, most))] for c in [None, *range(n)]}


def frame(spark, by, parts=3):
    rows = [(c, *r) for c, rs in by.items() for r in rs]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("n", "times", "digest", "pid", "open", "cost", "audit")}).repartition(parts)


def check(got, by):
    got = [tuple(r) for r in got]
    assert len(got) == len(by)
    for c, *rest in got:
        assert tuple(rest) == brute(arranged(by[c])), c


def test_random_conversations(spark):
    by = talks(150, 1)
    check(R.repair(frame(spark, by)).collect(), by)


@pytest.mark.parametrize("rows", [1, 3, 7])
def test_conversations_in_blocks(spark, monkeypatch, rows):
    monkeypatch.setattr(R, "BLOCK_ROWS", rows)
    by = talks(25, 2, 40)
    frame_ = frame(spark, by)  # put in order by Spark, cut in this process, as workers do not see the smaller blocks

    class Here:
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(R, "TaskContext", type("T", (), {"get": staticmethod(Here)}))
    ready = R.ordered(frame_.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).cast("long").alias("times"))).toArrow()
    found = [r for b in R._blocks(iter(ready.to_batches(max_chunksize=5))) for r in b.to_pylist()]
    merged = {}
    for r in found:
        merged.setdefault(r["conv_id"], []).append(r)
    for c, rs in merged.items():
        want = brute(arranged(by[c]))
        if not rs[0]["open"]:
            assert len(rs) == 1 and (rs[0]["cost"], rs[0]["audit"], "\n".join(rs[0]["lines"])) == want[-3:]
            continue
        right = R._from_right(pa.Table.from_pylist([{k: r[k] for k in ("conv_id", "pid", "idx", "between")} for r in rs])).to_pylist()
        after = {r["idx"]: r for r in right}
        walk = []
        for r in rs:
            states, _ = R._automaton.scan(r["kinds"], tuple(after[r["idx"]]["after"]))
            walk.append({**r, "ends": [R._automaton.walk(r["kinds"], states, q)[1] for q in range(4)]})
        left = {r["idx"]: r for r in R._from_left(pa.Table.from_pylist(walk, schema=pa.schema([*R._BLOCK, ("ends", pa.list_(pa.int32()))]))).to_pylist()}
        parts = [R._written(r["kinds"], r["places"], r["roles"], r["texts"], R._automaton.scan(r["kinds"], tuple(after[r["idx"]]["after"]))[0], left[r["idx"]]["entry"], after[r["idx"]]["final"]) for r in rs]
        assert sum(a["cost"] for a in right) == want[-3] and "".join(a for a, _ in parts) == want[-2] and "\n".join(x for _, lines in parts for x in lines) == want[-1]
        assert sum(r["illegal"] + left[r["idx"]]["across"] for r in rs) == want[4]


def test_one_long_conversation_over_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = random.Random(5)
        by = {7: [(i, rng.choice(["user", "assistant", "tool"]), f"t{rng.randrange(2000)}" + rng.choice([".", ""])) for i in range(3000)], 8: [(1, "user", "a.")], 6: [(1, "assistant", "b.")]}
        ready = R.ordered(frame(spark, by).withColumn("times", F.lit(1).cast("long")))
        assert sum(ready.select(F.spark_partition_id().alias("p"), "conv_id").filter("conv_id = 7").groupBy("p").count().count() for _ in range(1)) >= 3
        check(R.repair(frame(spark, by)).collect(), by)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repeated_rows_and_left_out_ones(spark):
    rows = [(1, 0, "user", "Hi.", 3), (1, 1, "assistant", "Yes.", 1), (2, 0, "user", "gone.", 0), (3, None, None, None, 2)]
    df = spark.createDataFrame(rows, SCHEMA + ", times int")
    got = {r.conv_id: tuple(r)[1:] for r in R.repair(df, times="times").collect()}
    assert got[2] == (0, 0, 0, 0, 0, 0, "", "")
    assert got[1] == brute([(0, "user", "Hi.")] * 3 + [(1, "assistant", "Yes.")])
    assert got[3] == brute([(None, " ", " ")] * 2)
    many = spark.createDataFrame([(1, 0, "user", "Hi.", 50_000)], SCHEMA + ", times int")
    (r,) = R.repair(many, times="times").collect()
    assert (r.duplicate, r.illegal, r.cost, len(r.audit)) == (49_999, 49_999, 100_000, 50_000)


def test_empty_and_very_long(spark):
    assert R.repair(spark.createDataFrame([], SCHEMA)).count() == 0
    long = spark.createDataFrame([(1, 0, "user", "word " * 4_000_000 + "end."), (1, 1, "assistant", "yes.")], SCHEMA)
    (r,) = R.repair(long).select("cost", "audit", F.sha2("repaired", 256).alias("d"), F.length("repaired").alias("n")).collect()
    assert (r.cost, r.audit) == (0, "KK")
    assert r.n == len("user:") + 20_000_004 + len("\nassistant:yes.")


def test_damage(spark):
    rows = [(c, t, r, x) for c in [None, *range(40)] for t, r, x in [(None, "assistant", "A. b!"), (0, None, None), (1, "tool", "c? d.")]]
    got = {(r.conv_id, r.turn): r for r in R.damaged(spark.createDataFrame(rows, SCHEMA)).collect()}
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r = got[c, t]
        assert r.times == {0: 0, 3: 2}.get(k, 1)
        if k > 0:
            want = " " if text is None else text
            assert r.role == ("user" if k == 4 else role or " ") and r.text == ("" if k == 1 else "".join(x for x in want if x not in ".!?") if k == 2 else want)
