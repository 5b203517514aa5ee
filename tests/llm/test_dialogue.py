import hashlib
import itertools
import random
import re
import zlib

import duckdb
from pyspark.sql import functions as F

from siltstone.llm import dialogue as D
from siltstone.llm.queries import ORACLE_SQL, op12_dijkstra_repair

GRAMMAR = re.compile(r"(s?(ua)+)?")


def simulate(initials, faults, edits):
    """(cost, initials) of a sequence of edits whose inserts and reroles take letter by letter, or None."""
    i, cost = 0, 0
    options = [""]
    for e in edits:
        if e == "I":
            options, cost = [o + x for o in options for x in "ua"], cost + 2
            continue
        if i == len(initials):
            return None
        if e == "D":
            cost += 3
        elif faults[i] in (1, 2):
            return None
        else:
            cost += (e == "R") * 2 + (faults[i] == 3)
            options = [o + x for o in options for x in (initials[i] if e == "K" else "ua")]
        i += 1
    if i < len(initials) or not any(GRAMMAR.fullmatch(o) for o in options):
        return None
    return cost


def brute(initials, faults):
    n, best = len(initials), None
    for length in range(n, n + 5):
        for edits in itertools.product("DIKR", repeat=length):
            if (cost := simulate(initials, faults, edits)) is not None:
                best = min(x for x in (best, (cost, "".join(edits))) if x)
    return best


def test_edits_equal_brute_force():
    rng = random.Random(5)
    for n in range(4):
        for _ in range(12):
            initials, faults = rng.choices("suatx", k=n), rng.choices(range(4), [5, 1, 1, 2], k=n)
            assert D.cheapest_edits(initials, faults) == brute(initials, faults), (initials, faults)


def layered(initials, faults):
    """The same by a dynamic programme over rows, audits as strings."""
    steps = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def closed(now):
        for _ in range(3):
            for (state, letter), to in steps.items():
                if letter in "ua" and state in now:
                    c, a = now[state]
                    now[to] = min(now.get(to, (10**9, "")), (c + 2, a + "I"))
        return now

    now = closed({"0": (0, "")})
    for letter, fault in zip(initials, faults, strict=True):
        new = {s: (c + 3, a + "D") for s, (c, a) in now.items()}
        if fault not in (1, 2):
            for (state, to_letter), to in steps.items():
                if state in now:
                    c, a = now[state]
                    for e, k in (("K", 0),) * (to_letter == letter) + (("R", 2),) * (to_letter in "ua"):
                        new[to] = min(new.get(to, (10**9, "")), (c + k + (fault == 3), a + e))
        now = closed(new)
    return min(now[s] for s in ("0", "a") if s in now)


def test_long_conversations():
    rng = random.Random(6)
    for n in (50, 400, 3000):
        initials, faults = rng.choices("suat", [1, 5, 5, 1], k=n), rng.choices(range(4), [8, 1, 1, 2], k=n)
        assert D.cheapest_edits(initials, faults) == layered(initials, faults)
    assert D.cheapest_edits(["u", "a"] * 5000, [0] * 10000) == (0, "K" * 10000)
    assert D.cheapest_edits(["u"] * 2001, [2] * 2001) == (6003, "D" * 2001)


def test_repaired_rows():
    rows = [("system", "S."), ("user", "A."), ("user", "A."), ("user", "B?"), ("robot", "C"), ("user", " ")]
    faults = D.faults_of(rows)
    assert faults == [0, 0, 2, 0, 3, 1]
    cost, audit = D.cheapest_edits([r[:1] for r, _ in rows], faults)
    fixed = D.repaired(rows, audit)
    assert GRAMMAR.fullmatch("".join(r[0] for r, _ in fixed)) and cost == 3 + 1 + 3 + min(2 + 2, 9)
    assert D.repaired([], "II") == [("user", ""), ("assistant", "")]


def cases():
    rng = random.Random(7)
    texts = ["Yes.", "No", "Why?", "", " \n", "Done! ", "x.\x0b", "é", "a.b", "\x00"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(texts)) for c in range(60) for t in range(rng.randint(1, 7))]
    rows += [(None, t, "user", "Q?") for t in range(4)] + [(100, None, "user", "n."), (100, None, None, None), (100, 5, "assistant", None), (100, 9, "", "z.")]
    rows += [(101, None, "user", "only nulls.")] + [(102, 3, r, "tie.") for r in ("user", "assistant", "user")]
    gone = [c for c in range(1000, 3000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    rows += [(c, 0, "user", "Lost.") for c in gone] + [(200, t, "user" if t % 2 == 0 else "assistant", f"long {t}." + " word" * 40 + ".") for t in range(600)]
    rows += [(300, 0, "user", "x" * 3_000_000 + ".")]
    return rows


def key(rows):
    return sorted(map(tuple, rows), key=repr)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_equals_the_sql_and_keeps_messages(spark):
    rows = cases()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("copies", F.lit("clash")).withColumn("audit", F.lit(1))
    d = D.damaged(df.repartition(5))
    got = D.repair_conversations(d, copies=F.col("copies"))
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    want = con.sql(ORACLE_SQL["op12_dijkstra_repair"])
    assert want.columns == COLUMNS
    assert key(got.select(*COLUMNS).collect()) == key(want.fetchall())
    for r in got.where("conv_id IN (200, 101, 1)").collect():
        text = "\n".join(f"{m.role}:{m.text}" for m in r.repaired)
        assert hashlib.sha256(text.encode()).hexdigest() == r.repaired_sha256
    lost = got.where("conv_id >= 1000").collect()
    assert len(lost) == 3 and all((r.cost, r.audit, r.gaps, r.repaired) == (0, "", 0, []) for r in lost)
    assert all(r.repaired_sha256 == hashlib.sha256(b"").hexdigest() for r in lost)


def test_damage(spark):
    rows = [(c, 0, "assistant", "A. B! C?") for c in range(200)]
    d = D.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for r in d.collect():
        kind = zlib.crc32(f"{r.conv_id}:0".encode()) % 20
        assert r.copies == {0: 0, 3: 2}.get(kind, 1) and r.role == ("user" if kind == 4 else "assistant")
        assert r.text == {1: "", 2: "A B C"}.get(kind, "A. B! C?")


def test_empty_table_and_query(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert D.repair_conversations(D.damaged(empty), copies=F.col("copies")).count() == 0
    found = op12_dijkstra_repair(spark, "/root/testdata/sf0.001")
    assert found.columns == COLUMNS
    assert found.count() == spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id").distinct().count()
