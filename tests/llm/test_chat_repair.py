"""Repair of conversations: against exhaustive search, over batches, and on awkward rows."""

from __future__ import annotations

import hashlib
import random
from functools import cache

import pytest
from pyspark.sql import functions as F

from pendscope.llm.chat_repair import BLANK, CUT, DUPLICATE, Search, damage, repair_digests, repair_edits

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def cheapest(rows: tuple) -> tuple:
    """(cost, audit, repaired) of the best of all edits, by recursion over what follows."""
    @cache
    def best(at: int, state: str, inserted: int) -> tuple | None:
        found = [(0, "", ())] if at == len(rows) and state in ("", "a") else []

        def go(row: int, to: str, count: int, cost: int, edit: str, line: tuple | None) -> None:
            rest = best(row, to, count)
            if rest:
                found.append((rest[0] + cost, edit + rest[1], ((line,) if line else ()) + rest[2]))

        if inserted < 3:
            role = "assistant" if state == "u" else "user"
            go(at, role[0], inserted + 1, 5, "I", (role, ""))
        if at < len(rows):
            role, text, fault = rows[at]
            go(at + 1, state, 0, 2, "D", None)
            if fault not in (BLANK, DUPLICATE):
                stays, first = 5 * (fault == CUT), role[:1]
                if first == "s" and state == "":
                    go(at + 1, "s", 0, stays, "K", (role, text))
                wanted = "assistant" if state == "u" else "user"
                if first == wanted[0]:
                    go(at + 1, first, 0, stays, "K", (role, text))
                go(at + 1, wanted[0], 0, stays + 1, "R", (wanted, text))
        return min(found) if found else None

    return best(0, "", 0)


def searched(rows) -> tuple:
    search, edits = Search(), []
    for at, row in enumerate(rows):
        edits += search.step(at, *row)
    cost, rest = search.finish()
    edits += rest
    return cost, "".join(e * n for e, n, *_ in edits), tuple((role, text) for e, _, _, role, text in edits if e != "D")


@pytest.mark.parametrize("seed", range(4))
def test_search_is_exhaustive(seed):
    dice = random.Random(seed)
    for _ in range(1500):
        messy = dice.random()
        rows = tuple((
            dice.choice(["user", "assistant", "system", "tool", "", " "]) if dice.random() < messy else dice.choice(["user", "assistant"]), f"t{at}",
            dice.choice([None, None, BLANK, DUPLICATE, CUT, CUT]) if dice.random() < messy else None) for at in range(dice.randint(0, 11)))
        assert searched(rows) == cheapest(rows), rows


def test_what_is_held_stays_small():
    dice, search, emitted, held = random.Random(1), Search(), 0, 0
    for at in range(30_000):
        fault = BLANK if 5_000 <= at < 15_000 else dice.choice([None] * 6 + [CUT, DUPLICATE])
        emitted += sum(edit[1] for edit in search.step(at, dice.choice(["user", "assistant"]), "x", fault))
        if at % 50 == 0:
            held = max(held, len({id(node) for tip in search.tips if tip for node in search._path(tip)}))
    assert held < 300
    assert emitted > 29_000


def test_references_count_what_refers():
    dice, search = random.Random(2), Search()
    for at in range(400):
        search.step(at, dice.choice(["user", "assistant", "system"]), "x", dice.choice([None, None, CUT, BLANK]))
        nodes = {id(n): n for tip in search.tips if tip for n in search._path(tip)}
        counts = dict.fromkeys(nodes, 0)
        for node in nodes.values():
            if id(node.above) in counts:
                counts[id(node.above)] += 1
        for tip in search.tips:
            if tip is not None and id(tip) in counts:
                counts[id(tip)] += 1
        assert counts == {key: node.refs for key, node in nodes.items()}


#: Undamaged rows; the last two of conversation 4 say what was said before.
AWKWARD = [
    (1, 0, "user", "hi."), (1, 1, "assistant", "yes."), (1, 1, "assistant", "yes."), (1, None, "system", "be kind."), (1, 5, "user", "more?"),
    (2, 0, None, None), (2, 1, "user", ""),
    (None, 3, "assistant", "only me!"),
    (3, 0, "user", "cut"), (3, 1, "assistant", "x" * 300_000 + "."),
    (4, 0, "user", "a."), (4, 1, "assistant", "b."), (4, 2, "user", "a."),
]


def _lines(role_texts) -> str:
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in role_texts).encode()).hexdigest()


@pytest.fixture
def edits_of(spark):
    def run(rows, extra=()):
        frame = spark.createDataFrame(rows, SCHEMA).withColumn("gone", F.lit(False))
        frame = frame.select("*", *(F.lit("other").alias(name) for name in extra))
        clean = frame.withColumns({"role": F.coalesce("role", F.lit(" ")), "text": F.coalesce("text", F.lit(" "))})
        out: dict = {}
        for row in sorted(repair_edits(clean).collect(), key=lambda r: (str(r["conv_id"]), r["step"])):
            out.setdefault(row["conv_id"], []).append(row)
        return out

    return run


def test_awkward_rows(edits_of):
    found = edits_of(AWKWARD, extra=("key", "own", "fault", "step", "n", "first", "seen_key", "facts"))
    audits = {conv: "".join(r["edit"] * r["times"] for r in rows[:-1]) for conv, rows in found.items()}
    facts = {conv: rows[-1]["facts"].asDict() for conv, rows in found.items()}
    # a null turn comes first; the copy in the same turn is the duplicate; the last user turn gets no answer
    assert audits[1] == "KKKDD"
    assert facts[1] == {"gaps": 3, "blank": 0, "duplicate": 1, "truncated": 0, "illegal": 1, "cost": 4}
    assert audits[2] == "DD" and facts[2]["blank"] == 2
    assert audits[None] == "D" and facts[None]["cost"] == 2
    # deleting the cut question costs 2 and its answer as much
    assert audits[3] == "DD" and facts[3]["truncated"] == 1
    assert audits[4] == "KKD" and facts[4]["duplicate"] == 1


def test_arrow_batches_do_not_matter(spark, edits_of):
    rows = [(c, t, ["user", "assistant"][(t + c) % 2], f"{t % 9}{'.' if t % 4 else ''}") for c in range(3) for t in range(90)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = []
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        found.append(edits_of(rows))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found[0] == found[1]


def test_digests_name_every_conversation(spark):
    import zlib

    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    whole = next(c for c in range(1000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 > 4 for t in (0, 1)))
    rows = spark.createDataFrame([(dropped, 0, "user", "x."), (whole, 0, "user", "q?"), (whole, 1, "assistant", "a.")], SCHEMA)
    assert damage(rows).filter("gone").count() == 1
    got = {r["conv_id"]: r for r in repair_digests(rows).collect()}
    assert got[dropped]["audit"] == "" and got[dropped]["repaired_sha256"] == hashlib.sha256(b"").hexdigest() and got[dropped]["cost"] == 0
    assert got[whole]["audit"] == "KK" and got[whole]["repaired_sha256"] == _lines([("user", "q?"), ("assistant", "a.")])
    assert repair_digests(rows.limit(0)).count() == 0
