"""Conversation repair against brute force, for given tables, edges and every short conversation."""

import itertools
import random

import pytest

from tests.conftest import SMALL
from tidewarden.llm import conversation_repair as repair
from tidewarden.llm import registry

SCHEMA = "conv_id bigint, turn bigint, role string, text string, symbol string, digest string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def by_id(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0))


def test_query_equals_brute_force(spark):
    df = registry.queries()["op11_conversation_repair"](spark, SMALL)
    rows = spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert by_id(df.collect()) == by_id(repair.brute_force([tuple(r) for r in rows]))


def test_edges(spark):
    rnd = random.Random(5)
    roles = ("user", "assistant", "system", None, "", "tool", "User")
    texts = ("a.", "b", " ", None, "", "c!\n\t", "d. x", "?", "É…", "🙂.", "x" * 70_000 + ".")
    rows = []
    for i in range(400):
        for t in range(rnd.randint(0, 9)):
            turn = rnd.choice((t, t, t, None, 0, 3, -4))
            rows.append((None if i % 40 == 0 else i, turn, rnd.choice(roles), rnd.choice(texts)))
    rows += rows[:60]  # repeated rows
    df = frame(spark, rows)
    assert by_id(repair.report(repair.damaged(df)).collect()) == by_id(repair.brute_force(rows))
    assert by_id(repair.report(repair.undamaged(df)).collect()) == by_id(repair.brute_force(rows, damage=False))


def test_sql_gives_the_same_on_edges():
    import duckdb

    rnd = random.Random(9)
    rows = []
    for i in range(500):
        for t in range(rnd.randint(0, 8)):
            turn = rnd.choice((t, t, t, None, 0, 3))
            role, text = rnd.choice(("user", "assistant", "system", None, "tool", "User")), rnd.choice(("a.", "b", " ", None, "", "c!\n\t", "É…"))
            rows.append((None if i % 40 == 0 else i, turn, role, text))
    con = duckdb.connect()
    con.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    names = "conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256"
    assert by_id(con.sql(repair.ORACLE).select(names).fetchall()) == by_id(repair.brute_force(rows))


def test_empty_table(spark):
    empty = frame(spark, []).limit(0)
    assert repair.report(repair.damaged(empty)).collect() == []
    assert repair.repaired(repair.undamaged(empty)).collect() == []


def test_conversation_of_which_all_rows_are_dropped(spark):
    import zlib

    turn = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    row = repair.report(repair.damaged(frame(spark, [(7, turn, "user", "hello.")]))).first()
    import hashlib

    assert tuple(row) == (7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_long_conversation_of_few_texts(spark):
    rows = [(1, t, ("user", "assistant")[t % 3 % 2], f"text {t % 500}.") for t in range(20_000)]
    assert by_id(repair.report(repair.undamaged(frame(spark, rows))).collect()) == by_id(
        repair.brute_force(rows, damage=False)
    )


def test_repaired_rows_have_legal_roles(spark):
    rows = [(1, 0, "assistant", "a."), (1, 1, "user", "b."), (1, 2, "user", "c."), (1, 3, "assistant", "d."), (2, 0, "system", "s.")]
    df = repair.undamaged(frame(spark, rows))
    audits = {r.conv_id: r.audit for r in repair.report(df).collect()}
    assert audits == {1: "DDKK", 2: "D"} or audits[2] == "D"
    out = [tuple(r)[1:] for r in repair.repaired(df).where("conv_id = 1").orderBy("place").collect()]
    assert "".join(r[3][0] for r in out).replace("ua", "") == ""
    assert [r[0] for r in out] == list(range(1, len(out) + 1))
    assert all((r[1] == "I") == (r[2] is None) for r in out)


@pytest.mark.parametrize("length", range(5))
def test_automaton_on_every_short_conversation(length):
    """Costs and audits of all sequences of symbols equal those of plain prefixes."""
    own = repair.Repairer()
    for symbols in itertools.product(range(repair.GONE + 1), repeat=length):
        assert own.repair(bytes(symbols)) == plain(symbols)
    assert len(own.vectors) < 60 and len(own.table) <= 60 * (repair.GONE + 1)


def plain(symbols):
    best = {0: (0, "")}

    def relax(best):
        for _ in range(3):
            for q, (cost, audit) in list(best.items()):
                to = repair.NEXT[q]
                best[to] = min(best.get(to, (99, "")), (cost + 3, audit + "I"))
        return best

    for symbol in symbols:
        after = {}
        for q, (cost, audit) in relax(best).items():
            for letter, to, more in repair.Repairer.arcs(symbol, q):
                after[to] = min(after.get(to, (999, "")), (cost + more, audit + letter))
        best = after
    best = relax(best)
    return min(best[q] for q in (0, 3) if q in best)
