"""Conversation repair by a lazily determinised weighted automaton.

A repaired conversation has role initials ``(s?(ua)+)?``. Edits are weighted arcs of an automaton
with four states, by what stands last in the repaired conversation: nothing, s, u or a. Rows
are its letters: their role's initial, whether the text is truncated, or that they must go.

    Keep      0    if the initial may follow here
    Rerole    3    the row becomes user or assistant, whichever may follow
    Delete    4    required for blank and duplicate rows
    Insert    3    an empty user or assistant row, anywhere
    truncated 3    for each truncated row that is not deleted

Subset construction with costs: reading a conversation from its last row to its first, what
each state costs from there on is a vector of four numbers. Vectors that differ by a constant
behave alike, so the least is taken off and added to the path; the vectors that are left are
the states of a deterministic automaton. They are few, and are made when a row first asks for
one, in a transition table that a worker keeps. The scan is then one look-up a row and gives
the cost. The trace goes back along the scan, so it meets rows in their order: where several
arcs are tight (their cost and the rest's make the state's), it takes the least letter, and as
a letter leads to one state only, the audit is the ASCII-least of the cheapest.

Plan: what decides (initials, SHA-256 of texts, blank and truncated) goes without texts through
two aggregates and a join, which split hot conversations and texts; only a byte a row meets in
one task for each conversation, as its audit is one string. Texts are shuffled once, to meet
their letter in the order of rows, and stream past: no conversation's texts are held together.
One conversation's SHA-256 is sequential, so its texts pass through one task, a batch at a time.

Defined cases: a null role or text is one space, and so is a null conv_id or turn in the key
of the damage; null conv_ids are one conversation, null turns come first; rows of one turn
stand in order of role, then of their text's SHA-256, so rows alike stand together and all but
the first are duplicates; a role with another or no initial has to be reroled or deleted; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidewarden.llm.shared import BATCH_BYTES, BATCH_ROWS, small_batches

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: What stands last in the repaired conversation.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Where an inserted or reroled row leads from each state, and its role there.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Where a kept row leads, by state and initial.
KEPT = {
    (NOTHING, "s"): SYSTEM,
    **{(q, "u"): USER for q in (NOTHING, SYSTEM, ASSISTANT)},
    (USER, "a"): ASSISTANT,
}
INITIALS = "sua"
#: Symbols: place of the initial (3: another) twice, one more if truncated; or a row that must go.
GONE = 2 * len(INITIALS) + 2
#: Costs with no row left: what is missing is inserted.
END = (0, 2 * INSERT, INSERT, 0)
#: Faults of damage, by the key's CRC-32 modulo FAULTS.
FAULTS = 20
DROP, EMPTY, CUT, REPEAT, AS_USER = range(5)
SPACES = r"\x20\x09-\x0D"


class Repairer:
    """The determinised automaton, as far as rows have asked for it."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.ids: dict[tuple[int, ...], int] = {}
        #: By state and symbol: the next state and what the path costs more.
        self.table: dict[int, tuple[int, int]] = {}
        #: By state, symbol and automaton state: the letters up to the row's own, and where they lead.
        self.traced: dict[tuple[int, int, int], tuple[str, int]] = {}
        self.start = self.state(END)

    def state(self, vector: tuple[int, ...]) -> int:
        found = self.ids.setdefault(vector, len(self.vectors))
        if found == len(self.vectors):
            self.vectors.append(vector)
        return found

    @staticmethod
    def arcs(symbol: int, q: int) -> Iterator[tuple[str, int, int]]:
        """(letter, state, cost) of the arcs that read a row, in the order of letters."""
        yield "D", q, DELETE
        if symbol == GONE:
            return
        initial, more = INITIALS[symbol // 2 : symbol // 2 + 1], TRUNCATED * (symbol % 2)
        if (q, initial) in KEPT:
            yield "K", KEPT[q, initial], KEEP + more
        yield "R", NEXT[q], REROLE + more

    def costs(self, state: int, symbol: int) -> list[int]:
        """Costs of each state before a row, those after it given; inserts included."""
        after = self.vectors[state]
        found = [min(c + after[to] for _, to, c in self.arcs(symbol, q)) for q in range(4)]
        for _ in range(2):  # a third insert leads back to where the first was
            found = [min(found[q], INSERT + found[NEXT[q]]) for q in range(4)]
        return found

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        found = self.costs(state, symbol)
        least = min(found)
        return self.state(tuple(c - least for c in found)), least

    def scan(self, symbols: bytes) -> tuple[int, array]:
        """The cost of a conversation, and the state after each row, from the last to the first."""
        state, cost, table = self.start, 0, self.table
        states = array("H", [state])
        for symbol in reversed(symbols):
            key = state * (GONE + 1) + symbol
            if key not in table:
                table[key] = self.step(state, symbol)
            state, more = table[key]
            cost += more
            states.append(state)
        return cost + self.vectors[state][NOTHING], states

    def letters(self, state: int, symbol: int, q: int) -> tuple[str, int]:
        """The least tight letters from q up to and with the row's own."""
        costs, after, out = self.costs(state, symbol), self.vectors[state], ""
        while True:
            tight = [(a, to) for a, to, c in self.arcs(symbol, q) if c + after[to] == costs[q]]
            if INSERT + costs[NEXT[q]] == costs[q]:
                tight.append(("I", -1))
            letter, to = min(tight)
            out += letter
            if letter != "I":
                return out, to
            q = NEXT[q]

    def repair(self, symbols: bytes) -> tuple[int, str]:
        """(cost, audit) of a conversation."""
        cost, states = self.scan(symbols)
        out, q, traced = [], NOTHING, self.traced
        for i, symbol in enumerate(symbols):
            key = states[len(symbols) - 1 - i], symbol, q
            if key not in traced:
                traced[key] = self.letters(*key)
            letters, q = traced[key]
            out.append(letters)
        out.append("I" * (END[q] // INSERT))
        return cost, "".join(out)


@cache
def repairer() -> Repairer:
    """This worker's automaton; it outlives a task."""
    return Repairer()


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of rows after damage; a dropped row has no copies."""
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    conv_id, turn, role, text = spaced
    fault = F.crc32(F.concat_ws(":", conv_id, turn)) % FAULTS
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("fault")).select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == AS_USER, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == EMPTY, "")
        .when(F.col("fault") == CUT, F.translate("text", ".!?", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        F.when(F.col("fault") == DROP, 0).when(F.col("fault") == REPEAT, 2).otherwise(1).alias("copies"),
    )


def undamaged(conversations: DataFrame) -> DataFrame:
    """Rows as they are, in the form of ``damaged``."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    return conversations.select("conv_id", "turn", role, text, F.lit(1).alias("copies"))


def symbols(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, n, first, symbol, blank, truncated), one for rows alike: the
    first of them is no duplicate if ``first``. Conversations without rows have one with n = 0."""
    digest = F.sha2(F.col("text"), 256)
    light = rows.select(
        "conv_id",
        F.when(F.col("copies") > 0, F.col("turn")).alias("turn"),
        F.when(F.col("copies") > 0, F.col("role")).otherwise("").alias("role"),
        F.when(F.col("copies") > 0, digest).otherwise("").alias("digest"),
        "copies",
        F.rlike("text", F.lit(f"[^{SPACES}]")).alias("said"),
        F.rlike("text", F.lit(rf"[.!?][{SPACES}]*\z")).alias("ended"),
    )
    alike = light.groupBy("conv_id", "turn", "role", "digest").agg(
        F.sum("copies").alias("n"), F.first("said").alias("said"), F.first("ended").alias("ended")
    )
    # The turn where a role first says a text; turns without a number come first.
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("at"))
    said = (
        light.where("copies > 0")
        .groupBy(F.col("conv_id").alias("own_id"), F.col("role").alias("own_role"), F.col("digest").alias("own_digest"))
        .agg(F.min(order).alias("earliest"))
    )
    same = (
        F.col("conv_id").eqNullSafe(F.col("own_id"))
        & (F.col("role") == F.col("own_role"))
        & (F.col("digest") == F.col("own_digest"))
    )
    initial = F.substring("role", 1, 1)
    place = F.instr(F.lit(INITIALS), initial)  # 1 for an empty initial
    kind = F.when((initial == "") | (place == 0), len(INITIALS)).otherwise(place - 1)
    return alike.join(said, same, "left").select(
        "conv_id", "turn", "role", "digest", "n",
        F.col("earliest").eqNullSafe(order).alias("first"),
        (kind * 2 + F.when(F.col("ended"), 0).otherwise(1)).cast("int").alias("symbol"),
        (~F.col("said")).alias("blank"),
        (~F.col("ended")).alias("truncated"),
    )


class Conversation:
    """Counts and symbols of the rows of one conversation, in their order."""

    def __init__(self, conv_id: object):
        self.conv_id = conv_id
        self.symbols = bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.last = self.before = None

    def add(self, turn: int | None, role: str, n: int, first: bool, symbol: int, blank: bool, truncated: bool) -> None:
        if not n:
            return
        initial = role[:1]
        if self.before is not None:
            self.illegal += self.before + initial not in ("su", "ua", "au")
        self.illegal += n - 1  # no role may follow itself
        self.before = initial
        kept = first and not blank
        if blank:
            self.blank += n
        else:
            self.duplicate += n - kept
            self.truncated += kept and truncated
        self.symbols += bytes([symbol]) * kept + bytes([GONE]) * (n - kept)
        if turn is not None and (self.last is None or turn != self.last):
            self.turns += 1
            self.least = turn if self.least is None else self.least
            self.last = turn

    def row(self) -> tuple:
        cost, audit = repairer().repair(bytes(self.symbols))
        gaps = 0 if self.last is None else self.last - self.least + 1 - self.turns
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


AUDIT_COLUMNS = [
    *((c, "bigint", pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
    ("audit", "string", pa.string()),
]
#: The order of rows; Spark sorts nulls first.
ORDER = "conv_id", "turn", "role", "digest"


def out_batch(rows: list[tuple], kind: pa.DataType, columns: list[tuple]) -> pa.RecordBatch:
    kinds = [kind, *(t for _, _, t in columns)]
    arrays = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(arrays, ["conv_id", *(n for n, _, _ in columns)])


def schema_of(rows: DataFrame, columns: list[tuple]) -> T.StructType:
    """conv_id as it is, and more columns."""
    more = ", ".join(f"{n} {t}" for n, t, _ in columns)
    return T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *T.StructType.fromDDL(more)])


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation of
    rows in the form of ``damaged``."""
    small_batches(rows.sparkSession)
    marked = symbols(rows).repartition("conv_id").sortWithinPartitions(*ORDER)
    names = ("turn", "role", "n", "first", "symbol", "blank", "truncated")

    schema = schema_of(rows, AUDIT_COLUMNS)
    kind = to_arrow_type(schema[0].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_one, out = None, []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in names)
            for conv_id, *row in zip(batch.column("conv_id").to_pylist(), *columns, strict=True):
                if open_one is None or open_one.conv_id != conv_id:
                    if open_one is not None:
                        out.append(open_one.row())
                    open_one = Conversation(conv_id)
                open_one.add(*row)
            if len(out) >= BATCH_ROWS:
                yield out_batch(out, kind, AUDIT_COLUMNS)
                out = []
        if open_one is not None:
            out.append(open_one.row())
            yield out_batch(out, kind, AUDIT_COLUMNS)

    return marked.mapInArrow(run, schema)


class Edits:
    """The letters of a conversation, taken row by row."""

    def __init__(self, head: dict):
        self.head, self.audit, self.at, self.q = head, head["audit"], 0, NOTHING

    def inserts(self) -> Iterator[tuple[str, str]]:
        """(letter, role) of the inserts that stand before the next row, or at the end."""
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.q = NEXT[self.q]
            yield "I", ROLE[self.q]

    def edit(self, role: str) -> tuple[str, str]:
        """(letter, new role) of the next row."""
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.q = KEPT[self.q, role[:1]]
        elif letter == "R":
            self.q = NEXT[self.q]
            role = ROLE[self.q]
        return letter, role


def meeting(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows in order, each conversation's after its row of ``found`` (which alone has a head)."""
    head = F.struct(*(n for n, _, _ in AUDIT_COLUMNS)).alias("head")
    text = F.col("text").cast("binary").alias("text")
    rows = rows.where("copies > 0").select(
        "conv_id", "turn", "role", F.sha2(F.col("text"), 256).alias("digest"), text, "copies"
    )
    both = rows.unionByName(found.select("conv_id", head), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("head").isNull(), *ORDER[1:])


def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple | None]:
    """(conv_id, letter, turn, role, text) of repaired rows, conversation by conversation; one
    with letter ``end`` closes it and has its head as text, and None closes a batch. Deleted
    rows are left out."""
    open_one = None
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "head", "turn", "role", "text", "copies"))
        for conv_id, head, turn, role, text, copies in zip(*columns, strict=True):
            if head is not None:
                if open_one is not None:
                    yield from closing(*open_one)
                open_one = conv_id, Edits(head)
                continue
            edits = open_one[1]
            for _ in range(copies):
                for letter, new in edits.inserts():
                    yield conv_id, letter, None, new, b""
                letter, new = edits.edit(role)
                if letter != "D":
                    yield conv_id, letter, turn, new, text
        yield None
    if open_one is not None:
        yield from closing(*open_one)


def closing(conv_id: object, edits: Edits) -> Iterator[tuple]:
    for letter, role in edits.inserts():
        yield conv_id, letter, None, role, b""
    yield conv_id, "end", None, None, edits.head


REPORT_COLUMNS = [*AUDIT_COLUMNS, ("repaired_sha256", "string", pa.string())]


def report(rows: DataFrame) -> DataFrame:
    """Counts of faults, cost, audit and the repaired conversation's SHA-256, for each conversation
    of rows in the form of ``damaged``; texts stream past."""
    small_batches(rows.sparkSession)
    schema = schema_of(rows, REPORT_COLUMNS)
    kind = to_arrow_type(schema[0].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, digest, out = True, hashlib.sha256(), []
        for row in edited(batches):
            if row is None:
                if len(out) >= BATCH_ROWS:
                    yield out_batch(out, kind, REPORT_COLUMNS)
                    out = []
                continue
            conv_id, letter, _, role, text = row
            if letter == "end":
                out.append((conv_id, *text.values(), digest.hexdigest()))
                first, digest = True, hashlib.sha256()
            else:
                digest.update((role if first else f"\n{role}").encode() + b":")
                digest.update(text)
                first = False
        if out:
            yield out_batch(out, kind, REPORT_COLUMNS)

    return meeting(rows, audits(rows)).mapInArrow(run, schema)


ROW_COLUMNS = [
    ("place", "bigint", pa.int64()),
    ("edit", "string", pa.string()),
    ("turn", "bigint", pa.int64()),
    ("role", "string", pa.string()),
    ("text", "string", pa.string()),
]


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, place, edit, turn, role, text): the repaired conversations row by row, from 1 on;
    ``edit`` is K, R or I, and an inserted row has no turn."""
    small_batches(rows.sparkSession)
    schema = schema_of(rows, ROW_COLUMNS)
    kind = to_arrow_type(schema[0].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, out, held = 0, [], 0
        for row in edited(batches):
            if row is None:
                continue
            conv_id, letter, turn, role, text = row
            if letter == "end":
                place = 0
                continue
            place += 1
            held += len(text)
            out.append((conv_id, place, letter, turn, role, text.decode()))
            if len(out) >= BATCH_ROWS or held >= BATCH_BYTES:
                yield out_batch(out, kind, ROW_COLUMNS)
                out, held = [], 0
        if out:
            yield out_batch(out, kind, ROW_COLUMNS)

    return meeting(rows, audits(rows)).mapInArrow(run, schema)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and the repaired text's digest of every conversation."""
    return report(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def _inserted(state: str, role: str) -> str:
    """SQL of a state with an inserted row: cost, audit, repaired rows."""
    return f"{{'c': {state}.c + 3, 'a': {state}.a || 'I', 't': {state}.t || chr(10) || '{role}:'}}"


def _read(state: str, letter: str, cost: str, role: str, when: str) -> str:
    """SQL of a state that has read a row, out of reach unless ``when`` holds."""
    return (
        f"{{'c': {state}.c + CASE WHEN {when} THEN {cost} ELSE 1000000 END, 'a': {state}.a || '{letter}',"
        f" 't': {state}.t || chr(10) || {role} || ':' || text}}"
    )


def _deleted(state: str) -> str:
    return f"{{'c': {state}.c + 4, 'a': {state}.a || 'D', 't': {state}.t}}"


def _arcs(states: str, letter: str, more: int, role: str, when: str) -> str:
    return ", ".join(_read(q, letter, f"{more} + 3 * truncated::INT", role, when) for q in states.split())


#: States of the closing over inserts: those of user rows first, then those of assistant rows.
_CLOSED = f"""SELECT * REPLACE (least(a, {_inserted('u', 'assistant')}) AS a) FROM
  (SELECT * REPLACE (least(u, {', '.join(_inserted(q, 'user') for q in 'nsa')}) AS u) FROM %s)"""
#: Prefixes of a conversation, each state's cheapest and least edits kept: no automaton is made.
ORACLE = f"""
WITH RECURSIVE k AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
f AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_prepend(4294967295::BIGINT,
    flatten(list_transform(range(1, length(k) + 1), lambda i: [ascii(k[i])::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(xor(c, b) >> 1, 3988292384) ELSE xor(c, b) >> 1 END), 4294967295) % 20 AS fault FROM k),
d AS (SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM f, unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS c(copy)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM d),
x AS (SELECT *, left(role, 1) AS ini, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
    NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS cut, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
y AS (SELECT *, blank OR seen AS gone, NOT blank AND NOT seen AND cut AS truncated FROM x),
e AS (SELECT {{'c': 0::BIGINT, 'a': '', 't': ''}} AS yes, {{'c': 1000000::BIGINT, 'a': '', 't': ''}} AS no),
w AS (SELECT conv_id, 0::BIGINT AS i, yes AS n, no AS s, no AS u, no AS a FROM (SELECT DISTINCT conv_id FROM conversations), e
  UNION ALL SELECT conv_id, i + 1, {_deleted('n')},
    least({_deleted('s')}, {_arcs('n', 'K', 0, 'role', "NOT gone AND ini = 's'")}),
    least({_deleted('u')}, {_arcs('n s a', 'K', 0, 'role', "NOT gone AND ini = 'u'")}, {_arcs('n s a', 'R', 3, "'user'", "NOT gone")}),
    least({_deleted('a')}, {_arcs('u', 'K', 0, 'role', "NOT gone AND ini = 'a'")}, {_arcs('u', 'R', 3, "'assistant'", "NOT gone")})
  FROM ({_CLOSED % "(SELECT w.*, y.role, y.text, y.ini, y.gone, y.truncated FROM w JOIN y ON y.conv_id IS NOT DISTINCT FROM w.conv_id AND y.i = w.i + 1)"})),
z AS (SELECT conv_id, least(n, a) AS best FROM ({_CLOSED % "(SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)"})),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (NOT blank AND seen) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM y GROUP BY conv_id)
SELECT z.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(best.c AS BIGINT) AS cost, best.a AS audit,
  sha256(substr(best.t, 2)) AS repaired_sha256
FROM z LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM z.conv_id
""".replace("\\\\", "\\")


def brute_force(rows: list[tuple], damage: bool = True) -> list[tuple]:
    """The report of rows (conv_id, turn, role, text), each prefix's cheapest and least edits kept
    for each of four states, as tuples of cost, audit and repaired rows."""
    own: dict = {}
    for conv_id, turn, role, text in rows:
        kept = own.setdefault(conv_id, [])
        role, text = (" " if x is None else x for x in (role, text))
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % FAULTS if damage else FAULTS
        if fault == EMPTY:
            text = ""
        if fault == CUT:
            text = re.sub("[.!?]", "", text)
        if fault == AS_USER:
            role = "user"
        kept += [(turn, role, text)] * {DROP: 0, REPEAT: 2}.get(fault, 1)
    out = []
    for conv_id, kept in own.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        turns = {t for t, _, _ in kept if t is not None}
        counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        seen: set = set()
        best: dict[str, tuple] = {"": (0, "", ())}

        def insert(best: dict) -> dict:
            for _ in range(3):
                for q, (cost, audit, repaired) in list(best.items()):
                    new = "a" if q == "u" else "u"
                    made = cost + 3, audit + "I", (*repaired, ({"u": "user", "a": "assistant"}[new], ""))
                    best[new] = min(best.get(new, made), made, key=lambda x: x[:2])
            return best

        for _, role, text in kept:
            words = re.sub(r"[\x20\x09-\x0D]+", "", text)
            if not words:
                fault = "blank"
            elif (role, text) in seen:
                fault = "duplicate"
            else:
                fault = None if words[-1] in ".!?" else "truncated"
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            after: dict = {}
            for q, (cost, audit, repaired) in insert(best).items():
                arcs = [(q, cost + 4, audit + "D", repaired)]
                if fault not in ("blank", "duplicate"):
                    more = 3 * (fault == "truncated")
                    if (q, role[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                        arcs.append((role[:1], cost + more, audit + "K", (*repaired, (role, text))))
                    for new in ("user", "assistant"):
                        if (q + new[0]) in ("u", "su", "ua", "au"):
                            arcs.append((new[0], cost + 3 + more, audit + "R", (*repaired, (new, text))))
                for to, *made in arcs:
                    after[to] = min(after.get(to, tuple(made)), tuple(made), key=lambda x: x[:2])
            best = after
        ends = [v for q, v in insert(best).items() if q in ("", "a")]
        cost, audit, repaired = min(ends, key=lambda x: x[:2])
        initials = [r[:1] for _, r, _ in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out.append((conv_id, gaps, *counts.values(), illegal, cost, audit, digest))
    return out
