"""Repair of conversations at the least cost, by depth-first branch-and-bound.

A repaired conversation has the roles ``(s?(ua)+)?``, by initials: perhaps a system row, then user and
assistant in turn, ending with an assistant; or nothing at all. Going through the rows, what was kept so far is in one
of four states, and each edit leads to another:

* K keeps a row whose role fits, at no cost;
* R gives a row the role that fits, user or assistant: 2;
* D deletes a row: 3. Blank and duplicate rows must be deleted;
* I puts an empty row of the role that fits before the next row, or at the end: 2.

Rows that break off and are not deleted add 1. Of the cheapest edits the least by their letters are taken.

The search keeps an explicit stack of partial repairs. A bound from below for what the rest of the
rows costs from a state, worked out from the end, prunes partial repairs that can't beat the incumbent (its cost, then
its letters); a table by row and state holds the best way found to get there and drops worse ones. When
the stack is empty, the incumbent is optimal. Two ways of equal cost to one row and state never have
letters of which one begins the other (the longer has more inserts, which cost), so whichever is less
stays less whatever follows: dropping the other is safe. Conversations are searched in blocks of ``BLOCK`` rows: a block
ends with the edit of its last row, so, with bounds for what follows it, its edits are decided within it.

Rows of a conversation meet in one task in order, as the letters of its edits are one value and a running digest reads it
from start to end. The task keeps two bytes and a part of a bound for each row of the conversation at hand, never its
texts: those travel once, in the second pass, and stream. Duplicates are found by aggregation, so that
many equal rows cost one row per task.
"""

import hashlib
from array import array

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INSERT, RELABEL, DELETE, BROKEN = 2, 2, 3, 1
START, SYSTEM, USER, ASSISTANT = range(4)  # states: nothing yet, or the initial that came last
FITS = (USER, USER, ASSISTANT, USER)  # the role that may follow each state, besides system at the start
ENDS = (True, False, False, True)
NAMES = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 60
BLOCK = 256

# A row as a byte: its role's state (0 if it has none of the three initials), and flags.
MUST_GO, TRUNCATED = 4, 8
NO_BLANK = r"[^\x20\x09-\x0D]"

AUDIT = pa.schema(
    [(name, pa.int64()) for name in ("conv_id", "n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [("audit", pa.string())]
)
REPAIRED = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), *((n, pa.string()) for n in ("edit", "role", "text"))])
DIGEST = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])


def keeps(code: int, state: int) -> int:
    """The state after keeping a row, or 0 if its role does not fit."""
    role = code & 3
    return role if role and (role == FITS[state] or role == SYSTEM and state == START) else 0


def bounds(codes, after) -> list:
    """By state, the least that rows ``codes`` and whatever follows can cost; ``after`` holds this for what follows."""
    now = after
    for code in reversed(codes):
        now = step_back(code, now)
    return now


def step_back(code: int, after) -> list:
    if code & MUST_GO:
        own = [DELETE + a for a in after]
    else:
        broken = BROKEN if code & TRUNCATED else 0
        own = []
        for state in range(4):
            least = min(DELETE + after[state], RELABEL + broken + after[FITS[state]])
            kept = keeps(code, state)
            own.append(min(least, broken + after[kept]) if kept else least)
    return inserting(own)


def inserting(own) -> list:
    """Least costs if empty rows may come first: at most one each of user and assistant can pay."""
    user = min(own[USER], INSERT + own[ASSISTANT], 2 * INSERT + own[USER])
    assistant = min(own[ASSISTANT], INSERT + own[USER])
    return [min(own[START], INSERT + user), min(own[SYSTEM], INSERT + user), user, assistant]


END = inserting([0 if ends else FAR for ends in ENDS])


def search(codes, state: int, after) -> tuple:
    """(letters, state reached) of the best edits for rows ``codes`` from a state, with bounds for what follows."""
    rest = [after]
    for code in reversed(codes):
        rest.append(step_back(code, rest[-1]))
    rest.reverse()
    last = len(codes)
    incumbent = (FAR, "", state)
    table: dict = {}
    # (letters so far as a chain, cost, row, state); the last is taken first.
    stack = [(None, 0, 0, state)]
    while stack:
        chain, cost, row, state = stack.pop()
        bound = cost + rest[row][state]
        if bound > incumbent[0]:
            continue
        known = table.get((row, state))
        if known is not None and (known[0] < cost or known[0] == cost and letters(known[1]) <= letters(chain)):
            continue
        table[row, state] = (cost, chain)
        if row == last:
            # What follows costs its bound exactly; the letters so far decide between equals.
            found = (bound, letters(chain), state)
            if found[:2] < incumbent[:2] or incumbent[0] == FAR:
                incumbent = found
            continue
        code, nexts = codes[row], [("D", DELETE, row + 1, state)]
        if not code & MUST_GO:
            broken = BROKEN if code & TRUNCATED else 0
            nexts.append(("R", RELABEL + broken, row + 1, FITS[state]))
            if kept := keeps(code, state):
                nexts.append(("K", broken, row + 1, kept))
        nexts.append(("I", INSERT, row, FITS[state]))
        branches = [(cost + more + rest[to][then], letter, (chain, letter), cost + more, to, then) for letter, more, to, then in nexts]
        branches = [b for b in branches if b[0] <= incumbent[0]]
        branches.sort(key=lambda b: b[:2], reverse=True)  # the most promising goes on top
        stack.extend(b[2:] for b in branches)
    return incumbent[1], incumbent[2]


def letters(chain) -> str:
    out = []
    while chain is not None:
        chain, letter = chain
        out.append(letter)
    return "".join(reversed(out))


def edits(codes) -> tuple:
    """(cost, letters) of the cheapest repair of a conversation, given its rows as bytes."""
    starts = range(0, len(codes), BLOCK)
    after = array("q", END)  # bounds at the ends of blocks, four each, from the last
    for start in reversed(starts):
        after.extend(bounds(codes[start : start + BLOCK], after[-4:].tolist()))
    cost, state, out = after[-4], START, []
    for start in starts:
        del after[-4:]
        audit, state = search(codes[start : start + BLOCK], state, after[-4:].tolist())
        out.append(audit)
    if not ENDS[state]:  # an assistant's answer is missing, after a system row also the question
        out.append("I" if state == USER else "II")
    return cost, "".join(out)


def given(turns: DataFrame, there: Column | None = None) -> DataFrame:
    """conv_id, turn, role, text with nulls of the last two as one space, whether the row is there, and a digest of
    role and text."""
    return turns.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        F.coalesce(F.lit(True) if there is None else there, F.lit(False)).alias("there"),
    ).withColumn("digest", F.sha2(F.concat_ws("\n", F.regexp_replace("role", "([\\\\\n])", r"\\$1"), "text"), 256))


def faults(turns: DataFrame) -> DataFrame:
    """What the search needs of each row; texts stay behind. ``later``: role and text came in an earlier turn."""
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    rows = turns.select(
        "conv_id", "there", "turn", "role", "digest",
        (~F.col("text").rlike(NO_BLANK)).alias("blank"), (~last.isin(*".!?")).alias("truncated"),
    )
    # Where a role and text first came: before all numbers if one of its turns is null.
    groups = rows.where("there").groupBy("conv_id", "digest").agg(
        F.min("turn").alias("first"), F.bool_or(F.col("turn").isNull()).alias("unnumbered"), F.count(F.lit(1)).alias("times")
    ).where("times > 1").select(F.col("conv_id").alias("_c"), F.col("digest").alias("_d"), "first", "unnumbered")
    rows = rows.join(groups, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("digest") == F.col("_d")), "left")
    later = F.coalesce(F.col("turn").isNotNull() & (F.col("unnumbered") | (F.col("turn") > F.col("first"))), F.lit(False))
    return rows.select(*rows.columns[:7], later.alias("later"))


class Conversation:
    """Collects one conversation's rows in order."""

    def __init__(self):
        self.codes, self.before, self.initial = bytearray(), None, None
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = None

    def add(self, there, turn, role, digest, blank, truncated, later) -> None:
        if not there:
            return
        initial = role[:1]
        duplicate = not blank and (later or self.before == (turn, digest))
        cut = truncated and not blank and not duplicate
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + cut
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        self.before, self.initial = (turn, digest), initial
        role = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(initial, 0)
        self.codes.append(role | (MUST_GO if blank or duplicate else 0) | (TRUNCATED if cut else 0))

    def closed(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        cost, audit = edits(self.codes)
        return len(self.codes), gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def conversations(batches, names):
    """Values of ordered rows, and before each conversation's first row its id alone: (id, None), then (id, row) each."""
    now, begun = None, False
    for batch in batches:
        for conv, *row in zip(*(batch.column(name).to_pylist() for name in ("conv_id", *names))):
            if not begun or conv != now:
                now, begun = conv, True
                yield conv, None
            yield conv, row


def tables(rows, schema: pa.Schema, size: int = 2_000, most: int = 1 << 24):
    """Record batches of at most ``size`` rows, fewer if texts are long."""
    held, length = [], 0
    for row in rows:
        held.append(row)
        length += len(row[-1] or "")
        if len(held) == size or length > most:
            yield _table(held, schema)
            held, length = [], 0
    yield _table(held, schema)


def _table(rows, schema):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def spark_schema(schema: pa.Schema) -> str:
    return ", ".join(f"{field.name} {'bigint' if field.type == pa.int64() else 'string'}" for field in schema)


def audit(turns: DataFrame, there: Column | None = None) -> DataFrame:
    """One row per conversation (``AUDIT``): its faults, what the cheapest repair costs and which edits it takes.

    ``turns`` has conv_id, turn, role and text; other columns are not read. Rows for which ``there`` is not true only name
    their conversation, which has no faults and no edits if it has no other rows. A conversation's rows go by turn, nulls
    first; rows that share a turn go by role, then by the sha256 of role and text. Null roles and texts are one
    space. Null ids make a conversation of their own. An empty role has no initial, so it never fits.
    Repeated rows are duplicates. Long texts are read where they lie. An empty table gives an empty one.
    """
    names = ["there", "turn", "role", "digest", "blank", "truncated", "later"]

    def audits(batches):
        def closed():
            conv, conversation = None, None
            for conv_id, row in conversations(batches, names):
                if row is None:
                    if conversation:
                        yield conv, *conversation.closed()
                    conv, conversation = conv_id, Conversation()
                else:
                    conversation.add(*row)
            if conversation:
                yield conv, *conversation.closed()

        yield from tables(closed(), AUDIT)

    rows = faults(given(turns, there)).repartition("conv_id").sortWithinPartitions("conv_id", *names[:4])
    return rows.mapInArrow(audits, spark_schema(AUDIT))


def mended(rows):
    """Rows of ``REPAIRED`` from (id, None) before each conversation, then (id, (0, letters of its edits, None)) and
    (id, (1, text, role)) for its rows."""
    conv, audit, at, place, state, begun = None, "", 0, 0, START, False

    def inserted():
        nonlocal at, place, state
        while at < len(audit) and audit[at] == "I":
            state = FITS[state]
            yield conv, place, "I", NAMES[state], ""
            at, place = at + 1, place + 1

    def closed():
        yield from inserted()
        if not place:
            yield conv, None, None, None, None

    for conv_id, row in rows:
        if row is None:
            if begun:
                yield from closed()
            conv, at, place, state, begun = conv_id, 0, 0, START, True
        elif row[0] == 0:
            audit = row[1]
        else:
            yield from inserted()
            edit, text, role = audit[at], row[1], row[2]
            at += 1
            if edit == "D":
                continue
            if edit == "R":
                state = FITS[state]
                role = NAMES[state]
            else:
                state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
            yield conv, place, edit, role, text
            place += 1
    if begun:
        yield from closed()


def repaired(turns: DataFrame, audits: DataFrame, there: Column | None = None) -> DataFrame:
    """The rows of the repaired conversations (``REPAIRED``), in order within each task, place counting from 0.

    ``audits`` is ``audit(turns, there)``. ``edit`` is the letter by which the row got there: K, R or I. Conversations
    that end up without rows have one row with a null place. Awkward rows are treated as by ``audit``.
    """
    rows = given(turns, there).where("there").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", "text")
    none = {"turn": "bigint", "role": "string", "digest": "string"}
    heads = audits.select("conv_id", F.lit(0).alias("kind"), *[F.lit(None).cast(t).alias(n) for n, t in none.items()], F.col("audit").alias("text"))
    ordered = heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
    return ordered.mapInArrow(
        lambda batches: tables(mended(conversations(batches, ["kind", "text", "role"])), REPAIRED), spark_schema(REPAIRED)
    )


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) from ``repaired``, whose rows it reads in the order in which its tasks made them."""

    def hashed(batches):
        def closed():
            conv, digest = None, None
            for conv_id, row in conversations(batches, ["place", "role", "text"]):
                if row is None:
                    if digest:
                        yield conv, digest.hexdigest()
                    conv, digest = conv_id, hashlib.sha256()
                elif row[0] is not None:
                    digest.update(f"{chr(10) if row[0] else ''}{row[1]}:{row[2]}".encode())
            if digest:
                yield conv, digest.hexdigest()

        yield from tables(closed(), DIGEST)

    return rows.mapInArrow(hashed, spark_schema(DIGEST))
