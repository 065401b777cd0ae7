"""Conversation repair against a search over all states that shares nothing with it."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from errorloom.llm import repair
from errorloom.llm.registered import op13

SPACE = " \t\n\v\f\r"


def cheapest(rows):
    """(cost, audit, repaired rows) by dynamic programming over whole letter strings."""
    # state: what the roles so far look like; best[state] = (cost, letters, rows)
    best = {"": (0, "", [])}

    def follow(state, initial):
        if initial == "s":
            return "s" if state == "" else None
        if initial == "u":
            return "u" if state in ("", "s", "a") else None
        return "a" if initial == "a" and state == "u" else None

    def better(table, state, entry):
        if state is not None and (state not in table or entry[:2] < table[state][:2]):
            table[state] = entry

    def with_inserts(table):
        for _ in range(4):
            for state, (cost, letters, out) in list(table.items()):
                for role in ("user", "assistant"):
                    better(table, follow(state, role[0]), (cost + 2, letters + "I", [*out, (role, "")]))
        return table

    seen = set()
    for role, text in rows:
        blank = not text.strip(SPACE)
        must = blank or (role, text) in seen
        seen.add((role, text))
        broken = 0 if must else int(text.rstrip(SPACE)[-1] not in ".!?")
        following = {}
        for state, (cost, letters, out) in with_inserts(best).items():
            better(following, state, (cost + 3, letters + "D", out))
            if not must:
                better(following, follow(state, role[:1]), (cost + broken, letters + "K", [*out, (role, text)]))
                for name in ("user", "assistant"):
                    better(following, follow(state, name[0]), (cost + 2 + broken, letters + "R", [*out, (name, text)]))
        best = following
    ends = [entry for state, entry in with_inserts(best).items() if state in ("", "a")]
    return min(ends, key=lambda e: e[:2])


def expected(turns):
    """Rows of op13 for (conv_id, turn, role, text) rows."""
    out = []
    for conv in {r[0] for r in turns}:
        rows = []
        for _, turn, role, text in (r for r in turns if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
            role = "user" if draw == 4 else role
            rows += [] if draw == 0 else [(turn, role, text)] * (2 if draw == 3 else 1)
        digest = lambda r: hashlib.sha256(f"{re.sub(chr(91) + chr(92) * 2 + chr(10) + chr(93), lambda m: chr(92) + m[0], r[1])}\n{r[2]}".encode()).hexdigest()
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r)))
        out.append((conv, *audited(rows)))
    return sorted(out, key=str)


def audited(rows):
    blank = duplicate = truncated = 0
    seen = set()
    for _, role, text in rows:
        if not text.strip(SPACE):
            blank += 1
        elif (role, text) in seen:
            duplicate += 1
        elif text.rstrip(SPACE)[-1] not in ".!?":
            truncated += 1
        seen.add((role, text))
    numbers = {t for t, _, _ in rows if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    initials = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit, mended = cheapest([r[1:] for r in rows])
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in mended).encode()).hexdigest()
    return gaps, blank, duplicate, truncated, illegal, cost, audit, digest


def run(spark, rows, tmp_path, columns="conv_id bigint, turn bigint, role string, text string"):
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/conversations.parquet")
    return sorted((tuple(r) for r in op13(spark, str(tmp_path)).collect()), key=str)


def test_search_against_all_states():
    random = np.random.default_rng(4)
    texts = ["one.", "two!", "three", "", "four?", "five"]
    for size in [*range(0, 9)] * 40 + [600, 900]:
        rows = [(str(random.choice(["user", "assistant", "system", "tool", ""], p=[0.4, 0.35, 0.15, 0.05, 0.05])),
                 str(random.choice(texts)) + (str(random.integers(400)) + "." if size > 100 else "")) for _ in range(size)]
        conversation = repair.Conversation()
        seen = set()
        for turn, (role, text) in enumerate(rows):
            conversation.add(True, turn, role, text, not text.strip(), text.strip()[-1:] not in (".", "!", "?"), (role, text) in seen)
            seen.add((role, text))
        assert conversation.closed()[-2:] == cheapest(rows)[:2]


def test_on_random_conversations(spark, tmp_path):
    random = np.random.default_rng(5)
    roles = [None, "user", "user", "assistant", "assistant", "system", "Assistant", "x", ""]
    texts = [None, "", "a b.", "c", "d! ", "e\n", "why?", "x" * 3000 + "."]
    rows = [(c, t, roles[random.integers(9)], texts[random.integers(8)]) for c in range(150) for t in range(random.integers(1, 9))]
    rows += [(c, None, "user", "no turn.") for c in range(0, 150, 7)]
    assert run(spark, rows, tmp_path) == expected(rows)


def test_awkward_rows(spark, tmp_path):
    rows = [(None, None, None, None), (None, 2, "user", "hi."), (1, 5, "user", "hi."), (1, 5, "user", "hi."), (1, 5, "assistant", "yo"),
            (2**60 + 1, -3, "system", "s."), (2**60 + 1, 4, "user", "q?"), (3, None, "assistant", "a."), (3, 1, "assistant", "a."),
            (4, 1, "back\\slash", "x."), (4, 2, "line\nend", "x.")]
    assert run(spark, rows, tmp_path) == expected(rows)


def test_empty_table_and_clashing_names(spark, tmp_path):
    frame = spark.createDataFrame([(1, 1, "user", "hi.", "no", 3)], "conv_id bigint, turn bigint, role string, text string, there string, digest int")
    assert repair.audit(frame).first()["audit"] == "KI"
    assert repair.audit(frame.limit(0)).count() == 0
    assert repair.repaired(frame, repair.audit(frame)).count() == 2
    assert run(spark, [], tmp_path) == []


def test_long_conversation_of_equal_rows(spark, tmp_path):
    rows = [(1, t, "user" if t % 2 else "assistant", "same." if t % 3 else f"{t}.") for t in range(5000)]
    assert run(spark, rows, tmp_path) == expected(rows)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_on_given_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in op13(spark, f"/root/testdata/{sf}").collect()), key=str) == expected(rows)
