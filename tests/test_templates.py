"""Message templates against plain loops."""

import random
import re
from collections import Counter, defaultdict

import pytest

from builders import dicts, reports
from errorloom.operators.tallies import tally
from errorloom.operators.templates import message_templates


def expected(messages, depth=2, share=0.2):
    shapes = Counter()
    variants = defaultdict(set)
    for message in messages:
        text = re.sub(r"""'[^']*'|"[^"]*\"""", "<text>", message or "")
        text = re.sub(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s,;)]+", "<url>", text)
        text = re.sub(r"\b(?:[0-9A-Fa-f]+-){2,}[0-9A-Fa-f]+\b|\b0[xX][0-9A-Fa-f]+\b", "<hex>", text)
        words = tuple(re.sub(r"[0-9]+(?:[.:][0-9]+)*", "<n>", text).split())
        shapes[words] += 1
        variants[words].add(message)
    leaves, places = Counter(), Counter()
    for words, times in shapes.items():
        leaf = (len(words), words[:depth])
        leaves[leaf] += times
        for place, word in enumerate(words):
            places[leaf, place, word] += times
    out = defaultdict(lambda: [0, 0])
    for words, times in shapes.items():
        leaf = (len(words), words[:depth])
        kept = [w if i < depth or places[leaf, i, w] >= share * leaves[leaf] else "<*>" for i, w in enumerate(words)]
        out[" ".join(kept)][0] += times
        out[" ".join(kept)][1] += len(variants[words])
    return {template: tuple(counts) for template, counts in out.items()}


def got(spark, messages, **options):
    table = tally(reports(spark, *[{"message": m} for m in messages]), "message")
    return {r["template"]: (r["times"], r["messages"]) for r in dicts(message_templates(table, **options))}


MESSAGES = (
    [f"Lookup of id {n} failed" for n in range(30)]
    + [f"Cannot read '{w}' of {o}" for w in ("a b", "c", "d") for o in ("null", "undefined")] * 5
    + [f"no user {''.join(random.Random(n).choices('xyzw', k=6))} here" for n in range(40)]
    + ["state is open now", "state is shut now"] * 10
    + ["see https://example.org/a?b=1, then 0xFF", "see http://example.com/zz, then 0x10", "id 12ab-34cd-56ef seen", "at 10:30:01 or 1.5.2"]
    + [None, "", "   ", "one", "x" * 20_000, "word " * 3_000]
)


def test_messages_that_differ_in_details_are_one(spark):
    found = got(spark, MESSAGES)
    assert found == expected(MESSAGES)
    assert found["Lookup of id <n> failed"] == (30, 30)
    assert found["no user <*> here"][0] == 40
    assert found["state is open now"] == found["state is shut now"] == (10, 1)


@pytest.mark.parametrize("depth, share", [(0, 0.2), (1, 0.5), (3, 0.05), (2, 1.0)])
def test_against_plain_loops(spark, depth, share):
    rng = random.Random(depth)
    words = ["open", "close", "file", "failed", "x1", "42", "'q'", "user"]
    messages = [" ".join(rng.choices(words, k=rng.randrange(1, 6))) for _ in range(400)]
    assert got(spark, messages, depth=depth, share=share) == expected(messages, depth, share)


def test_no_messages_and_wrong_arguments(spark):
    empty = tally(reports(spark, {}).where("false"), "message")
    assert message_templates(empty).count() == 0
    for options in ({"depth": -1}, {"share": 0}, {"share": 1.5}):
        with pytest.raises(ValueError):
            message_templates(empty, **options)


def test_both_ways_of_looking_up_a_leaf(spark):
    assert got(spark, MESSAGES, max_lookup_bytes=0) == expected(MESSAGES)
