"""The Jaccard join on families of texts that drift apart, against brute force; and one block a pair."""

import random

import numpy as np
import pytest

from errorloom.llm import jaccard


def drifting(seed, families=6, members=40):
    """Texts of which each differs from the one before in a few words; all quote one passage; some are copies."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(12)]
    texts = []
    for _ in range(families):
        words = passage + [word() for _ in range(rng.randrange(40, 140))]
        for _ in range(members):
            if rng.random() < 0.8:
                for _ in range(rng.choice((1, 1, 2, 3))):
                    words[rng.randrange(len(passage), len(words))] = word()
            if rng.random() < 0.2:
                words = words[:-1] + [word(), word()]
            texts.append(" ".join(words))
    rng.shuffle(texts)
    return texts


def by_brute_force(texts):
    sets = [{tuple(x.split()[i : i + 5]) for i in range(len(x.split()) - 4)} for x in texts]
    lead = list(range(len(texts)))

    def root(i):
        while lead[i] != i:
            lead[i] = i = lead[lead[i]]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if 100 * len(x & sets[j]) >= 75 * len(x | sets[j]):
                a, b = sorted((root(i), root(j)))
                lead[b] = a
    return {(i, len(x), root(i)) for i, x in enumerate(sets)}


@pytest.mark.parametrize("block", [4096, 16])
def test_drifting_families_are_as_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    crossed = []
    across = jaccard._across
    monkeypatch.setattr(jaccard, "_across", lambda *args: crossed.append(across(*args)) or crossed[-1])
    texts = drifting(block)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {tuple(r) for r in jaccard.groups(docs).select("doc_id", "n_shingles", "component_id").collect()}
    assert got == by_brute_force(texts)
    assert crossed


def test_a_pair_comes_out_of_its_first_block():
    base = np.arange(100, dtype=np.uint64) * np.uint64(7919)
    nodes, sets = [1, 2], [base, base[:99]]
    columns = (nodes, [100, 99], [jaccard.signature(x) for x in sets], nodes, [0, 0])
    (pair,) = jaccard.block_pairs(5, *columns, [[5, 9], [5, 9]])
    assert sorted(pair) == [1, 2]
    assert jaccard.block_pairs(9, *columns, [[5, 9], [5, 9]]) == []
    # What is not known to be shared earlier is not left out.
    assert len(jaccard.block_pairs(9, *columns, [[4, 9], [5, 9]])) == 1
    assert len(jaccard.block_pairs(9, *columns, [[4], [5, 9]])) == 1
    two_parts = (nodes + [3], [100, 99, 100], [jaccard.signature(x) for x in sets + [base]], nodes + [3], [0, 0, 1])
    found = {frozenset(p) for p in jaccard.block_pairs(5, *two_parts, [[5]] * 3)}
    assert found == {frozenset((1, 3)), frozenset((2, 3))}
