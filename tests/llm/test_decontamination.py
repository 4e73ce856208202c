"""Decontamination against all substitutions that its rule accepts."""

import collections
import itertools
import math
import random

import pytest

from answerlab.llm import decontamination as D


def _accepted(same, window=13, similarity=0.8):
    k = min(window, len(same))
    return any(sum(same[s:s + k]) >= math.ceil(similarity * k - 1e-9) for s in range(len(same) - k + 1))


def _hit(same, masks):
    return any(all(same[p + o] for o in mask) for mask in masks for p in range(len(same) - mask[-1]))


@pytest.mark.parametrize("similarity", [0.8, 0.7, 1.0])
def test_masks_hit_every_accepted_pattern(similarity):
    # an accepted item of more than 13 words holds an accepted window of 13, so windows say it for all lengths
    for n in range(1, 14):
        for changed in range(n + 1):
            for at in itertools.combinations(range(n), changed):
                same = [i not in at for i in range(n)]
                assert not _accepted(same, similarity=similarity) or _hit(same, D.masks_for(n, similarity)), (n, at)


def test_masks_hit_random_substitutions_of_long_items():
    rnd = random.Random(1)
    for n in range(14, 61):
        for _ in range(1500):
            same = [rnd.random() > 0.2 for _ in range(n)]
            assert not _accepted(same) or _hit(same, D.masks_for(13, 0.8)), same


def test_equals_brute_force_for_all_item_lengths(spark):
    rnd = random.Random(2)
    items = [(n, [f"i{n}w{j}" for j in range(n)]) for n in (*range(1, 21), 30, 60)]
    texts, want, number = [], set(), 0
    for n, item in items:
        for _ in range(40):
            same = [rnd.random() > 0.2 for _ in item]
            texts.append((number, " ".join(["pre"] * rnd.randint(0, 3) + [w if s else "zz" for w, s in zip(item, same)] + ["post"])))
            if _accepted(same):
                want.add((number, n))
            number += 1
    for at in itertools.combinations(range(13), 2):
        texts.append((number, " ".join("zz" if j in at else w for j, w in enumerate(items[12][1]))))
        want.add((number, 13))
        number += 1
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    per = collections.Counter(d for d, _ in want)
    for part in (items, items[12:]):
        bench = spark.createDataFrame([(n, " ".join(w)) for n, w in part], "item_id long, text string")
        ids = {n for n, _ in part}
        for limits in ({}, {"broadcast_bytes": 0}, {"broadcast_bytes": 20_000}):
            got = {r.doc_id: r.n_items for r in D.decontaminate(docs, bench, **limits).collect()}
            assert got == {d: sum((d, n) in want for n in ids) for d, _ in texts}
    assert len(per) > 400
