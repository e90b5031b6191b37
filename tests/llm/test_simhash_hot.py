"""A block key that very many fingerprints share: the pivot table cuts it, and no link is lost."""

import random

import numpy as np

from defeasor.llm import simhash


def test_a_key_of_many_fingerprints(spark):
    rng = random.Random(12)
    low = rng.getrandbits(34)
    fps = {(rng.getrandbits(30) << 34) | low for _ in range(49_000)}
    for x in rng.sample(sorted(fps), 1000):
        for b in rng.sample(range(34, 64), rng.randint(1, 3)):
            x ^= 1 << b
        fps.add(x)
    arr = np.array(sorted(fps), np.uint64)
    label = np.arange(len(arr))
    links = [(i, i + 1 + j) for i in range(len(arr)) for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= 3).tolist()]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    reps = spark.createDataFrame([(x,) for x in arr.view(np.int64).tolist()], "__fp long")
    found = {r[0]: r[1] for r in simhash.components(simhash.links(reps)).collect()}
    roots = {}
    for x, c in zip(arr.view(np.int64).tolist(), label.tolist()):
        roots.setdefault(c, set()).add(found.get(x, x))
    assert len(links) > 1000
    assert all(len(r) == 1 for r in roots.values()) and len({next(iter(r)) for r in roots.values()}) == len(roots)
