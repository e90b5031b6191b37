"""Spelling variants against all pairs and against the contract's words."""

import random
import re
import zlib
from collections import Counter

import pytest

from defeasor.llm import spelling


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) < len(b):
        a, b = b, a
    i = next((i for i in range(len(b)) if a[i] != b[i]), len(b))
    return a[i + 1 :] == (b[i + 1 :] if len(a) == len(b) else b[i:])


def slow_variants(counted, ratio=2):
    near = {w: [x for x in counted if one_edit(w, x)] for w in counted}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-counted[x], x), default=None)
        form[w] = best if best is not None and counted[best] >= ratio * counted[w] else None
    out = []
    for w, n in counted.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counted.get(form[w])))
    return sorted(out, key=str)


def slow_words(rows, every=97):
    seen = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}


@pytest.mark.parametrize("hot", [256, 8, 2])
def test_pairs_against_all_pairs(spark, hot):
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 9))) for _ in range(500)} | {"x" * 40, "x" * 41, "x" * 39 + "y"}
    counted = {w: rng.choice([3, 4, 6, 7, 12, 13, 30, 100]) for w in words}
    got = spelling.variants(spark.createDataFrame(list(counted.items()), "word string, n long"), hot=hot)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect()), key=str) == slow_variants(counted)


def test_hot_keys_are_divided(spark):
    words = {"prefix" + "".join(x) for x in ((a, b, c) for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh")}
    rows = spelling.met_under_keys(spark.createDataFrame([(w, 3) for w in words], "word string, n long"), hot=64)
    sizes = rows.groupBy(*spelling.KEY).count().collect()
    assert all(r["count"] <= 64 or r["l"] - r["p"] - r["s"] <= 1 for r in sizes)


def test_texts(spark):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(4, 8))) for _ in range(60)] + ["Élan", "naïve", "Straße", "ABÀÉÇ"]
    rows = [(i if i % 7 else None, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    rows += [rows[3]] * 5 + [(1, None), (2, ""), (3, "12 ,;"), (4, " ".join(rng.choice(vocab) for _ in range(20_000))), (5, "q" * 30_000)]
    docs = spark.createDataFrame([(i, t, "w", "n") for i, t in rows], "doc_id long, text string, word string, n string").repartition(3)
    got = spelling.spelling_variants(docs, slips_every=97)
    expected = slow_variants(slow_words(rows))
    assert any(r[1] for r in expected) and sorted(map(tuple, got.collect()), key=str) == expected
    assert spelling.spelling_variants(docs.limit(0), slips_every=97).collect() == []
    plain = {r["word"]: r["n"] for r in spelling.spelling_variants(docs).collect()}
    assert plain == slow_words(rows, every=1 << 40)
