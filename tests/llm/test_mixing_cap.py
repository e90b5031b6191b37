"""The mix holds as many words as its report takes, whatever the cap."""

from collections import Counter

import pytest

from defeasor.llm import mixing


@pytest.mark.parametrize("cap, share", [(1.5, 1.2), (3.0, 2.8), (4.5, 4.0)])
def test_mix_is_whole(spark, cap, share):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(i % 7)), "ab"[i % 5 == 0]) for i in range(60)]
    rows += [rows[4]] * 3 + [(None, "p q r", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = Counter()
    for r in mixing.mix_report(docs, cap=cap, share=share).collect():
        taken[r["doc_id"]] += r["taken"]
    words, whole = Counter(), dict((i, t) for i, t, _ in rows)
    assert cap < 3 or any(n > 2 * len(whole[i].split()) for i, n in taken.items())
    for r in mixing.mix(docs, cap=cap, share=share).collect():
        words[r["doc_id"]] += len(r["text"].split())
        assert whole[r["doc_id"]].startswith(r["text"])
    assert +words == +taken
