"""Files of several JSON documents against a decoder that reads them from the start."""

import json
import random

import pytest

from defeasor.sources.documents import cut_line, read_documents


def slow(text):
    decoder, at, out = json.JSONDecoder(), 0, []
    while text[at:].strip():
        at += len(text[at:]) - len(text[at:].lstrip())
        value, at = decoder.raw_decode(text, at)
        out.append(value)
    return out


def value(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice(['}{', '"', '\\', '\\"}', "[", "a\nb", "", 1, None, "é]"])
    return {rng.choice(["a", "}", '{"']) + str(i): value(rng, depth - 1) for i in range(rng.randint(0, 3))} if rng.random() < 0.5 else [value(rng, depth - 1) for _ in range(rng.randint(0, 3))]


def document(rng):
    return json.dumps({"v": value(rng, 4)} if rng.random() < 0.5 else [value(rng, 4)], indent=rng.choice([None, 1, 4]), ensure_ascii=False)


@pytest.mark.parametrize("split", ["134217728", "64"])
def test_random_files(spark, tmp_path, split):
    rng, want = random.Random(5), {}
    for f in range(6):
        text = "".join(document(rng) + rng.choice(["", "\n", " \n\n"]) for _ in range(rng.randint(0, 12)))
        (tmp_path / f"f{f}.json").write_text(text, encoding="utf-8")
        want[f"f{f}.json"] = slow(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = read_documents(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {name: [] for name in want}
    for r in sorted(rows, key=lambda r: (r["file"], r["doc"])):
        name = r["file"].rsplit("/", 1)[1]
        assert r["doc"] == len(got[name])
        got[name].append(json.loads(r["text"]))
    assert got == want


@pytest.mark.parametrize("text,what", [('{"a": 1}{"b": [1,\n', "unfinished"), ('{"a": 1}}\n{', "closes nothing"), ("}{", "closes nothing"), ('{"a":\n1}\n}\n{"a": 1}', "closes nothing")])
def test_broken_files(spark, tmp_path, text, what):
    (tmp_path / "f.json").write_text(text)
    with pytest.raises(Exception, match=what):
        read_documents(spark, str(tmp_path)).collect()


def test_cut_line():
    assert cut_line('1}{"}": 2}[', 1) == [("1}", True), ('{"}": 2}', True), ("[", False)]
    assert cut_line("", 0) == [("", False)]
