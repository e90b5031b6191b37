"""The sweep against a quadratic alignment of the libraries' own tokens."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from defeasor.llm import alignment, lexicon_bpe

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def slow_align(texts):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, groups)."""
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    t.no_padding()
    t.no_truncation()
    symbols = lexicon_bpe.byte_symbols()
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    each, total = [], Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = t.encode(" " + (text or ""), add_special_tokens=False).ids
        b = model.encode(text or "", num_threads=1)
        a_bytes = [bytes(symbols[c] for c in t.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [model.id_to_piece(i)]]
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            each.append(None)
            continue

        def spans(parts):
            at, out = 0, []
            for p in parts:
                out.append((at, at + len(p)))
                at += len(p)
            return out

        sa, sb = spans(a_bytes), spans(b_bytes)
        ends = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, start = [], 0
        for e in ends:
            groups.append(",".join(str(i) for i, s in zip(a, sa) if start < s[1] <= e) + "|" + ",".join(str(i) for i, s in zip(b, sb) if start < s[1] <= e))
            start = e
        links = [(x, y) for x, s in zip(a, sa) for y, u in zip(b, sb) if s[0] < u[1] and u[0] < s[1]]
        total.update(links)
        each.append((len(a), len(b), len(ends), links, ";".join(groups)))
    best = {}
    for (_, y), n in total.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for x in each:
        if x is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            links = x[3]
            out.append((x[0], x[1], x[2], len(links), sum(total[k] == best[k[1]] for k in links), sum(total[k] for k in links), hashlib.sha256(x[4].encode()).hexdigest()))
    return out


def texts():
    rng = random.Random(8)
    vocab = "the cat café überall naïve straße information internationalization 漢字 don't 12345 x,y;z <|endoftext|> <s> </s> <0x0A> \t \n\n   ﬁ ａ".split(" ")
    out = [None, "", " ", "a", "▁", "a ▁ b", "▁a", "a▁ b", "\x00a\x00", "  lead", "trail  ", "\xa0x　y", "🙂👍🏽", "1 000 000"]
    out += [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    return out + ["".join(rng.choice("ab é▁漢\n") for _ in range(30)) for _ in range(30)] + ["same text here"] * 40


def rows_of(spark, some):
    return spark.createDataFrame([(i if i % 6 else None, t, "k", b"c") for i, t in enumerate(some)], "doc_id long, text string, k1 string, codes binary").repartition(3)


def result(df):
    return sorted(((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("most_broadcast,run,links", [(1 << 21, 1 << 12, 1 << 17), (0, 7, 5)])
def test_against_the_libraries(spark, monkeypatch, most_broadcast, run, links):
    monkeypatch.setattr(alignment, "LINKS", links)
    monkeypatch.setattr(alignment, "RUN", run)
    some = texts()
    got = result(alignment.align(rows_of(spark, some), A, B, most_broadcast=most_broadcast))
    assert got == sorted(((i if i % 6 else None, *x) for i, x in enumerate(slow_align(some))), key=str)


def test_stretches_are_the_whole(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    pieces = alignment.Pieces(model, "<u2")
    assert pieces.local
    for text in texts():
        if text and "▁" not in text:
            packed = pieces.encode(text)
            assert list(memoryview(packed).cast("H")) == model.encode(text, num_threads=1)


def test_machine_in_small_runs():
    rng = random.Random(3)
    import numpy as np

    lengths = np.array([1, 2, 3, 5]), np.array([1, 2, 4])
    written = alignment.signed_ids(4)

    def drawn(sizes, total):
        ids, at = [], 0
        while at < total:
            i = rng.randrange(len(sizes))
            if at + sizes[i] <= total:
                ids.append(i)
                at += sizes[i]
        return ids

    for _ in range(100):
        total = rng.randint(1, 60)
        a, b = drawn(lengths[0], total), drawn(lengths[1], total)
        results = []
        for enough in (1 << 20, 1):
            m = alignment.Sweep(lengths, written, 3)
            for i in range(0, max(len(a), len(b)), 2):
                m.enough = enough
                m.take(0, np.array(a[i : i + 2], "<u2"))
                m.enough = enough
                m.take(1, np.array(b[i : i + 2], "<u2"))
            m.settle()
            results.append((m.n, m.n_groups, m.n_links, m.sha.hexdigest(), m.links()))
        assert results[0] == results[1]


def test_empty_and_long(spark):
    assert alignment.align(rows_of(spark, texts()).limit(0), A, B).collect() == []
    rng = random.Random(1)
    long = " ".join(rng.choice(["alpha", "beta", "naïve", "42"]) for _ in range(3000))
    got = result(alignment.align(rows_of(spark, ["x", long]), A, B))
    assert got == sorted(((i if i % 6 else None, *x) for i, x in enumerate(slow_align(["x", long]))), key=str)
