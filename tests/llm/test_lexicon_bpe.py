"""The transducer, the merges and whole round trips against the library."""

import random
from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from defeasor.llm import lexicon_bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def vocab():
    return lexicon_bpe.vocabulary(lexicon_bpe.read(PATH))


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def odd_texts():
    rng = random.Random(4)
    out = [None, "", " ", "\n\n  \t x", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext", "I'll can't 's'S", "é́ ﬁ 漢字 🙂👍🏽", "\x00\x1c\x85\xa0 　x", "²³ ٣ Ⅷ", "a՘ ࢏1"]
    out += ["ab" * 40_000, "x" * 70, " " * 5000, "word " * 30_000, "naïve" * 20]
    return out + ["".join(rng.choice(" abcdeé漢🙂ß\n\t'12.,-　<|>") for _ in range(rng.randint(1, 300))) for _ in range(150)]


def test_words_below_latin_as_the_library_cuts_them(library):
    for c in [*range(0x250), *range(0x250, 0x3100, 7), 0x1F600]:
        text = f"a{chr(c)}1{chr(c)} .{chr(c)} x"
        assert [w for some in lexicon_bpe.words_of(text) for w in some] == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


def test_transducer_is_minimal_and_whole():
    rng = random.Random(2)
    words = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 7))): tuple(rng.choice([1, 2, 3]) for _ in range(rng.randint(1, 3))) for _ in range(300)}
    lexicon = lexicon_bpe.Lexicon(lexicon_bpe.compile_lexicon(words))
    for i in range(3**7):
        word = bytes(b"abc"[i // 3**k % 3] for k in range(i % 7 + 1))
        found = lexicon.find_all([word, b"abcabcabc", b""])
        assert found == [array("I", words[word]).tobytes() if word in words else None, None, None]
    same = {stem + tail: (7,) for stem in (b"walk", b"talk", b"call") for tail in (b"", b"s", b"ed", b"ing", b"er", b"ers")}
    shared = lexicon_bpe.Lexicon(lexicon_bpe.compile_lexicon(same))
    # brute force: states are the different sets of what may follow, with what is still to come of the output
    futures = {tuple(sorted(w[len(p) :] for w in same if w.startswith(p))) for w in same for p in (w[:k] for k in range(len(w) + 1))}
    assert shared.states == len(futures)
    assert lexicon_bpe.Lexicon(lexicon_bpe.compile_lexicon({})).find_all([b"a", b""]) == [None, None]


def test_merges_as_the_library_does(vocab, library):
    plain = lexicon_bpe.Encoder(vocab)
    for text in odd_texts():
        ids = array("I", plain.encode(text)).tolist()
        assert ids == library.encode(text or "", add_special_tokens=False).ids, (text or "")[:40]
    for word in (b"abcabcabc" * 3, b" the", b"internationalization", b"zz" * 16):
        assert vocab.merge(word) == vocab._merge_long([vocab.single[b] for b in word])


@pytest.mark.parametrize("lexicon_words", [1 << 15, 5, 0])
def test_round_trip(spark, library, lexicon_words):
    texts = odd_texts()
    rows = [(i if i % 5 else None, t, "x", b"y") for i, t in enumerate(texts)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids binary").repartition(3)
    encoded = lexicon_bpe.encode(docs, PATH, lexicon_words=lexicon_words)
    expected = [library.encode(t or "", add_special_tokens=False).ids for t in texts] * 2
    assert sorted(((r["doc_id"], array("I", r["ids"]).tolist(), r["n_tokens"]) for r in encoded.collect()), key=str) == sorted(((r[0], e, len(e)) for r, e in zip(rows, expected)), key=str)
    decoded = lexicon_bpe.decode(encoded, PATH)
    assert sorted(((r["doc_id"], r["decoded"]) for r in decoded.collect()), key=str) == sorted(((r[0], library.decode(e, skip_special_tokens=False)) for r, e in zip(rows, expected)), key=str)
    assert lexicon_bpe.encode(docs.limit(0), PATH).collect() == []


def test_ids_of_no_text(spark, library):
    cut = [(1, array("I", library.encode("漢字", add_special_tokens=False).ids[:1]).tobytes()), (2, None), (3, array("I", [70_000]).tobytes())]
    got = {r["doc_id"]: r["decoded"] for r in lexicon_bpe.decode(spark.createDataFrame(cut, "doc_id long, ids binary"), PATH).collect()}
    assert got == {1: library.decode(library.encode("漢字", add_special_tokens=False).ids[:1], skip_special_tokens=False), 2: "", 3: ""}


def test_query(spark, library, tmp_path):
    import hashlib

    texts = odd_texts()[:20]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op12_lexicon_bpe(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        sha = lambda b: hashlib.sha256(b).hexdigest()
        assert got[i] == (len(ids), sha(array("I", ids).tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode()))
