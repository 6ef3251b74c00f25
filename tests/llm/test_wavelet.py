import random
import zlib

import numpy as np
import pytest
from conftest_llm import SCHEMA, pairs, rows_of

from venuemill.llm import wavelet
from venuemill.llm.queries_llm import vocabulary

WORDS = vocabulary("word_bpe_49k.json")
KEY = lambda r: tuple((v is not None, v) for v in r)
ODD = [
    "a <|endoftext|>b", "x<|startoftext|>y z", "É  é́   nb", "it's 12 345 don't we'll.", "ΣΑΣ Σ.", "\x00 \x85 z", "Å ﬁ Å.", "ends. (this). \"that\", é, ñ; ÷. a.b .c 5.", "wait... no?! ,", "Word WORD word, Word.",
]


def folder(tmp_path):
    return f"file://{tmp_path}/tokens"


def library_ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids, wavelet.END_ID]


def with_odd(spark, awkward):
    return awkward.unionByName(spark.createDataFrame([(2000 + i, t, None, None, None, None, None) for i, t in enumerate(ODD)], SCHEMA))


@pytest.mark.parametrize("shard_ids", [50, wavelet.SHARD_IDS])
def test_round_trip(spark, awkward, given, tmp_path, shard_ids):
    """Documents come back with the library's ids; starts follow ascending ids."""
    for name, docs in (("a", with_odd(spark, awkward)), ("g", given)):
        place = f"{folder(tmp_path)}-{name}"
        wavelet.write_shards(docs, place, WORDS, shard_ids=shard_ids, task_bytes=20_000)
        got = wavelet.read_documents(spark, place, keep_ids=True).collect()
        ids = {}
        for i, t in pairs(docs):
            ids.setdefault(i, []).append(library_ids(t))
        assert sorted(((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got), key=KEY) == sorted(
            ((i, x) for i, own in ids.items() for x in own), key=KEY)
        at = 0
        for r in sorted(got, key=lambda r: r["start"]):
            assert r["start"] == at and r["n_tokens"] == len(r["ids"]) // 4 and r["ids_crc32"] == zlib.crc32(r["ids"])
            at += r["n_tokens"]
        order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
        assert order == sorted(order, key=lambda i: (i is not None, i))
        tokens = [t for own in ids.values() for x in own for t in x]
        wanted = [wavelet.END_ID, tokens[0], max(tokens), 48_000, 1 << 20]
        assert dict(rows_of(wavelet.token_counts(spark, place, wanted))) == {t: tokens.count(t) for t in wanted}
        found = rows_of(wavelet.occurrences(spark, place, tokens[0]))
        assert found == sorted(((i, k) for i, own in ids.items() for x in own for k, t in enumerate(x) if t == tokens[0]), key=KEY)


def test_no_rows(spark, nothing, tmp_path):
    wavelet.write_shards(nothing, folder(tmp_path), WORDS)
    assert wavelet.read_documents(spark, folder(tmp_path)).collect() == []
    assert rows_of(wavelet.token_counts(spark, folder(tmp_path), [5])) == [(5, 0)]
    assert wavelet.occurrences(spark, folder(tmp_path), 5).collect() == []


@pytest.mark.parametrize("n,top", [(0, 5), (1, 1), (511, 3), (512, 70_000), (513, 1), (5000, 49_000)])
def test_rank_select_access(n, top):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top, n).astype(np.uint32)
    shard = wavelet.Shard.from_bytes(wavelet.Shard.of(ids, np.array([7]), np.array([n])).to_bytes())
    assert shard.ids().tolist() == ids.tolist()
    for token in {*ids[:5].tolist(), 0, top, 1 << 20}:
        assert shard.places(token).tolist() == np.flatnonzero(ids == token).tolist()
        low, high = sorted(rng.integers(0, n + 1, 2).tolist())
        assert shard.count(token, low, high) == int((ids[low:high] == token).sum())
    if n:
        at = rng.integers(0, n, 40)
        assert shard.access(at).tolist() == ids[at].tolist()


def test_long_text(spark, tmp_path):
    """One text far above a shard's size is a shard of its own."""
    text = " ".join(f"w{random.Random(i).randint(0, 999)}" for i in range(300_000))
    docs = spark.createDataFrame([(1, text), (0, "x"), (2, None)], "doc_id long, text string")
    wavelet.write_shards(docs, folder(tmp_path), WORDS, shard_ids=1000)
    got = {r["doc_id"]: r for r in wavelet.read_documents(spark, folder(tmp_path)).collect()}
    assert got[1]["n_tokens"] == len(library_ids(text)) and got[1]["start"] == got[0]["n_tokens"] and got[2]["n_tokens"] == 1


def test_not_a_token_file():
    with pytest.raises(ValueError):
        wavelet.Shard.from_bytes(b"x" * 100)


def test_latin_words_go_to_the_model(monkeypatch):
    """Words of Latin letters do not pass the library's normalizer one text after another; ids are the library's."""
    encoder = wavelet.WordEncoder(WORDS, 1000)
    words = ["hello", "Straße", "ñandú", "íos", "ªº", "ŉa", "ƀɏ", "naïveté", *(f"{a}{b}x" for a in "abcdé" for b in "äöüqz")]
    monkeypatch.setattr(encoder, "_ids", None)
    got = encoder.encode([w.encode() for w in words])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library_ids(w)[:-1] for w in words]
    monkeypatch.undo()
    odd = ["e\u0301a", "İx", "ǅa", "ΣΑΣ σας", "漢字", "ɐb", "x2y", "<|endoftext|>a", "don't"]
    got = encoder.encode([w.encode() for w in odd])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library_ids(w)[:-1] for w in odd]
