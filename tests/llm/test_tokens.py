import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest_llm import pairs, rows_of

from venuemill.llm import packing, pretokens
from venuemill.llm.queries_llm import vocabulary

PIECE, BYTE = vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_50k.json")
ODD = [
    "  two  spaces ", " lead", "trail ", "a\n b", "a \n\n b", "tab\t x", "it's we'll  don't 's", "▁mark ▁ x▁▁y", "<|endoftext|>", "x <|endoftext|> y",
    "a <|endoftext|>  b", "<s> </s>", "\x00 \x1c y \x85 z", "é  ü", "12 345  6", " ", "  ", "　ideographic　space ", "...!? --", "🙂 🙂🙂", "a  b  c",
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")


def test_counts_equal_library(spark, awkward, given, odd):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    for docs in (awkward, given, odd):
        want = sorted(
            ((i, len((t or "").encode()), len(model.encode(t or ""))) for i, t in pairs(docs)),
            key=lambda r: tuple((v is not None, v) for v in r),
        )
        for share in (2e-6, 1e-2):  # nearly all, and few pre-tokens frequent
            assert rows_of(pretokens.count_tokens(docs, PIECE, share=share), "doc_id", "n_bytes", "n_tokens") == want


def test_no_rows(nothing):
    assert pretokens.count_tokens(nothing, PIECE).collect() == []
    assert packing.pack_documents(nothing, BYTE).collect() == []


def whole(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("capacity", [2048, 64])
def test_pieces_and_packing(spark, awkward, given, odd, capacity):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE)
    for docs in (awkward, given, odd):
        placed = packing.pack_documents(docs, BYTE, capacity).collect()
        want = []
        for i, t in pairs(docs):
            ids = whole(library, t)
            at = 0
            while at < len(ids):
                n = (len(ids) - at - 1) % capacity + 1
                want.append((i, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())))
                at += n
        key = lambda r: tuple((v is not None, v) for v in r)
        assert sorted(((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in placed), key=key) == sorted(want, key=key)
        bins = defaultdict(list)
        for r in placed:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for parts in bins.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= capacity
        total = sum(w[2] for w in want)
        assert len(bins) <= -(-total // capacity) * 1.02 + 2


def test_sequences_hold_the_ids(given):
    pieces = packing.token_pieces(given, BYTE, 512, keep_ids=True)
    ids = pieces.agg({"length": "sum"}).first()[0]
    filled = packing.sequences(packing.pack(pieces, 512)).collect()
    assert sum(len(r["ids"]) for r in filled) == 4 * ids
    assert max(len(r["ids"]) for r in filled) <= 4 * 512


def test_fullest_is_best():
    import itertools
    import random

    rng = random.Random(3)
    for _ in range(100):
        counts = {rng.randint(1, 12): rng.randint(1, 3) for _ in range(4)}
        room = rng.randint(0, 30)
        best = max(sum(n * k for n, k in zip(counts, ks)) for ks in itertools.product(*[range(c + 1) for c in counts.values()]) if sum(n * k for n, k in zip(counts, ks)) <= room)
        got = packing.fullest(counts, room)
        assert sum(n * k for n, k in got.items()) == best and all(k <= counts[n] for n, k in got.items())


def test_parts_go_to_the_library_side_by_side(monkeypatch):
    """Only parts with white space of their own need a mark between them; ids are those of the whole text."""
    encoder = packing.Encoder(BYTE)
    apart = []
    monkeypatch.setattr(encoder, "_apart", lambda parts, real=encoder._apart: apart.extend(parts) or real(parts))
    texts = [*ODD, "plain words, and\nlines. Ünï cödé 漢字 x\xa0y \x85z it's", " ".join(f"w{i}x" for i in range(1200)), ""]
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
        assert got == [encoder.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(encoder.later) > 1200 and len(apart) < 20


def test_special_strings_as_plain_text():
    encoder = packing.Encoder(BYTE, plain=True)
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(ODD)]
    assert got == [encoder.library.encode(t, add_special_tokens=False).ids for t in ODD]
    assert all(encoder.added[0] not in encoder.library.id_to_token(i) for x in got for i in x)
