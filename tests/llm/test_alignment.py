import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import SCHEMA, pairs, rows_of

from venuemill.llm import alignment
from venuemill.llm.queries_llm import vocabulary

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
ODD = ["x <|endoftext|> y", "<s> </s> <0x41>", "▁mark ▁", " lead  two ", "🙂🙂 ✓ 漢字 é", "new\nline\ttab", "\x00 a", "a" * 3000]


def letters():
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    out, more = {}, 256
    for b in range(256):
        if b in plain:
            out[chr(b)] = b
        else:
            out[chr(more)] = b
            more += 1
    return out


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    one, two, table = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), letters()
    one.encode_special_tokens = True
    docs = []
    for i, text in rows:
        e = one.encode(" " + (text or ""), add_special_tokens=False)
        x = [(k, bytes(table[c] for c in t)) for k, t in zip(e.ids, e.tokens)]
        y = []
        for k in two.encode(text or ""):
            piece = two.id_to_piece(k)
            y.append((k, bytes([int(piece[3:-1], 16)]) if two.is_byte(k) else piece.replace("▁", " ").encode()))
        want = b" " + (text or "").encode()
        if not text or b"".join(b for _, b in x) != want or b"".join(b for _, b in y) != want:
            x = y = []
        docs.append((i, x, y))
    spans = lambda toks: [(k, int(e) - len(b), int(e)) for (k, b), e in zip(toks, np.cumsum([len(b) for _, b in toks]))]
    links, count = [], Counter()
    for _, x, y in docs:
        own = [(p, q) for p, s, e in spans(x) for q, t, f in spans(y) if max(s, t) < min(e, f)]
        links.append(own)
        count.update(set(own))
    best = defaultdict(int)
    for (p, _), n in count.items():
        best[p] = max(best[p], n)
    out = []
    for (i, x, y), own in zip(docs, links):
        ends = sorted({e for _, _, e in spans(x)} & {e for _, _, e in spans(y)})
        groups, low = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(k) for k, _, f in spans(z) if low < f <= e) for z in (x, y)))
            low = e
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((i, len(x), len(y), len(groups), len(own), sum(count[p] == best[p[0]] for p in own), sum(count[p] for p in own), sha))
    return sorted(out, key=lambda r: tuple((v is not None, v) for v in r))


@pytest.mark.parametrize("chunk_bytes", [500, alignment.CHUNK_BYTES])
def test_equals_comparing_all(spark, awkward, given, chunk_bytes):
    odd = spark.createDataFrame([(3000 + i, t, None, None, None, None, None) for i, t in enumerate(ODD)], SCHEMA)
    short = given.filter("length(text) < 1500")
    for docs in (awkward.unionByName(odd).filter("text IS NULL OR length(text) < 6000"), short):
        assert rows_of(alignment.align(docs, A, B, chunk_bytes=chunk_bytes)) == brute(pairs(docs))


def test_no_rows(nothing):
    assert alignment.align(nothing, A, B).collect() == []


def test_galloping():
    rng = np.random.default_rng(1)
    for _ in range(300):
        table = np.sort(rng.choice(2000, rng.integers(1, 300), replace=False))
        wanted, guess = np.sort(rng.integers(0, 2100, 40)), rng.integers(-5, 400, 40)
        got = alignment.ranks(wanted, guess, np.zeros(40, int), np.full(40, len(table)), table)
        assert got.tolist() == np.searchsorted(table, wanted).tolist()
    assert len(alignment.ranks(*[np.zeros(0, int)] * 4, np.arange(3))) == 0


def test_parts_are_encoded_once():
    """Ids of A are the library's, and known parts are not asked for again."""
    pair = alignment.Pair(A, B)
    texts = [*ODD, "some words, and\nsome words again", ""]
    for _ in range(2):
        a, b = pair.encode(texts)
        ids = [pair.a.encode(" " + t, add_special_tokens=False).ids if t and n else [] for t, n in zip(texts, a.counts)]
        assert a.ids.tolist() == [i for x in ids for i in x] and a.counts.tolist() == [len(x) for x in ids]
        assert len(a.counts) == len(b.counts) and (a.counts > 0).sum() >= len(texts) - 2
    assert {"some", "words,", "again"} <= pair.encoder.later.keys()
