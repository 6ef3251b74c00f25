"""Words that collide under every polynomial modulo a power of two (Thue-Morse words and their complements)."""

import pytest
from conftest_llm import SCHEMA, pairs, rows_of
from test_neardup import brute as near_brute
from test_repeats import brute as window_brute
from test_substrings import brute as string_brute

from venuemill.llm import neardup, ppm, repeats, substrings


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") & 1] for i in range(n))


@pytest.fixture(scope="module", params=[1024, 4096])
def crafted(spark, request):
    one, other = thue_morse(request.param, "ab"), thue_morse(request.param, "ba")
    rest = [f"w{i}" for i in range(40)]
    chain = [(one, other)[bin(i).count("1") & 1] for i in range(64)]
    texts = [
        " ".join([one, *rest]), " ".join([other, *rest]), " ".join([one] * 6), " ".join([other] * 6), one, other,
        " ".join(chain), " ".join(other if w == one else one for w in chain),
    ]
    return spark.createDataFrame([(i, t, "en", "s", len(t), None, None) for i, t in enumerate(texts)], SCHEMA)


def test_windows(crafted):
    assert rows_of(repeats.remove_repeated_windows(crafted)) == window_brute(pairs(crafted), 35)


def test_near_duplicates(crafted):
    assert rows_of(neardup.near_duplicates(crafted)) == near_brute(pairs(crafted))


def test_byte_strings(crafted):
    rows = [tuple(r) for r in substrings.remove_earlier_strings(crafted).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()]
    assert sorted((*r[:4], bytes(r[4])) for r in rows) == string_brute(pairs(crafted), substrings.LENGTH)


def test_known_words(crafted):
    from pyspark.sql import functions as F

    docs = crafted.filter("doc_id IN (4, 5)")
    known = {r["doc_id"]: r["n_known"] for r in ppm.score(docs, held_out=F.col("doc_id") == 5).collect()}
    assert known == {4: 2, 5: 1}  # its word was not seen, only the end was
