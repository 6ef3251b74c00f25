import re
from collections import Counter

from conftest_llm import SF, pairs, rows_of

from venuemill.llm import quality
from venuemill.llm.queries_llm import op2_quality_divergence, references_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = {s + k for s in range(len(words) - 2) if grams[tuple(words[s : s + 3])] > 1 for k in range(3)}
    dup, seen = 0, set()
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed


def test_base_counts(awkward, given):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for docs in (awkward, given):
        want = sorted(((i, *base(t)) for i, t in pairs(docs)), key=lambda r: tuple((v is not None, v) for v in r))
        assert rows_of(quality.quality_rules(docs, {}), *columns) == want


def test_verdict_agrees_with_labels(spark):
    """Held-out check: good documents stay, most bad ones go."""
    sf = "/root/testdata/sf0.01"
    out = op2_quality_divergence(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = out.join(labels, "doc_id").filter("n_words >= 50").select("quality", "kept").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.99 * len(good)
    assert sum(bad) <= 0.35 * len(bad)


def test_distance():
    import numpy as np

    a, b = np.array([1.0, 0.0]), np.array([0.0, 2.0])
    assert quality.distance(a, a * 3) == 0 and abs(quality.distance(a, b) - 1) < 1e-9
    assert quality.distance(a, a * 0) == 1


def test_removal_keeps_columns(spark, awkward, nothing, given):
    references = references_of(spark, given, SF)
    out = quality.rejected_rows_removed(awkward, references)
    assert out.schema == awkward.schema
    kept = quality.quality_rules(awkward, references).filter("kept").count()
    assert out.count() == kept
    assert quality.rejected_rows_removed(nothing, {}).collect() == []
    assert quality.quality_rules(nothing, {}).collect() == []


def model(rows, labels, per_language=quality.REFERENCE_DOCS):
    """doc_id -> (character distance, word distance, kept), worked out with dictionaries from the rules as the README states them."""
    import math
    import unicodedata  # noqa: F401

    def classes(text):
        c = Counter()
        for x in text:
            c["lower" if "a" <= x <= "z" else "upper" if "A" <= x <= "Z" else "digit" if "0" <= x <= "9" else x if x in " \n" else
              "stop" if x in ".," else "mark" if x in ";:!?'\"()-" else "other" if ord(x) < 128 else "far"] += 1
        return c

    def plain(text):
        return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", "".join(x.lower() if x.isascii() else x for x in text))

    def divergence(p, q):
        n, m = sum(p.values()), sum(q.values())
        if not n or not m:
            return 1.0
        total = 0.0
        for a, k, b, j in ((p, n, q, m), (q, m, p, n)):
            total += sum(v / k * math.log2(2 * (v / k) / (v / k + b.get(x, 0) / j)) for x, v in a.items() if v) / 2
        return math.sqrt(max(0.0, total))

    good = {i for i, quality_, toxic in labels if quality_ == 1 and toxic == 0}
    texts = {}
    for i, text, lang in rows:
        if i in good and lang is not None and text is not None:
            texts.setdefault(lang, set()).add(text)
    assert all(len(t) <= per_language for t in texts.values())  # no sampling at this size
    references = {}
    for lang, own in texts.items():
        words, chars, seen = Counter(), Counter(), set()
        for text in sorted(own):
            w = plain(text)
            grams = sorted(set(zip(w, w[1:], w[2:])), key=lambda g: quality.hash_of(tuple(x.encode() for x in g)))[:1]
            if tuple(grams) in seen:
                continue
            seen.add(tuple(grams))
            words.update(w)
            chars.update(classes(text))
        top = sorted(words.items(), key=lambda x: (-x[1], x[0].encode()))[: quality.COMMON_WORDS]
        if words:
            references[lang] = chars, dict(top) | {None: sum(words.values()) - sum(n for _, n in top)}
    out = {}
    for i, text, lang in rows:
        text = text or ""
        kept, by_char, by_word = not base(text)[-1], None, None
        if lang in references:
            chars, words = references[lang]
            own = plain(text)
            if len(text) >= quality.MIN_CHARS:
                by_char = divergence(classes(text), chars)
                kept &= by_char <= quality.CHAR_LIMIT + quality.CHAR_NOISE / math.sqrt(sum(chars.values()))
            if len(own) >= quality.MIN_WORDS:
                by_word = divergence(Counter(w if w in words else None for w in own), words)
                kept &= by_word <= quality.WORD_LIMIT + quality.WORD_NOISE * math.sqrt(1 / len(own) + 1 / sum(words.values()))
        out[i] = by_char, by_word, kept
    return out


def test_verdict_equals_model(spark):
    """Distances and verdict of every document, small languages included."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    want = model([(r["doc_id"], r["text"], r["lang"]) for r in docs], labels)
    got = {r["doc_id"]: r for r in op2_quality_divergence(spark, SF).collect()}
    assert got.keys() == want.keys()
    for i, (by_char, by_word, kept) in want.items():
        for a, b in ((got[i]["char_distance"], by_char), (got[i]["word_distance"], by_word)):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9), i
        assert got[i]["kept"] == kept, i
    assert sum(w is not None for _, w, _ in want.values()) > 50


def test_all_labelled_documents_make_the_reference(spark):
    """1,500 labelled documents of one language: their words are all counted, near copies once."""
    name = lambda i: "".join(chr(97 + int(c)) for c in f"{i:05d}")
    texts = [" ".join(f"{name(i)}{x}" for x in "pqr") + " common" for i in range(1500)] + [" ".join(f"{name(3)}{x}" for x in "pqr") + " common"]
    docs = spark.createDataFrame([(i, t, "aa") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    (chars, common, counts), = quality.language_references(docs, docs.select("doc_id")).values()
    assert counts.sum() == 1500 * 4 and counts[common[b"common"]] == 1500
    assert chars[0] == sum(len(t.replace(" ", "")) for t in texts[:1500])


def test_few_texts_move(spark, tmp_path):
    """Only texts of labelled documents, and the few others that the sieve lets through, leave their task; the references stay the same."""
    noise = lambda i: " ".join(f"{(i * 7919 + k * 104729) % 1000003:x}" for k in range(300))
    spark.createDataFrame([(i, noise(i), "aa") for i in range(2000)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    good = spark.createDataFrame([(i,) for i in range(0, 2000, 100)], "doc_id long")
    counter = spark.sparkContext.statusTracker()
    seen = set()
    spark.sparkContext.setJobGroup("references", "")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with many labels
    try:
        some = quality.language_references(docs, good)
        for job in counter.getJobIdsForGroup("references"):
            seen |= set(counter.getJobInfo(job).stageIds)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sparkContext._jsc.clearJobGroup()
    store = spark.sparkContext._jsc.sc().statusStore()
    written = sum(store.lastStageAttempt(k).shuffleWriteBytes() for k in seen)
    assert written < 1_000_000  # the texts have 4 million bytes
    few = good.join(docs, "doc_id")
    again = quality.language_references(few, good)
    assert some["aa"][1] == again["aa"][1] and (some["aa"][2] == again["aa"][2]).all() and (some["aa"][0] == again["aa"][0]).all()
