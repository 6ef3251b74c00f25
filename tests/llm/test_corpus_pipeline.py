"""The stages against plain Python, one after the other."""

import zlib

import numpy as np
import pytest
import test_decontaminate
import test_lines
import test_neardup
from conftest_llm import SCHEMA, SF, awkward_rows, pairs

import corpus_pipeline
from venuemill.llm import quality
from venuemill.llm.queries_llm import references_of, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_kept(rows, references):
    return [(i, t) for i, t, lang in rows if quality.measure(None if t is None else t.encode(), lang, references)[-1]]


def without_lines(rows):
    kept = {r[0]: r[3] for r in test_lines.brute(rows)}
    return [(i, kept[i]) for i, _ in rows]


def one_of_each(rows):
    keep = {i for i, _, c in test_neardup.brute(rows) if i == c}
    return [r for r in rows if r[0] in keep]


def cleaned(rows, items):
    where = {}
    for name, t in items:
        w = test_decontaminate.words(t)
        n = min(10, len(w))
        for s in range(len(w) - n + 1) if w else ():
            where[tuple(w[s : s + n])] = n
    out = []
    for i, t in rows:
        import re

        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        found = [(m[0], m.span()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]
        w = [x for x, _ in found]
        hit = set()
        for n in set(where.values()):
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in where:
                    hit.update(range(s, s + n))
        if len(hit) > 0.5 * len(w):
            continue
        keep, at = [], 0
        for k in sorted(hit):
            if k - 1 in hit:  # the gap inside a run goes too
                at = found[k][1][1]
            else:
                keep.append(t[at : found[k][1][0]])
                at = found[k][1][1]
        out.append((i, "".join([*keep, t[at:]])))
    return out


def test_every_stage_equals_plain_python(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_duplicates", "benchmark_decontamination", "best_fit_packing"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = quality_kept([(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()], references_of(spark, docs, SF))
    steps = [lambda x: x, without_lines, one_of_each, lambda x: cleaned(x, items)]
    for (_, stage), step in zip(corpus_pipeline.STAGES, steps):
        docs = stage(spark, docs, SF).cache()
        want = step(want)
        assert docs.columns == COLUMNS
        assert sorted(pairs(docs)) == sorted(want)
        assert docs.filter("n_chars != length(text)").count() == 0
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    placed = corpus_pipeline.run(spark, SF).collect()
    whole = {i: [*library.encode(t, add_special_tokens=False).ids, 0] for i, t in want}
    assert sum(r["length"] for r in placed) == sum(map(len, whole.values()))
    for r in placed:
        part = whole[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
    by = {}
    for r in placed:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in x) <= 2048 for x in by.values())


@pytest.mark.parametrize("rows", [[], awkward_rows()])
def test_awkward_documents_pass_all_stages(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs.columns, stage(spark, docs, SF).cache()
        docs.count()
        if name != "best_fit_packing":
            assert docs.columns == before
