"""JSON arrays read by byte ranges."""

import json
import random

import pytest
from pyspark.sql import types as T

from venuemill.sources import json_arrays, tables

SCHEMA = T.StructType([T.StructField("n", T.LongType()), T.StructField("s", T.StringType()), T.StructField("a", T.ArrayType(T.StringType())), T.StructField("o", T.MapType(T.StringType(), T.StringType()))])
STRINGS = ["}{][", '\\"}', "\\", "\\\\", '"', '"{"', "é✓🙂}", "", "\n\t", "a, {b}", "\\\\\"", "[" * 40, "plain"]


def rows(n, seed):
    rng = random.Random(seed)
    pick = lambda: rng.choice(STRINGS) * rng.choice([1, 1, 1, 30])
    return [{"n": i, "s": pick(), "a": [pick() for _ in range(rng.randint(0, 3))], "o": {pick() + str(k): pick() for k in range(rng.randint(0, 2))}} for i in range(n)]


def read(spark, path, range_bytes):
    out = json_arrays.read_json_arrays(spark, str(path), SCHEMA, range_bytes)
    return [{c: r[c] for c in SCHEMA.fieldNames()} for r in sorted(out.collect(), key=lambda r: (r["_file"], r["_place"]))]


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("range_bytes", [1, 7, 300, 1 << 20])
def test_equals_the_library(spark, tmp_path, indent, range_bytes):
    want = rows(6 if range_bytes < 300 else 60, range_bytes)
    path = tmp_path / "a.json"
    path.write_text(json.dumps(want, indent=indent, ensure_ascii=False))
    if range_bytes == 1:
        path.write_text(json.dumps(want[:2], ensure_ascii=False)[:60] + '"}]')  # cut off: what is whole is read
        want = None
    got = read(spark, path, max(range_bytes, 1) if range_bytes > 1 else 5)
    if want is None:
        assert len(got) <= 2
    else:
        assert got == want


def test_other_shapes(spark, tmp_path):
    for name, text, n in (("none.json", "[]", 0), ("one.json", '{"n": 1}', 1), ("lines.json", '{"n": 1}\n{"n": 2}', 2), ("mixed.json", '[1, "x{", [{"n": 5}], {"n": 3}]', 1), ("mark.json", '﻿[{"n": 1}]', 1), ("empty.json", "", 0)):
        (tmp_path / name).write_text(text)
        assert len(read(spark, tmp_path / name, 3)) == n, name
    assert read(spark, tmp_path / "absent.json", 3) == []


def test_several_tasks_and_positions(spark, tmp_path):
    """Ranges of one file are separate tasks, and ``pos`` is the order in the files."""
    for name in ("b", "a"):
        (tmp_path / f"{name}.json").write_text(json.dumps([{"id": f"{name}{i}", "title": "x{" * 50} for i in range(200)]))
    out = json_arrays.read_json_arrays(spark, str(tmp_path), SCHEMA, 5000)
    assert out.rdd.getNumPartitions() > 4
    loaded = tables.load_articles(spark, str(tmp_path)).orderBy("pos").select("pos", "id").collect()
    assert [tuple(r) for r in loaded] == [(i, x) for i, x in enumerate([f"a{i}" for i in range(200)] + [f"b{i}" for i in range(200)])]
