"""JSON arrays by byte ranges: ranges of every small size against Python's json, and what must raise."""

from __future__ import annotations

import json
import random

import pytest

from evalprobe.sources.json_array import read_json_array

SCHEMA = "a long, s string, n struct<x: array<long>, t: string>"


def made(n, seed):
    draw = random.Random(seed)
    parts = ["}", "{", "]", "[", '"', "\\", "\\\"", ",", "\n", "ü一🙂", "x", " ", '"}, {"a": 1}, {"', "\\\\"]
    text = lambda: "".join(draw.choice(parts) for _ in range(draw.randrange(0, 12)))
    return [{"a": i, "s": text(), "n": {"x": [draw.randrange(9) for _ in range(draw.randrange(4))], "t": text()}} for i in range(n)]


@pytest.fixture
def ranges(spark):
    def of(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield of
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("size", [64, 150, 700, 1 << 20])
def test_objects_of_all_ranges(spark, tmp_path, ranges, size):
    rows = made(25, size) + [{"a": 99, "s": "long } " * 60, "n": {"x": [], "t": ""}}]
    (tmp_path / "one.json").write_text(" \n" + json.dumps(rows, ensure_ascii=False, indent=2 if size > 100 else None) + "\n", encoding="utf-8")
    (tmp_path / "two.json").write_text(json.dumps([{"a": 1000, "s": "é", "n": None}]))
    (tmp_path / "three.json").write_text("[ ]\n")
    ranges(size)
    found = read_json_array(spark, str(tmp_path), SCHEMA)
    got = {r.a: (r.s, r.n and (r.n.x, r.n.t)) for r in found.collect()}
    assert got == {r["a"]: (r["s"], (r["n"]["x"], r["n"]["t"])) for r in rows} | {1000: ("é", None)}
    if size == 150:
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 15


@pytest.mark.parametrize("text", ['{"a": 1}', '{"a": [{"a": 1}]}', '[{"a": 1}, 5]', "[1, 2]", '[{"a": 1}, [{"a": 2}]]', '[{"a": 1}', '[{"a": 1}] x', '[{"a": 1}]]', '"[{}]"', '[{"a": "x}]', '[{"a": 1}}]', '[{"a": tru}]', '{"a": 1}\n{"a": 2}'])
@pytest.mark.parametrize("size", [4, 1 << 20])
def test_other_files_raise(spark, tmp_path, ranges, text, size):
    (tmp_path / "x.json").write_text(text)
    ranges(size)
    with pytest.raises(Exception, match="array|object|brace|MALFORMED"):
        read_json_array(spark, str(tmp_path / "x.json"), "a long").collect()


def test_every_range_size(spark, tmp_path, ranges):
    """Ranges that end within, before and behind the last brace, so that some hold no piece."""
    (tmp_path / "x.json").write_text('[{"a":1}, {"a":2,"s":"}"}]')
    for size in range(3, 28):
        ranges(size)
        assert sorted(r.a for r in read_json_array(spark, str(tmp_path / "x.json"), "a long").collect()) == [1, 2], size
