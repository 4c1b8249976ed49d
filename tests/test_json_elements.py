"""JSON arrays cut into splits of a few bytes against Spark's own reader."""

import json
import os
import random

import pytest

from broadsheet.sources.corpus import read_corpus
from broadsheet.sources.json_elements import read_json_elements, read_json_objects

SCHEMA = "id long, text string, tags array<string>, deep struct<a:long,b:struct<c:string>>"
ODD = ['}', '{', '"', '\\', '\\"', '}{', '"}', '\\\\"}', "é}😀", "], [", "\n", "a", " ", "{}", ""]


def element(pick, nth):
    return {"id": nth, "text": "".join(pick.choice(ODD) for _ in range(pick.randint(0, 12))),
            "tags": [pick.choice(ODD) for _ in range(pick.randint(0, 3))],
            "deep": {"a": nth, "b": {"c": pick.choice(ODD) * pick.randint(0, 40)}}}


@pytest.fixture
def small_splits(spark):
    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield use
    for name in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{name}")


@pytest.mark.parametrize("size,indent", [(64, None), (333, 1), (1 << 20, None)])
def test_equals_the_plain_reader(spark, folder, small_splits, size, indent):
    pick = random.Random(size)
    for name, many in (("a", 60), ("b", 0), ("c", 5)):
        rows = [element(pick, i) for i in range(many)]
        with open(os.path.join(folder, f"{name}.json"), "w", encoding="utf-8") as file:
            json.dump(rows, file, ensure_ascii=False, indent=indent)
            file.write("\n" if name == "a" else "")
    small_splits(size)
    plain = spark.read.schema(SCHEMA).option("multiLine", True).json(folder)
    rows = read_json_elements(spark, folder, plain.schema)
    want = sorted(map(str, plain.collect()))
    assert len(want) == 65 and sorted(map(str, rows.collect())) == want
    tasks = spark.read.option("lineSep", "}").text(folder).rdd.getNumPartitions()
    assert tasks > 20 or size == 1 << 20


def test_other_forms(spark, folder, small_splits):
    small_splits(16)
    texts = {"one": '{"id": 1, "text": "{\\"}"}', "lines": '{"id": 2}\n{"id": 3}\n', "none": "",
             "cut": '[{"id": 4}, {"id": 5, "text": "never en', "bare": "[1, 2, \"{\"]"}
    for name, text in texts.items():
        with open(os.path.join(folder, name), "w") as file:
            file.write(text)
    got = sorted(r.value for r in read_json_objects(spark, folder).collect())
    assert got[:3] == ['{"id": 1, "text": "{\\"}"}', '{"id": 2}', '{"id": 3}']
    assert got[3] == '{"id": 4}' and got[4].startswith('{"id": 5') and len(got) == 5


def test_corpus(spark, folder, small_splits):
    small_splits(40)
    with open(os.path.join(folder, "corpus.json"), "w") as file:
        json.dump([{"Title": f"t {i}", "deep": {"a": i}} for i in range(30)], file)
    rows = read_corpus(spark, folder, spark.createDataFrame(
        [], "Title string, deep struct<a:long>").schema)
    assert rows.columns == ["content", "deep.a"]
    assert sorted(r[1] for r in rows.collect()) == list(range(30))
