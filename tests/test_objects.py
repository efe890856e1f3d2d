"""Large JSON objects in byte ranges against the json module."""

import json
import random

from pyspark.sql import functions as F

from chunkwright.sources import objects


def test_entries_of_cut_files(spark, tmp_path):
    rng = random.Random(3)
    text = lambda: "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", ":", "é", "a", "\n", "\\\\"]) for _ in range(rng.randrange(0, 30)))
    want = []
    for f, indent in enumerate((None, 2, None)):
        made = {f"{f}-{i}{text()}": {"t": [text() for _ in range(rng.randrange(0, 4))], "n": {"d": [i, [text()]]}} for i in range(25)}
        (tmp_path / f"{f}.json").write_text(json.dumps(made, indent=indent, ensure_ascii=f == 2))
        want += [json.dumps({k: v}, sort_keys=True) for k, v in made.items()]
    (tmp_path / "none.json").write_text(" {\n} ")
    for size in (61, objects.RANGE):
        got = [json.dumps(json.loads(r["entry"]), sort_keys=True) for r in objects.entries(spark, str(tmp_path), size).collect()]
        assert sorted(got) == sorted(want)


def test_round_trip(spark, tmp_path):
    rows = [(f"k{i}", ['say "hi"', "\\", "é"][: i % 4]) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, v array<string>").repartition(3)
    for one in (False, True):
        objects.write_objects(df, f"{tmp_path}/{one}", "k", "v", one)
        got = objects.entries(spark, f"{tmp_path}/{one}", 101).select(F.explode(F.from_json("entry", "map<string,array<string>>")))
        assert sorted((r["key"], r["value"]) for r in got.collect()) == sorted(rows)
    assert len(list((tmp_path / "True").glob("part-*"))) == 1
