"""Queries that do the whole job where an older one beside them is restricted."""

from collections import Counter

from conftest import rows

import __spark_entry__ as entry


def run(spark, name, folder, **tables):
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
    return entry.queries()[name](spark, str(folder))


def test_substrings_of_all_lengths(spark, tmp_path):
    names = ["ab" * 70, "x" + "ab" * 66, "abcdefghijkl", "zabcdefghijkl", "abcd", "", None]
    n = Counter(t[a : a + k] for t in names if t for k in range(5, 129) for a in range(len(t) - k + 1))
    want = sorted((p, c, (c - 1) * len(p)) for p, c in n.items() if c >= 2)
    assert {len(p) for p, _, _ in want} == set(range(5, 129))
    got = run(spark, "z2_frequent_substrings_whole", tmp_path, part=spark.createDataFrame([(x,) for x in names], "p_name string"))
    assert rows(got) == want


def test_dictionary_beyond_1000_words(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(3000)) + " w7 w7"
    got = run(spark, "z5_dictionary", tmp_path, documents=spark.createDataFrame([(text,), ("w2999  w7",), (None,)], "text string"))
    n = Counter(text.split()) + Counter(["w2999", "w7"])
    assert rows(got) == sorted((w, c * len(w)) for w, c in n.items())


def test_as_of_half_of_the_times(spark, tmp_path):
    log = spark.range(40_000).selectExpr("id AS event_id", "id % 20000 AS user_id", "CAST(id AS DOUBLE) AS value", "'click' AS event_type")
    got = run(spark, "d2_get_as_of_half", tmp_path, events=log)
    assert got.count() == 20_000 and entry.queries()["d2_get_as_of"](spark, str(tmp_path)).count() == 5000
