"""Edit distance of long texts against the plain matrix."""

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.functions import cer


def plain(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, above = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


SOME = st.text(st.sampled_from("ab\n é\U0001f600"), max_size=40)


@settings(max_examples=300, deadline=None)
@given(SOME, SOME, SOME, SOME)
def test_both_ways_agree_with_the_matrix(a, b, start, end):
    want = plain(start + a + end, start + b + end)
    assert cer.distance(start + a + end, start + b + end) == want == cer.distance(start + b + end, start + a + end)
    x, y = cer._without_shared_ends(a, b)
    if x:
        assert cer._distance_by_diagonals(x, y, float("inf")) == plain(x, y) == cer._bit_parallel_distance(x, y)


def changed(text: str, edits: int, seed: int) -> str:
    rng, out = random.Random(seed), list(text)
    for _ in range(edits):
        out[rng.randrange(len(out))] = rng.choice(["", "Z", "QQ"])
    return "".join(out)


@pytest.mark.parametrize("edits", [1, 30, 400, 2000])
def test_the_work_limit_does_not_change_the_result(edits):
    a = "".join(random.Random(5).choices("abcdefgh ", k=3000))
    b = changed(a, edits, edits)
    x, y = cer._without_shared_ends(a, b)
    assert cer.distance(a, b) == cer._bit_parallel_distance(x, y) == cer._distance_by_diagonals(x, y, float("inf"))
    assert cer._distance_by_diagonals(x, y, 0.0) is None


def test_two_million_characters_with_fifty_edits():
    a = "".join(random.Random(1).choices("abcdefghij klmnop", k=2_000_000))
    b = changed(a, 50, 2)
    start = time.time()
    got = cer.distance(a, b)
    assert 40 <= got <= 100 and time.time() - start < 5


def test_repetitive_texts():
    # Long equal runs on many diagonals at once.
    assert cer.distance("ab" * 5000, "ab" * 5000 + "c" + "ba" * 20) == 41
    assert cer.distance("a" * 20_000, "a" * 19_990) == 10


def test_column(spark):
    from pyspark.sql import functions as F

    long = "".join(random.Random(3).choices("abc de", k=5000))
    rows = [("", "", 0), ("abc", "abc", 0), ("abc", "", 3), ("kitten", "sitting", 3), (long, long, 0), (long, changed(long, 1, 9), None), (None, "a", None), ("a", None, None), (None, None, None)]
    got = spark.createDataFrame(rows, "a string, b string, want int").select("a", "b", "want", cer.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()
    for r in got:
        assert r["d"] == (r["want"] if r["want"] is not None or r["a"] is None or r["b"] is None else plain(*cer._without_shared_ends(r["a"], r["b"])))
