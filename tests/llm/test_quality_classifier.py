"""The quality classifier: n-grams and dual coordinate descent against brute force, held-out accuracy, and odd rows."""

import zlib

import numpy as np
import pyarrow as pa

SF = "/root/testdata/sf0.01"


def sets_of(texts):
    from quire.llm.arrays import slices
    from quire.llm.quality_classifier import gram_sets

    return [s for _, data, off in slices(pa.record_batch({"text": pa.array(texts, pa.string())}), "text") for s in gram_sets(data, off)]


def test_grams_are_those_of_the_text_alone():
    texts = ["Abc abc abc\nx", None, "", "x", "ABC", "line one\nother\nline one", "é ü\n\n\n é", "na " * 5000]
    together = sets_of(texts)
    for t, own in zip(texts, together):
        assert np.array_equal(own, sets_of([t])[0])
    sizes = [len(s) for s in together]
    # Words abc, same, x; their pairs abc same, same same, same x; three-byte runs.
    raw = b"Abc abc abc\nx"
    assert sizes[0] == 3 + 3 + len({raw[i : i + 3] for i in range(len(raw) - 2)})
    assert sizes[1] == sizes[2] == 0 and sizes[3] == 1
    assert len(np.setdiff1d(together[5], sets_of(["line one\nother\nline two"])[0])) >= 1


def test_log_count_ratios():
    from quire.llm.quality_classifier import _PLACES, log_count_ratios

    sets, good = [np.array([1, 2]), np.array([2, 3]), np.array([3])], np.array([1, 1, 0])
    got = log_count_ratios(sets, good)
    share = lambda c, total: (1 + c) / (_PLACES + total)
    for place, a, b in ((1, 1, 0), (2, 2, 0), (3, 1, 1), (4, 0, 0)):
        assert np.isclose(got[place], np.log(share(a, 4) / share(b, 1)))


def test_dual_descent_reaches_the_least_hinge_loss():
    from quire.llm.quality_classifier import dual_descent

    rng = np.random.default_rng(2)
    dense = rng.standard_normal((60, 5))
    y = np.where(dense @ np.array([1, -2, 0.5, 0, 1]) + 0.7 * rng.standard_normal(60) > 0, 1.0, -1.0)
    w = dual_descent([(np.arange(5), v) for v in dense], y, np.full(60, 0.5), epochs=4000, least=1e-9)
    full = np.append(dense, np.ones((60, 1)), 1)
    loss = lambda u: 0.5 * u @ u + 0.5 * np.maximum(0, 1 - y * (full @ u)).sum()
    found = np.append(w[:5], w[-1])
    assert not w[5:-1].any()
    for _ in range(300):
        assert loss(found) <= loss(found + rng.standard_normal(6) * rng.choice([1e-3, 1e-2, 0.1])) + 1e-4


def test_held_out_accuracy_and_columns(spark):
    from quire.llm.quality_classifier import score, train

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = score(docs, train(docs, labels))
    rows = {r["doc_id"]: r for r in scored.collect()}
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"] and len(rows) == docs.count()
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(r["quality"], rows[r["doc_id"]]) for r in labels.collect() if rows[r["doc_id"]]["held_out"]]
    good, bad = [r["score"] for y, r in held if y == 1], [r["score"] for y, r in held if y == 0]
    assert len(bad) > 5 and np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([r["predicted"] == y for y, r in held]) > 0.93 and np.mean([g >= 0.3 for g in good]) > 0.98


def test_odd_rows(spark):
    from quire.llm.quality_classifier import score, train

    docs = spark.createDataFrame([(i, ["calm words stand here in order ", "!!! ### no"][i % 2] * (1 + i % 3), "p", 1) for i in range(60)] + [(None, "x", "p", 1), (70, None, "p", 1), (71, "", "p", 1), (72, "!!! " * 90_000, "p", 1), (72, "!!! ", "p", 1)], "doc_id long, text string, place string, good int")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)] + [(None, 1), (3, None), (5, 0), (5, 0), (72, 0)], "doc_id long, quality int")
    model = train(docs, labels)
    got = score(docs, model).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r["score"])
    assert all(min(by[i]) > 0.5 for i in range(0, 60, 2)) and all(max(by[i]) < 0.5 for i in range(1, 60, 2)) and by[70] == by[71] and len(by[72]) == 2
    small = train(docs, labels, max_grams=0)
    assert {r["score"] for r in score(docs, small).collect()} == {small.share}
    one = train(docs, labels.where("quality = 1"))
    assert {r["score"] for r in score(docs, one).collect()} == {1.0}
    assert {r["score"] for r in score(docs, train(docs, labels.where("false"))).collect()} == {0.5}
    assert score(docs.where("false"), train(docs.where("false"), labels)).count() == 0
