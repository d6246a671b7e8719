"""Classification, selection, summaries, skewed joins, review, images and streams."""

import json
import math
import re
import struct
import tempfile
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quire.dims import CLASS_HINTS, CLASS_PROTOTYPES, Taxonomy, auto_ocr_langs, class_schema, ocr_language_code, translation_languages
from quire.operators import chat as H
from quire.operators import classify as C
from quire.operators import ocr_runs as O
from quire.operators import quality as Q
from quire.operators import review as V
from quire.operators import selection as L
from quire.operators import skew
from quire.operators import summarize as Z
from quire.operators import translate as X


def brute_scores(text):
    grams = lambda t: (lambda w: w + [f"{a} {b}" for a, b in zip(w, w[1:])])(re.findall(r"\b\w\w+\b", t))
    low = re.sub(r"\s+", " ", text.strip()).lower()
    corpus = [Counter(grams(p)) for p in CLASS_PROTOTYPES.values()] + [Counter(grams(low))]
    df = Counter(t for c in corpus for t in c)
    vec = [{t: (1 + math.log(n)) * (math.log(14 / (1 + df[t])) + 1) for t, n in c.items()} for c in corpus]
    norm = [math.sqrt(sum(v * v for v in x.values())) for x in vec]
    out = []
    for i, hints in enumerate(CLASS_HINTS.values()):
        dot = sum(v * vec[-1].get(t, 0.0) for t, v in vec[i].items())
        cos = dot / (norm[i] * norm[-1]) if norm[-1] else 0.0
        out.append(0.68 * cos + 0.32 * min(1.0, sum(h in low for h in hints) / 4))
    return out


def test_classifier_equals_per_page_fit(spark):
    texts = ["Budget speech of the finance minister on the annual plan", "zzz qqq", "x", list(CLASS_PROTOTYPES.values())[5],
             "the assembly the assembly the assembly no. 7 gazette", "be it resolved that this house resolves"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: r.c for r in C.class_similarities(df, ["k"], "t").select("k", C.fuse(F.col("cosine"), F.col("keyword")).alias("c")).collect()}
    for k, t in enumerate(texts):
        assert np.allclose(got[k], brute_scores(t), atol=1e-12), t


def test_classifier_edges_and_ties(spark):
    df = spark.createDataFrame([(0, " \n"), (1, None), (2, "zzz qqq"), (3, "gazette gazette")], "k int, t string")
    got = {r.k: r for r in C.classify(df, ["k"], "t").collect()}
    assert got[0].doc_class == got[1].doc_class == "Unknown" and got[0].score_list is None
    assert got[2].doc_class == "Unknown" and set(got[2].score_list) == {0.0}
    assert got[3].doc_class == "Gazette" and abs(sum(got[3].score_list) - 100) < 0.12
    tie = spark.range(1).select(C.argmax_class(F.array(F.lit(1.0), F.lit(2.0), F.lit(2.0)), ["a", "b", "c"]).alias("c"))
    assert tie.first().c == "b"


def test_taxonomy_from_json(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"prototypes": {"Cats": "purr meow whisker", "Dogs": "bark woof leash"}, "hints": {"Dogs": ["good boy"]},
                                "schema": {"Dogs": [{"name": "Date", "type": "date"}]}}))
    t = Taxonomy.load(str(path))
    df = spark.createDataFrame([(1, "woof woof, the leash! good boy"), (2, "a purr")], "k int, t string")
    assert {r.k: r.doc_class for r in C.classify(df, ["k"], "t", t).collect()} == {1: "Dogs", 2: "Cats"}
    assert class_schema(spark, t).count() == 1 and class_schema(spark).count() == 37


def test_model_answers_win_over_classifier(spark):
    pages = spark.createDataFrame([(1, "gazette"), (2, "gazette")], "k int, t string")
    answers = spark.createDataFrame([(1, '{"top":"Election"}')], "k int, raw string")
    got = {r.k: (r.doc_class, len(r.scores)) for r in C.classify_with_model(pages, ["k"], "t", answers).collect()}
    assert got == {1: ("Election", 12), 2: ("Gazette", 12)}


def test_summary_scores_equal_svd(spark):
    text = "Cats chase mice at night. Mice fear cats and dogs. Dogs chase cats near home! Birds sing. The of and."
    rows = Z.sentence_scores(spark.createDataFrame([(1, text)], "k int, t string"), ["k"], "t").orderBy("pos").collect()
    words = [[w for w in re.findall(r"[a-z]+", r.sentence.lower()) if w not in Z.STOP_WORDS] for r in rows]
    vocab = sorted({w for s in words for w in s})
    m = np.array([[s.count(w) for s in words] for w in vocab], dtype=float)
    top = m.max(axis=0)
    m = np.where(top > 0, 0.4 + 0.6 * m / np.where(top > 0, top, 1), m)
    _, sigma, vt = np.linalg.svd(m, full_matrices=False)
    assert np.allclose([r.score for r in rows], np.sqrt(((sigma[:, None] * vt) ** 2).sum(axis=0)))


def test_summary_keeps_every_key_and_source_order(spark):
    df = spark.createDataFrame([(1, "Alpha beta gamma. Delta delta. Epsilon zeta eta theta."), (2, ""), (3, "HEADING ONLY")], "k int, t string")
    got = {r.k: r.summary for r in Z.summarize(df, ["k"], "t", n=2).collect()}
    assert got[2] == "" and got[3] == "" and got[1] == "Alpha beta gamma. Epsilon zeta eta theta." or got[1].count(".") == 2
    answers = spark.createDataFrame([(1, '{"summary": " given "}')], "k int, raw string")
    assert {r.k: r.summary for r in Z.summarize_with_model(df, ["k"], "t", answers).collect()} == {1: "given", 2: "", 3: ""}


def test_salted_join_keeps_all_rows_with_a_hot_key(spark):
    left = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("row"))
    right = spark.range(0, 5000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v")).unionByName(spark.createDataFrame([(7, 70)], "k bigint, v bigint"))
    got = skew.salted_left_join(left, right, ["k"], ["row"])
    want = left.join(right, "k", "left")
    assert got.count() == 5000 and got.exceptAll(want.select(*got.columns)).count() == 0
    assert [r.k for r in skew.hot_keys(left, ["k"], share=0.01).collect()] == [7]


def test_chat_context_cut_equals_whole_cut(spark):
    pages = [(d, p, f"page {p} " + "x" * (37 * p % 211)) for d, n in ((1, 3), (2, 40), (3, 1)) for p in range(n)]
    df = spark.createDataFrame(pages, "document_id bigint, page_index int, ocr_text string").selectExpr(
        "*", "cast(null as string) corrected_ocr_text", "cast(null as string) ocr_text_english", "cast(null as string) corrected_ocr_text_english"
    )
    for limit in (60, 300, 1200, 100000):
        for r in H.chat_context(df, max_chars=limit).collect():
            whole = "\n\n".join(f"--- PAGE {p + 1} ---\n{t.strip()}" for d, p, t in pages if d == r.document_id)
            half = limit // 2
            want = whole if len(whole) <= limit else whole[:half] + H.TRIM_NOTE + whole[-half:]
            assert r.context == want, (r.document_id, limit)


def test_chat_turns(spark):
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", "t") for i in range(25)] + [(2, 0, "user", " "), (3, 0, "user", "a"), (3, 1, "bot", "b")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn int, role string, text string")
    kept = H.last_turns(df, ["conv_id"])
    assert sorted({r.conv_id for r in kept.collect()}) == [1] and kept.count() == 20
    merged = H.merge_turns(spark.createDataFrame([(1, 0, "user", "a "), (1, 1, "user", "b"), (1, 2, "model", " "), (1, 3, "assistant", "c")], df.schema), ["conv_id"])
    assert [(r.message_no, r.role, r.parts) for r in merged.orderBy("message_no").collect()] == [(1, "user", ["a", "b"]), (2, "model", ["c"])]


def test_translation_identity_and_failures(spark):
    df = spark.createDataFrame([(1, "ab" * 5000), (2, " "), (3, "lost")], "k bigint, t string")
    chunks = X.chunk_rows(df, ["k"], "t", F.lit("xx"))
    assert {r.target for r in chunks.collect()} == {"hi"}
    table = chunks.where("k = 1").select("chunk_hash", "target", F.col("chunk").alias("translated"), F.lit(None).cast("string").alias("error")).distinct()
    got = {r.k: r.o for r in X.translate(df, ["k"], "t", F.lit("hi"), table, out="o").collect()}
    assert got == {1: "ab" * 5000, 2: "", 3: "[translation unavailable: no translation for chunk]"}
    assert X.missing_chunks(chunks, table).count() == 1


def test_selection_rules(spark):
    cands = [(1, "clean", 1, "clean", 50.0), (2, "pass", 1, "1", 50.0), (2, "pass", 2, "2", 70.0), (2, "pass", 3, "3", 70.0), (3, "pass", 1, "1", 40.0),
             (4, "escalation", 1, "a", 99.0), (4, "escalation", 2, "b", 99.5)]
    pages = [(1, 50.0, 50.0, False, None), (2, 50.0, 50.0, False, None), (3, 60.0, 50.0, True, None), (4, 10.0, 10.0, False, None)]
    got = L.select_candidate(
        spark.createDataFrame(cands, "page_key bigint, phase string, pos int, label string, qs double"),
        spark.createDataFrame(pages, "page_key bigint, original_qs double, start_qs double, washed boolean, final_qs double"), target_qs=98.0,
    )
    assert {r.page_key: r.verdict for r in got.collect()} == {1: "clean_doc_polish", 2: "iterative_pass_2", 3: "rolled_back_to_original", 4: "escalation:a"}


def test_review_state(spark):
    docs = spark.createDataFrame([(1, "enhancement", "qc_pending"), (2, "lingua", "qc_pending"), (3, "odd", "qc_pending")], "document_id bigint, current_stage string, status string")
    ids = docs.select("document_id")
    approved = {r.document_id: (r.current_stage, r.status) for r in V.approve(docs, ids).collect()}
    assert approved == {1: ("ocr", "pending"), 2: ("lingua", "completed"), 3: ("odd", "qc_pending")}
    assert {r.document_id: r.current_stage for r in V.reject(docs, ids).where("status = 'pending'").collect()} == {1: "enhancement", 2: "lingua", 3: "odd"}
    state = docs.where("document_id = 1")
    for _ in range(6):
        state = V.advance(state)
    assert state.first().status == "completed"


def test_ocr_choice_and_languages(spark):
    caps = "KNR TH OGX SRK MLA ABC DEF GHI JKL"
    runs = [(1, "tesseract", "fine text here", 90.0), (1, "easyocr", "other", 99.0), (2, "tesseract", caps, 99.0), (2, "easyocr", "good", 10.0),
            (3, "tesseract", caps, 99.0), (4, "easyocr", "only", 5.0), (5, "tesseract", " ", 0.0), (6, "x", "y", 1.0)]
    got = {r.page_id: (r.engine, r.text) for r in O.choose_ocr(spark.createDataFrame(runs, "page_id int, engine string, text string, avg_confidence double")).collect()}
    assert got == {1: ("tesseract", "fine text here"), 2: ("easyocr", "good"), 3: ("tesseract", caps), 4: ("easyocr", "only"), 5: ("tesseract", " "), 6: ("none", "")}
    r = spark.range(1).select(ocr_language_code(F.lit(" KAN ")).alias("a"), ocr_language_code(F.lit("zz")).alias("b"), auto_ocr_langs(F.array(F.lit("hin"), F.lit("eng"))).alias("c")).first()
    assert (r.a, r.b, r.c) == ("kan", "auto", "eng+hin") and translation_languages(spark).count() == 31


# --- images -------------------------------------------------------------------------------

def png(gray):
    h, w = gray.shape
    rgb = np.repeat(gray[:, :, None], 3, axis=2).astype(np.uint8)
    raw = b"".join(b"\0" + rgb[y].tobytes() for y in range(h))
    chunk = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images_end_to_end(spark):
    from quire.sources.files import batch_summary, ingest_batch, scan_files, scan_page_images

    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    clean = np.full((200, 180), 250, np.uint8)
    clean[50:62, 40:52] = 20
    rng = np.random.default_rng(1)
    pictures = {"flat": np.full((20, 20), 230, np.uint8), "clean": clean, "noise": rng.integers(0, 256, (30, 31)).astype(np.uint8),
                "checker": (np.indices((16, 16)).sum(0) % 2 * 255).astype(np.uint8)}
    for name, g in pictures.items():
        with open(f"{folder}/{name}.png", "wb") as f:
            f.write(png(g))
    for name, data in (("bad.png", b"nope"), ("empty.png", b""), ("a.bin", b"%PDF-1.4 x"), ("b.pdf", b"zz")):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)

    uploads = spark.createDataFrame([(f"file:{folder}/{n}",) for n in ("flat.png", "empty.png")], "path string")
    assert scan_files(spark, folder).count() == len(pictures) + 3
    files = scan_files(spark, folder, uploads=uploads)
    kinds = {r.path.rsplit("/", 1)[1]: r.kind for r in files.collect()}
    assert kinds == {**{f"{n}.png": "image" for n in pictures}, "bad.png": "unsupported", "empty.png": "empty", "a.bin": "pdf", "b.pdf": "pdf"}
    accepted, rejected = ingest_batch(files)
    assert accepted.count() == 6 and rejected.count() == 2 and not batch_summary(files).first().refused

    name = F.regexp_extract("path", r"([^/]+)\.png$", 1).alias("name")
    images = scan_page_images(spark, f"{folder}/*.png").select(name, "image")
    stats = {r.name: r for r in Q.page_flags(Q.page_profile(Q.raster_stats(images, ["name"]))).collect()}
    for n, g in pictures.items():
        r = stats[n]
        assert (r.width_px, r.height_px) == (g.shape[1], g.shape[0])
        assert abs(r.mean_gray - g.mean()) < 1e-9 and abs(r.std_gray - g.std()) < 1e-9
        p = np.pad(g.astype(int), 1, mode="reflect")
        lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]
        assert abs(r.laplacian_variance - lap.var()) < 1e-6
    assert stats["flat"].laplacian_variance == 0 and stats["flat"].is_washed and stats["clean"].is_clean and not stats["noise"].is_clean
    assert stats["bad"].mean_gray is None and stats["bad"].qs_metrics is None

    after = images.select("name", F.when(F.col("name") == "clean", F.col("image")).otherwise(F.col("image")).alias("image"))
    rep = {r.name: r for r in Q.enhancement_report(images, after, ["name"]).collect()}
    assert rep["noise"].pct_pixels_changed == 0 and abs(sum(rep["noise"].hist_before) - 1) < 1e-4 and rep["bad"].mean_shift is None


# --- streams ---------------------------------------------------------------------------------

EVENTS = [
    {"run_id": "a", "seq": 1, "document_id": 1, "phase": "start", "target_qs": 95},
    {"run_id": "a", "seq": 2, "document_id": 1, "phase": "page_complete", "page_index": 1, "page_index_zero": 0, "page_total": 2, "post_qs": 80.0, "enhanced_path": "/e0"},
    {"run_id": "a", "seq": 3, "document_id": 1, "phase": "page_complete", "page_index": 2, "page_total": 2, "post_qs": 81.0, "enhanced_path": ""},
    {"run_id": "a", "seq": 4, "document_id": 1, "phase": "document"},
    {"run_id": "b", "seq": 1, "document_id": 2, "phase": "error", "message": "boom"},
    {"run_id": "c", "seq": 1, "document_id": 3, "phase": "write", "page_index": 1, "page_total": 3},
]


def drain(df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_progress_stream_equals_batch(spark):
    from quire.sources.progress import read_progress_log, stream_progress_log
    from quire.streaming import progress as R

    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for i in range(2):
        with open(f"{folder}/{i}.ndjson", "w") as f:
            f.write("\n".join(json.dumps(e) for e in EVENTS[i::2]) + "\n\n{broken\n")
    batch = read_progress_log(spark, folder)
    assert batch.count() == len(EVENTS)
    for i, fold in enumerate((R.page_results, R.run_outcomes)):
        live = drain(fold(stream_progress_log(spark, folder, max_files=1)), "complete", f"fold{i}")
        assert sorted(map(str, live.collect())) == sorted(map(str, fold(batch).collect()))
    pct = drain(R.with_progress(stream_progress_log(spark, folder)).select("run_id", "seq", "pct"), "append", "pct")
    assert {(r.run_id, r.seq): r.pct for r in pct.collect()}[("c", 1)] == 97
    outcomes = {r.run_id: (r.outcome, r.message) for r in R.closed_outcomes(R.run_outcomes(batch)).collect()}
    assert outcomes == {"a": ("success", None), "b": ("failed", "boom"), "c": ("failed", "Stream ended without result")}
    pages = spark.createDataFrame([(1, 0, "/old", 1.0, 2.0), (1, 1, "/old1", 1.0, 2.0), (3, 0, None, None, None), (3, 1, None, None, None)], "document_id bigint, page_index int, enhanced_path string, post_qs double, initial_qs double")
    patched = {(r.document_id, r.page_index): (r.enhanced_path, r.post_qs, r.initial_qs) for r in R.patch_pages(pages, R.page_results(batch)).collect()}
    assert patched[(1, 0)] == ("/e0", 80.0, 2.0) and patched[(1, 1)] == ("/old1", 81.0, 2.0)
    board = {(r.document_id, r.page_index): r.state for r in R.page_board(batch, pages).collect()}
    assert board == {(1, 0): "done", (1, 1): "done", (3, 0): "done", (3, 1): "pending"}


def test_stall_monitor_equals_batch(spark):
    from quire.streaming.progress import stall_monitor

    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    rng = np.random.default_rng(5)
    rows = [(int(k), int(p), float(round(x, 3))) for k in range(6) for p, x in enumerate(rng.uniform(0, 90, 12), 1)]
    schema = "page_key bigint, pass int, qs double"
    df = spark.createDataFrame(rows, schema)
    df.where("pass <= 5").coalesce(1).write.json(f"{folder}/a")
    df.where("pass > 5").coalesce(1).write.json(f"{folder}/b")
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{folder}/*")
    live = drain(stall_monitor(events, target_qs=95.0), "append", "stall").where("not after_stop")
    want = L.executed_passes(df, target_qs=95.0).select("page_key", "pass", "best_qs", "stall_count")
    assert sorted(map(tuple, live.select("page_key", "pass", "best_qs", "stall_count").collect())) == sorted(map(tuple, want.collect()))


def test_upsert_log(spark):
    from quire.streaming.progress import live_state, read_upserted, upsert_sink

    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    schema = "document_id bigint, current_stage string, status string"
    write = upsert_sink(f"{folder}/docs")
    base = spark.createDataFrame([(0, "lingua", "completed"), (1, "enhancement", "pending")], schema)
    for batch_id in (4, 4, 2):  # a repeated batch changes nothing, and a skipped or late one does no harm
        rows = {4: [(2, "doc_class", None), (3, "ocr", "pending")], 2: [(1, "ocr", "pending"), (2, "ocr", "running")]}[batch_id]
        write(spark.createDataFrame(rows, schema), batch_id)
    got = {r.document_id: (r.current_stage, r.status) for r in read_upserted(spark, f"{folder}/docs", ["document_id"], base).collect()}
    assert got == {0: ("lingua", "completed"), 1: ("ocr", "pending"), 2: ("doc_class", "running"), 3: ("ocr", "pending")}
    # A query that starts anew with a new checkpoint counts its batches from 0.
    upsert_sink(f"{folder}/docs", epoch=1)(spark.createDataFrame([(3, "lingua", "completed")], schema), 0)
    got = {r.document_id: r.current_stage for r in read_upserted(spark, f"{folder}/docs", ["document_id"]).collect()}
    assert got == {1: "ocr", 2: "doc_class", 3: "lingua"}
    runs = spark.createDataFrame([(1, 1, "ocr", "a", 5), (2, 1, "lingua", "b", 6)], "id int, document_id bigint, stage string, status string, started_at int")
    assert live_state(runs).first().current_stage == "lingua"


def test_last_patch_wins(spark):
    pages = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "document_id long, page_index int, t string")
    patches = spark.createDataFrame([(1, 0, "second", 2), (1, 0, "first", 1), (1, 0, "third", 3)], "document_id long, page_index int, t string, seq int")
    from quire.operators.review import apply_page_patches

    assert sorted(tuple(r) for r in apply_page_patches(pages, patches, "t").collect()) == [(1, 0, "third"), (1, 1, "b")]
    unordered = apply_page_patches(pages, patches.drop("seq"), "t").collect()
    assert sorted(tuple(r) for r in unordered) == [(1, 0, "third"), (1, 1, "b")]


def test_upsert_takes_the_last_change(spark):
    from quire.sources.tables import upsert

    base = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    changes = spark.createDataFrame([(1, "b", 2), (1, "z", 1), (3, "n", 1)], "id long, v string, seq int")
    assert sorted(tuple(r) for r in upsert(base, changes, ["id"]).collect()) == [(1, "b"), (2, "y"), (3, "n")]


def test_clean_polish_ends_a_page(spark):
    from quire.operators.selection import select_candidate

    candidates = spark.createDataFrame([(1, "clean", 1, "clean", 60.0), (1, "pass", 1, "1", 80.0), (2, "pass", 1, "1", 80.0)], "page_key long, phase string, pos int, label string, qs double")
    pages = spark.createDataFrame([(1, 50.0, 55.0, False, None), (2, 50.0, 55.0, False, None)], "page_key long, original_qs double, start_qs double, washed boolean, final_qs double")
    got = {r.page_key: (r.best_qs, r.verdict) for r in select_candidate(candidates, pages).collect()}
    assert got == {1: (60.0, "clean_doc_polish"), 2: (80.0, "iterative_pass_1")}


def test_whole_text_is_read(spark):
    from quire.dims import CLASS_SCHEMA
    from quire.operators.classify import classify
    from quire.operators.metadata import class_fields

    half = "plain words. " * 10_000
    text = half + "budget speech finance minister 13/02/2020 estimates revenue. " + half
    df = spark.createDataFrame([(1, text)], "document_id long, text string")
    assert len(text) > 250_000 and classify(df, ["document_id"], "text").first().doc_class == "Budget Speech"
    dated = next(c for c, fields in CLASS_SCHEMA.items() if any(f[0] == "Date" for f in fields))
    row = df.select(class_fields(F.col("text"), F.lit(dated)).alias("f")).first()
    assert row.f["Date"] == "2020-02-13"


def test_chain_reports_documents_without_pages(spark):
    from quire.plans.chain import run_chain

    docs = spark.createDataFrame([(1, "a.pdf", "hi", "ocr", "pending"), (2, "b.pdf", "hi", "ocr", "pending")], "document_id long, filename string, target_language string, current_stage string, status string")
    pages = spark.createDataFrame([(1, 0, "budget speech", "", None, None)], "document_id long, page_index int, ocr_text string, corrected_ocr_text string, ocr_text_english string, corrected_ocr_text_english string")
    known = spark.createDataFrame([], "chunk_hash string, target string, translated string, error string")
    result = run_chain(docs, pages, known)
    assert [r.document_id for r in result.errors.collect()] == [2]
    assert [(r.document_id, r.raw_ocr) for r in result.documents.collect()] == [(1, "=== PAGE 1 ===\nbudget speech")]


def test_volumes_do_not_change_results(spark, monkeypatch):
    from functools import partial

    from quire.plans import all_queries

    all_queries()  # in the order in which the parts of their SQL build on one another
    from quire.plans import queries_state as S

    folder = "/root/testdata/sf0.001"
    rows = lambda: [sorted(map(tuple, f(spark, folder).collect())) for f in (S.s6, S.w6, S.a8)]
    whole = rows()
    monkeypatch.setattr(S.G, "get_documents", partial(S.G.get_documents, volume_pages=2))
    monkeypatch.setattr(S.O, "ocr_payload", partial(S.O.ocr_payload, volume_pages=2))
    assert rows() == whole


def test_failed_run_goes_back_to_pending(spark):
    from quire.streaming.progress import settle_failed

    events = spark.createDataFrame([("a", 1, 1), ("b", 1, 2), ("c", 5, 2)], "run_id string, seq int, document_id long")
    outcomes = spark.createDataFrame([("a", "failed"), ("b", "failed"), ("c", "success")], "run_id string, outcome string")
    docs = spark.createDataFrame([(1, "processing"), (2, "processing"), (3, "processing")], "document_id long, status string")
    assert sorted(tuple(r) for r in settle_failed(docs, events, outcomes).collect()) == [(1, "pending"), (2, "processing"), (3, "processing")]


def test_stalled_passes_do_not_compete(spark):
    from quire.operators.selection import select_candidate

    rows = [
        # Two small gains end the passes, so the third is never run; the polish is.
        *[("stalled", "pass", i, str(i), q) for i, q in ((1, 50.0), (2, 50.1), (3, 50.05), (4, 90.0))],
        ("stalled", "polish", 1, "2.3", 60.0),
        # A large gain in between starts the count anew.
        *[("gains", "pass", i, str(i), q) for i, q in ((1, 50.0), (2, 50.05), (3, 70.0), (4, 70.05), (5, 80.0))],
        # The target ends everything; a null score and an unknown phase never win.
        *[("target", "pass", i, str(i), q) for i, q in ((1, None), (2, 99.0), (3, 99.9))],
        ("target", "escalation", 1, "x", 99.95),
        ("target", "other", 1, "y", 100.0),
    ]
    candidates = spark.createDataFrame(rows, "page_key string, phase string, pos int, label string, qs double")
    pages = spark.createDataFrame([(k, 1.0, 10.0, False, None) for k in ("stalled", "gains", "target", "alone")], "page_key string, original_qs double, start_qs double, washed boolean, final_qs double")
    got = {r.page_key: (r.best_qs, r.verdict) for r in select_candidate(candidates, pages, target_qs=98.0).collect()}
    assert got == {"stalled": (60.0, "polish_clip_2.3"), "gains": (80.0, "iterative_pass_5"), "target": (99.0, "iterative_pass_2"), "alone": (10.0, "no_change")}
