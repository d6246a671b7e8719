"""Queries on page scores, enhancement candidates and page rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import scores as S
from quire.operators import quality as Q
from quire.operators import selection as L
from quire.operators import status as T
from quire.plans.registry import cte, mean_sql, query, rnd, sql_view, table, view

# --- scores -----------------------------------------------------------------------

def _unit(x: str, low: float, high: float) -> str:
    return f"greatest(0.0, least(1.0, ({x} - {low}) / ({high} - {low})))"


def _tri(x: str, peak: float, width: float) -> str:
    return f"greatest(0.0, 1.0 - abs({x} - {peak}) / {width})"


_STRICT_B = f"greatest({_tri('mean_gray', 127, 127.0)}, {_tri('mean_gray', 200, 72.0)})"
_LENIENT_B = f"""CASE WHEN mean_gray BETWEEN 195 AND 248 THEN 1.0 WHEN mean_gray < 195
  THEN greatest({_tri('mean_gray', 127, 127.0)}, greatest(0.0, 1.0 - (195.0 - mean_gray) / 90.0)) ELSE greatest(0.0, 1.0 - (mean_gray - 248.0) / 7.0) END"""


def _qs_sql(sharp, contrast, noise, brightness) -> str:
    parts = {
        "sharpness": _unit("laplacian_variance", *sharp), "brightness": brightness, "contrast": _unit("std_gray", *contrast),
        "noise": f"(1.0 - {_unit('noise_std', *noise)})",
    }
    total = " + ".join(f"{v} * {parts[k]}" for k, v in S.WEIGHTS.items())
    return f"{rnd(f'100 * ({total})', 2)} AS qs, " + ", ".join(f"{rnd(f'100 * ({e})', 2)} AS {n}" for n, e in parts.items())


sql_view("r_strict", f"SELECT document_id, page_index, {_qs_sql((50.0, 1300.0), (20.0, 82.0), (2.0, 20.0), _STRICT_B)} FROM v_raster_stats", "v_raster_stats")
sql_view("r_lenient", f"SELECT document_id, page_index, {_qs_sql((80.0, 600.0), (18.0, 42.0), (18.0, 40.0), _LENIENT_B)} FROM v_raster_stats", "v_raster_stats")
_ARGS = ("laplacian_variance", "mean_gray", "std_gray", "noise_std")


def _scored(spark, sf, fn):
    stats = view(spark, sf, "v_raster_stats")
    return stats.select("document_id", "page_index", fn(*[F.col(c) for c in _ARGS]).alias("qs_metrics"))


@query("q_q2_qs_strict", cte("r_strict") + " SELECT * FROM r_strict")
def q2(spark, sf):
    return _scored(spark, sf, S.qs_strict).select("document_id", "page_index", "qs_metrics.*")


@query("q_q3_qs_lenient", cte("r_lenient") + " SELECT * FROM r_lenient")
def q3(spark, sf):
    return _scored(spark, sf, S.qs_lenient).select("document_id", "page_index", "qs_metrics.*")


_MEANS = ", ".join(f"{mean_sql(n, 6)} AS {n}" for n in ("qs", "sharpness", "brightness", "contrast", "noise"))


@query("q_a2_mean_metrics", cte("r_strict") + f" SELECT document_id, {_MEANS} FROM r_strict GROUP BY document_id")
def a2(spark, sf):
    return Q.mean_metrics(_scored(spark, sf, S.qs_strict))


@query(
    "q_a2_gauge_scores",
    cte("v_scored_docs", "v_scored_pages") + f""" SELECT d.document_id, {rnd('coalesce(p.i, d.initial_qs)', 4)} AS gauge_initial,
      d.enhanced_path IS NOT NULL AND d.post_qs IS NOT NULL AND coalesce(p.a, true) AS ready,
      CASE WHEN d.enhanced_path IS NOT NULL AND d.post_qs IS NOT NULL AND coalesce(p.a, true) THEN {rnd('CASE WHEN p.a IS NULL THEN d.post_qs ELSE p.q END', 4)} END AS gauge_post
      FROM v_scored_docs d LEFT JOIN (SELECT document_id, avg(initial_qs) AS i, avg(post_qs) AS q, bool_and(post_qs IS NOT NULL AND enhanced_path IS NOT NULL) AS a FROM v_scored_pages GROUP BY document_id) p USING (document_id)""",
)
def a2_gauge(spark, sf):
    g = Q.gauge_scores(view(spark, sf, "v_scored_docs"), view(spark, sf, "v_scored_pages"))
    return g.select("document_id", F.round("gauge_initial", 4).alias("gauge_initial"), F.round("gauge_post", 4).alias("gauge_post"), "ready")


@query(
    "q_a1_qs_rollup",
    cte("v_scored_docs", "v_scored_pages") + f""" SELECT d.document_id, coalesce(p.i, {rnd('d.initial_qs', 2)}) AS initial_qs, {rnd('f.post_qs', 2)} AS post_qs,
      f.enhanced_path, p.m AS enhancement_passes, l.report AS last_report
      FROM v_scored_docs d JOIN (SELECT document_id, {mean_sql('initial_qs')} AS i, max(passes) AS m, min(page_index) AS lo, max(page_index) AS hi FROM v_scored_pages GROUP BY document_id) p USING (document_id)
      JOIN v_scored_pages f ON f.document_id = p.document_id AND f.page_index = p.lo JOIN v_scored_pages l ON l.document_id = p.document_id AND l.page_index = p.hi""",
)
def a1(spark, sf):
    return Q.qs_rollup(view(spark, sf, "v_scored_docs"), view(spark, sf, "v_scored_pages"))


@query(
    "q_p8_auto_enhance",
    cte("v_scored_docs", "v_scored_pages") + f""", q AS (SELECT d.document_id, coalesce(p.i, {rnd('d.initial_qs', 2)}, 0.0) AS qs FROM v_scored_docs d
      LEFT JOIN (SELECT document_id, {mean_sql('initial_qs')} AS i FROM v_scored_pages GROUP BY document_id) p USING (document_id))
      SELECT document_id, qs AS initial_qs, CAST(40.0 AS DOUBLE) AS threshold, qs < 40 AS should_enhance,
      'Initial QS ' || CAST(qs AS VARCHAR) || CASE WHEN qs < 40 THEN ' is below threshold 40.0 — enhancement recommended.' ELSE ' already meets threshold 40.0 — enhancement skipped.' END AS reason FROM q""",
)
def p8(spark, sf):
    return Q.auto_enhance_decision(view(spark, sf, "v_scored_docs"), view(spark, sf, "v_scored_pages"), threshold=40.0)


@query(
    "q_s4_register_documents",
    cte("v_scored_pages") + f""" SELECT document_id, min_by(image_path, page_index) AS original_path, {mean_sql('initial_qs')} AS initial_qs,
      'enhancement' AS current_stage, 'pending' AS status FROM v_scored_pages GROUP BY document_id""",
)
def s4(spark, sf):
    return Q.register_documents(view(spark, sf, "v_scored_pages"))


@query(
    "q_p13_enhancement_ready",
    cte("v_scored_docs", "v_scored_pages") + """ SELECT d.document_id, d.enhanced_path IS NOT NULL AND d.post_qs IS NOT NULL AND coalesce(p.a, true) AS ready FROM v_scored_docs d
      LEFT JOIN (SELECT document_id, bool_and(post_qs IS NOT NULL AND enhanced_path IS NOT NULL) AS a FROM v_scored_pages GROUP BY document_id) p USING (document_id)""",
)
def p13(spark, sf):
    return T.enhancement_ready(view(spark, sf, "v_scored_docs"), view(spark, sf, "v_scored_pages"))


@query(
    "q_p15_tune_notice",
    f"""SELECT l_orderkey, l_linenumber, CASE WHEN p + 0.2 < b THEN 'before' WHEN p + 0.2 < u THEN 'Post QS ' || CAST(CAST(p AS DECIMAL(38,2)) AS VARCHAR) || ' is below the original upload (' ||
      CAST(CAST(u AS DECIMAL(38,2)) AS VARCHAR) || '); the tuned image is still saved.' END AS notice
      FROM (SELECT l_orderkey, l_linenumber, {rnd('l_quantity * 1.31', 2)} AS p, {rnd('l_discount * 400', 2)} AS b, {rnd('l_tax * 900', 2)} AS u FROM lineitem)""",
)
def p15(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(F.col("l_quantity") * 1.31, 2).alias("p"), F.round(F.col("l_discount") * 400, 2).alias("b"), F.round(F.col("l_tax") * 900, 2).alias("u")
    )
    notice = Q.tune_notice(F.col("p"), F.col("b"), F.col("u"))
    return rows.select("l_orderkey", "l_linenumber", F.when(notice.startswith("Applied"), "before").otherwise(notice).alias("notice"))


@query(
    "q_p21_page_qs_display",
    cte("v_scored_docs", "v_scored_pages") + f""", x AS (SELECT p.document_id, p.page_index, coalesce(p.initial_qs, CASE WHEN p.passes > 8 THEN 33.0 END, CASE WHEN c.n = 1 OR p.page_index = c.f THEN d.initial_qs END) AS i,
      coalesce(p.post_qs, CASE WHEN c.n = 1 OR p.page_index = c.f THEN d.post_qs END) AS q FROM v_scored_pages p JOIN v_scored_docs d USING (document_id)
      JOIN (SELECT document_id, count(*) AS n, min(page_index) AS f FROM v_scored_pages GROUP BY document_id) c USING (document_id))
      SELECT document_id, page_index, {rnd('i', 4)} AS initial, {rnd('q', 4)} AS post, {rnd('q - i', 4)} AS delta, CASE WHEN q >= 90 THEN 'high' WHEN q >= 60 THEN 'mid' ELSE 'low' END AS band FROM x""",
)
def p21(spark, sf):
    pages = view(spark, sf, "v_scored_pages").withColumn("metric_qs", F.when(F.col("passes") > 8, 33.0)).withColumn("post_metric_qs", F.lit(None).cast("double"))
    shown = T.page_qs_display(pages, view(spark, sf, "v_scored_docs"))
    return shown.select("document_id", "page_index", *[F.round(c, 4).alias(c) for c in ("initial", "post", "delta")], "band")


# --- candidate selection -----------------------------------------------------------

sql_view(
    "w_best",
    """SELECT page_key, pass, qs, max(qs) OVER (PARTITION BY page_key ORDER BY pass) AS best_qs,
      greatest(0.0, coalesce(max(qs) OVER (PARTITION BY page_key ORDER BY pass ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS prev_best
      FROM v_passes WHERE pass <= 16""",
    "v_passes",
)


@query("q_w1_running_best", cte("w_best") + f" SELECT page_key, pass, {rnd('best_qs', 6)} AS best_qs FROM w_best")
def w1(spark, sf):
    return L.running_best(view(spark, sf, "v_passes")).select("page_key", "pass", F.round("best_qs", 6).alias("best_qs"))


@query("q_w1_best_pass", cte("w_best") + " SELECT page_key, min(pass) AS pass FROM w_best b WHERE qs = (SELECT max(qs) FROM w_best m WHERE m.page_key = b.page_key) GROUP BY page_key")
def w1_pass(spark, sf):
    return L.best_pass(view(spark, sf, "v_passes")).select("page_key", "pass")


@query("q_w2_pass_gain", cte("w_best") + f" SELECT page_key, pass, {rnd('best_qs - prev_best', 6)} AS gain FROM w_best")
def w2(spark, sf):
    return L.running_best(view(spark, sf, "v_passes")).select("page_key", "pass", F.round("gain", 6).alias("gain"))


# The SQL side walks the loop pass by pass.
sql_view(
    "w_walk",
    """SELECT * FROM (WITH RECURSIVE walk(page_key, pass, best, stall, go) AS (
        SELECT page_key, 0, CAST(0.0 AS DOUBLE), 0, true FROM (SELECT DISTINCT page_key FROM v_passes)
        UNION ALL
        SELECT w.page_key, p.pass, greatest(w.best, p.qs), CASE WHEN greatest(w.best, p.qs) - w.best < 0.12 THEN w.stall + 1 ELSE 0 END,
          NOT (CASE WHEN greatest(w.best, p.qs) - w.best < 0.12 THEN w.stall + 1 ELSE 0 END >= 2 OR greatest(w.best, p.qs) >= 90.0)
        FROM walk w JOIN v_passes p ON p.page_key = w.page_key AND p.pass = w.pass + 1 WHERE w.go AND p.pass <= 16)
      SELECT * FROM walk WHERE pass > 0)""",
    "v_passes",
)


@query("q_w3_executed_passes", cte("w_walk") + f" SELECT page_key, CAST(pass AS INT) AS pass, {rnd('best', 6)} AS best_qs, CAST(stall AS INT) AS stall_count, best >= 90.0 AS met_target FROM w_walk")
def w3(spark, sf):
    ran = L.executed_passes(view(spark, sf, "v_passes"), target_qs=90.0)
    return ran.select("page_key", "pass", F.round("best_qs", 6).alias("best_qs"), "stall_count", "met_target")


_PHASES_SQL = """SELECT page_key, 'pass' AS phase, pass AS pos, CAST(pass AS VARCHAR) AS label, qs FROM v_passes WHERE pass <= 16
  UNION ALL SELECT page_key, 'clean', 1, 'clean', qs FROM v_passes WHERE pass = 1 AND page_key % 5 = 0
  UNION ALL SELECT page_key, 'polish', pass - 16, CASE pass WHEN 17 THEN '2.3' ELSE '2.6' END, qs * 1.01 FROM v_passes WHERE pass IN (17, 18)
  UNION ALL SELECT page_key, 'escalation', pass - 18, 'recipe_' || CAST(pass - 18 AS VARCHAR), qs * 1.02 FROM v_passes WHERE pass > 18"""
sql_view("w_cand", _PHASES_SQL, "v_passes")


def _candidates(spark, sf):
    p = view(spark, sf, "v_passes")

    def phase(rows, name, pos, label, factor):
        return rows.select("page_key", F.lit(name).alias("phase"), pos.cast("int").alias("pos"), label.alias("label"), (F.col("qs") * factor).alias("qs"))

    k = F.col("pass")
    return L.candidate_union(
        phase(p.where(k <= 16), "pass", k, k.cast("string"), 1.0),
        phase(p.where((k == 1) & (F.col("page_key") % 5 == 0)), "clean", F.lit(1), F.lit("clean"), 1.0),
        phase(p.where(k.isin(17, 18)), "polish", k - 16, F.when(k == 17, "2.3").otherwise("2.6"), 1.01),
        phase(p.where(k > 18), "escalation", k - 18, F.concat(F.lit("recipe_"), (k - 18).cast("string")), 1.02),
    )


@query("q_u2_candidates", cte("w_cand") + f" SELECT page_key, phase, CAST(pos AS INT) AS pos, label, {rnd('qs', 6)} AS qs FROM w_cand")
def u2(spark, sf):
    return _candidates(spark, sf).withColumn("qs", F.round("qs", 6))


# The SQL side walks the candidates in order, one by one.
_TARGET = 97.0
sql_view(
    "w_order",
    """SELECT *, row_number() OVER (PARTITION BY page_key ORDER BY CASE phase WHEN 'clean' THEN 0 WHEN 'pass' THEN 1 WHEN 'polish' THEN 2 ELSE 3 END, pos) AS seq FROM w_cand c
    WHERE phase = 'clean' OR NOT EXISTS (SELECT 1 FROM w_cand o WHERE o.page_key = c.page_key AND o.phase = 'clean')""",
    "w_cand",
)
sql_view("w_page", "SELECT page_key, CAST(page_key % 97 AS DOUBLE) AS start_qs, CAST(page_key % 103 AS DOUBLE) AS original_qs, page_key % 2 = 0 AS washed FROM (SELECT DISTINCT page_key FROM v_passes)", "v_passes")
sql_view(
    "w_choice",
    f"""SELECT * FROM (WITH RECURSIVE c(page_key, seq, best, at_polish, stall, verdict) AS (
        SELECT page_key, CAST(0 AS BIGINT), start_qs, start_qs, 0, CASE WHEN washed THEN 'washed_recovery' ELSE 'no_change' END FROM w_page
        UNION ALL
        SELECT c.page_key, o.seq, CASE WHEN {{take}} THEN o.qs ELSE c.best END,
          CASE WHEN o.phase IN ('clean', 'pass') THEN CASE WHEN {{take}} THEN o.qs ELSE c.best END ELSE c.at_polish END,
          CASE WHEN o.phase <> 'pass' OR c.stall >= 2 THEN c.stall WHEN greatest(c.best, o.qs) - c.best < 0.12 THEN c.stall + 1 ELSE 0 END,
          CASE WHEN {{take}} THEN CASE o.phase WHEN 'clean' THEN 'clean_doc_polish' WHEN 'pass' THEN 'iterative_pass_' || o.label WHEN 'polish' THEN 'polish_clip_' || o.label ELSE 'escalation:' || o.label END ELSE c.verdict END
        FROM c JOIN w_order o ON o.page_key = c.page_key AND o.seq = c.seq + 1)
      SELECT * FROM c) QUALIFY row_number() OVER (PARTITION BY page_key ORDER BY seq DESC) = 1""".replace(
        "{take}",
        f"(CASE o.phase WHEN 'clean' THEN o.qs >= c.best WHEN 'polish' THEN c.at_polish < {_TARGET} AND o.qs > c.best WHEN 'pass' THEN c.stall < 2 AND c.best < {_TARGET} AND o.qs > c.best ELSE c.best < {_TARGET} AND o.qs > c.best END)",
    ),
    "w_order", "w_page",
)


@query(
    "q_w4_selected_candidate",
    cte("w_choice", "w_page") + f""" SELECT c.page_key, {rnd('c.best', 6)} AS best_qs, {rnd('greatest(c.best, p.original_qs)', 6)} AS final_qs,
      CASE WHEN c.best < p.original_qs THEN 'rolled_back_to_original' ELSE c.verdict END AS verdict FROM w_choice c JOIN w_page p USING (page_key)""",
)
def w4(spark, sf):
    k = F.col("page_key")
    pages = view(spark, sf, "v_passes").select("page_key").distinct().select(
        "page_key", (k % 97).cast("double").alias("start_qs"), (k % 103).cast("double").alias("original_qs"),
        (k % 2 == 0).alias("washed"), F.lit(None).cast("double").alias("final_qs"),
    )
    chosen = L.select_candidate(_candidates(spark, sf), pages, target_qs=_TARGET)
    return chosen.select("page_key", F.round("best_qs", 6).alias("best_qs"), F.round("final_qs", 6).alias("final_qs"), "verdict")


# --- rasters ------------------------------------------------------------------------
# A document's text bytes, 64 to a row, serve as its gray raster: real image structs of
# every size, from the given table.

_W = 64


def _rasters(spark, sf, text=None):
    d = table(spark, sf, "documents")
    data = F.encode(text if text is not None else F.col("text"), "UTF-8")
    # The last row is filled up with white; a null or empty text has no content that can be read.
    rows = F.coalesce(F.ceil(F.length(data) / _W), F.lit(0)).cast("int")
    image = F.struct(
        F.lit("").alias("origin"), F.when(rows > 0, rows).otherwise(-1).alias("height"), F.when(rows > 0, _W).otherwise(-1).alias("width"),
        F.lit(1).alias("nChannels"), F.lit(0).alias("mode"), F.when(rows > 0, F.concat(data, F.substring(F.unhex(F.lit("FF" * _W)), F.lit(1), rows * _W - F.length(data)))).alias("data"),
    )
    return d.select("doc_id", image.alias("image"))


def _pixels_sql(text: str) -> str:
    """Pixel table by the hexadecimal digits of the text bytes."""
    return f"""SELECT doc_id, h, CAST(i // {_W} AS INT) AS y, CAST(i % {_W} AS INT) AS x,
      (strpos('0123456789ABCDEF', b[1]) - 1) * 16 + strpos('0123456789ABCDEF', b[2]) - 1 AS g
      FROM (SELECT doc_id, len(bytes) // {_W} AS h, unnest(bytes) AS b, unnest(range(len(bytes))) AS i
        FROM (SELECT doc_id, regexp_extract_all(h || repeat('FF', CAST(({_W} - (length(h) // 2) % {_W}) % {_W} AS INT)), '..') AS bytes
          FROM (SELECT doc_id, hex({text}) AS h FROM documents)))"""


sql_view("i_px", _pixels_sql("text"))


@query(
    "q_q1_raster_stats",
    cte("i_px") + f""", rows AS (SELECT doc_id, max(h) AS h FROM i_px GROUP BY doc_id)
    SELECT d.doc_id, CAST(CASE WHEN r.h IS NOT NULL THEN {_W} END AS INT) AS width_px, CAST(r.h AS INT) AS height_px, {rnd('s.m', 4)} AS mean_gray, {rnd('s.sd', 4)} AS std_gray,
      {rnd('s.paper', 6)} AS paper_share, {rnd('s.ink', 6)} AS ink_share
    FROM documents d LEFT JOIN rows r USING (doc_id) LEFT JOIN (SELECT doc_id, avg(g) AS m, stddev_pop(g) AS sd, avg((g > 230)::INT) AS paper, avg((g < 100)::INT) AS ink FROM i_px GROUP BY doc_id) s USING (doc_id)""",
)
def q1(spark, sf):
    stats = Q.raster_stats(_rasters(spark, sf), ["doc_id"])
    return stats.select(
        "doc_id", "width_px", "height_px", F.round("mean_gray", 4).alias("mean_gray"), F.round("std_gray", 4).alias("std_gray"),
        F.round("paper_share", 6).alias("paper_share"), F.round("ink_share", 6).alias("ink_share"),
    )


def _two(v: str, c: str, over: str, last: str) -> str:
    """Neighbours two steps away on either side; the border mirrors, a short side meets the pixel itself."""
    lag, lead = f"lag({v}, 2) OVER {over}", f"lead({v}, 2) OVER {over}"
    return (
        f"coalesce({lag}, CASE WHEN {c} = 0 THEN {lead} END, {v}) + coalesce({lead}, CASE WHEN {c} = {last} THEN {lag} END, {v})"
    )


def _one(v: str, over: str) -> str:
    lag, lead = f"lag({v}) OVER {over}", f"lead({v}) OVER {over}"
    return f"coalesce({lag}, {lead}, {v}) + coalesce({lead}, {lag}, {v})"


_ALONG = "WINDOW r AS (PARTITION BY doc_id, y ORDER BY x), c AS (PARTITION BY doc_id, x ORDER BY y)"
sql_view("i_lap", f"SELECT doc_id, {_one('g', 'r')} + {_one('g', 'c')} - 4 * g AS v FROM i_px {_ALONG}", "i_px")
sql_view("i_rowblur", f"SELECT doc_id, h, y, x, g, {_two('g', 'x', 'r', str(_W - 1))} + 4 * ({_one('g', 'r')}) + 6 * g AS s FROM i_px {_ALONG}", "i_px")
sql_view("i_res", f"SELECT doc_id, g - (({_two('s', 'y', 'c', 'h - 1')} + 4 * ({_one('s', 'c')}) + 6 * s + 128) >> 8) AS v FROM i_rowblur {_ALONG}", "i_rowblur")


@query(
    "q_a12_sharpness_noise",
    cte("i_lap", "i_res") + f""" SELECT l.doc_id, {rnd('l.v', 3)} AS laplacian_variance, {rnd('n.v', 4)} AS noise_std
      FROM (SELECT doc_id, var_pop(v) AS v FROM i_lap GROUP BY doc_id) l JOIN (SELECT doc_id, stddev_pop(v) AS v FROM i_res GROUP BY doc_id) n USING (doc_id)""",
)
def a12(spark, sf):
    stats = Q.raster_stats(_rasters(spark, sf), ["doc_id"]).where("mean_gray is not null")
    return stats.select("doc_id", F.round("laplacian_variance", 3).alias("laplacian_variance"), F.round("noise_std", 4).alias("noise_std"))


@query(
    "q_a11_gray_histogram",
    cte("i_px") + f""" SELECT doc_id, CAST(g // 16 AS INT) AS bin, {rnd('count(*) / CAST(max(h) * ' + str(_W) + ' AS DOUBLE)', 6)} AS share FROM i_px GROUP BY doc_id, g // 16""",
)
def a11(spark, sf):
    stats = Q.raster_stats(_rasters(spark, sf), ["doc_id"])
    return stats.select("doc_id", F.posexplode_outer("histogram").alias("bin", "share")).where("share > 0")


def _exact_variance(v: str) -> str:
    """From whole-number sums: a running mean is off by some last digits, which shows where a value lies on a rounding tie."""
    return f"CAST(count(*) * sum(CAST({v} AS HUGEINT) * {v}) - sum(CAST({v} AS HUGEINT)) * sum(CAST({v} AS HUGEINT)) AS DOUBLE) / count(*) / count(*)"


sql_view(
    "i_stats",
    f"""SELECT p.*, l.laplacian_variance, n.noise_std FROM (SELECT doc_id, max(h) AS h, avg(g) AS mean_gray, sqrt({_exact_variance('g')}) AS std_gray FROM i_px GROUP BY doc_id) p
      JOIN (SELECT doc_id, {_exact_variance('v')} AS laplacian_variance FROM i_lap GROUP BY doc_id) l USING (doc_id)
      JOIN (SELECT doc_id, sqrt({_exact_variance('v')}) AS noise_std FROM i_res GROUP BY doc_id) n USING (doc_id)""",
    "i_px", "i_lap", "i_res",
)


@query(
    "q_q4_page_profile",
    cte("i_stats") + f""", scored AS (SELECT doc_id, {_qs_sql((50.0, 1300.0), (20.0, 82.0), (2.0, 20.0), _STRICT_B)}, {_W} AS width_px, CAST(h AS INT) AS height_px,
        {rnd('mean_gray', 2)} AS mean_gray, {rnd('std_gray', 2)} AS std_gray, {rnd('laplacian_variance', 2)} AS laplacian_variance FROM i_stats)
      SELECT * FROM (SELECT doc_id FROM documents) LEFT JOIN scored USING (doc_id)""",
)
def q4(spark, sf):
    p = Q.page_profile(Q.raster_stats(_rasters(spark, sf), ["doc_id"]))
    return p.select("doc_id", "qs_metrics.*", "image_params.*")


@query(
    "q_q5_page_flags",
    cte("i_res", "i_px") + """ SELECT s.doc_id, s.paper > 0.55 AND s.ink > 0.003 AND n.v < 12 AS is_clean, s.m >= 218 AND s.sd <= 55 AS is_washed
      FROM (SELECT doc_id, avg(g) AS m, stddev_pop(g) AS sd, avg((g > 230)::INT) AS paper, avg((g < 100)::INT) AS ink FROM i_px GROUP BY doc_id) s
      JOIN (SELECT doc_id, stddev_pop(v) AS v FROM i_res GROUP BY doc_id) n USING (doc_id)""",
)
def q5(spark, sf):
    flags = Q.page_flags(Q.raster_stats(_rasters(spark, sf), ["doc_id"])).where("mean_gray is not null")
    return flags.select("doc_id", "is_clean", "is_washed")


# Short texts gain a row of pixels, so that both sides of their pages differ in size.
_SHORT = 400
_AFTER_SQL = f"replace(text, 'e', 'E') || CASE WHEN length(text) < {_SHORT} THEN repeat('x', {_W}) ELSE '' END"
sql_view("i_after", _pixels_sql(_AFTER_SQL))


def _report(spark, sf):
    longer = F.when(F.length("text") < _SHORT, F.lit("x" * _W)).otherwise("")
    after = F.concat(F.replace("text", F.lit("e"), F.lit("E")), longer)
    return Q.enhancement_report(_rasters(spark, sf), _rasters(spark, sf, after), ["doc_id"])


@query(
    "q_q6_enhancement_report",
    cte("i_px", "i_after") + f""", rep AS (SELECT b.doc_id, avg((a.g <> b.g)::INT) AS changed, coalesce(avg(a.g - b.g) FILTER (WHERE b.g >= 230), 0) AS lift,
        coalesce(avg(a.g - b.g) FILTER (WHERE b.g < 100), 0) AS deepen, avg(a.g - b.g) AS shift FROM i_px b JOIN i_after a ON a.doc_id = b.doc_id AND a.x = b.x AND a.y = b.y AND a.h = b.h GROUP BY b.doc_id)
      SELECT d.doc_id, {rnd('changed', 4)} AS pct_pixels_changed, {rnd('lift', 2)} AS paper_lift, {rnd('deepen', 2)} AS ink_deepen, {rnd('shift', 2)} AS mean_shift FROM documents d LEFT JOIN rep USING (doc_id)""",
)
def q6(spark, sf):
    return _report(spark, sf).select("doc_id", "pct_pixels_changed", "paper_lift", "ink_deepen", "mean_shift")


@query(
    "q_q6_histograms",
    cte("i_px", "i_after") + f""", sizes AS (SELECT doc_id, h FROM i_px INTERSECT SELECT doc_id, h FROM i_after),
      old AS (SELECT doc_id, g // 16 AS bin, count(*) AS n FROM i_px GROUP BY ALL), new AS (SELECT doc_id, g // 16 AS bin, count(*) AS n FROM i_after GROUP BY ALL)
      SELECT s.doc_id, CAST(b.bin AS INT) AS bin, {rnd(f'coalesce(old.n, 0) / CAST(s.h * {_W} AS DOUBLE)', 6)} AS share_before, {rnd(f'coalesce(new.n, 0) / CAST(s.h * {_W} AS DOUBLE)', 6)} AS share_after
      FROM sizes s JOIN range(16) b(bin) ON true LEFT JOIN old ON old.doc_id = s.doc_id AND old.bin = b.bin LEFT JOIN new ON new.doc_id = s.doc_id AND new.bin = b.bin""",
)
def q6_histograms(spark, sf):
    both = F.arrays_zip("hist_before", "hist_after")
    bins = _report(spark, sf).select("doc_id", F.posexplode(both).alias("bin", "shares"))
    return bins.select("doc_id", "bin", F.col("shares.hist_before").alias("share_before"), F.col("shares.hist_after").alias("share_after"))
