"""Page classification: TF-IDF cosine to class seed texts, fused with hint phrases.

The vectoriser is defined over the class seed texts *plus the page itself*, so each
page has its own document frequencies. Fitting per page is avoided: with N = classes
+ 1, the page only raises by one the frequency of the terms it shares with a seed
text. The page norm therefore needs nothing but the page's own term counts, and the
class norms are a static value corrected on the shared terms.

Term counts and the page norm are computed inside the page row. Only the distinct
terms shared with the taxonomy leave the row, and they are combined per page before
the one narrow shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.dims import MAX_TAXONOMY_TERMS, Taxonomy
from quire.functions.text import head_tail, let, sorted_runs, squash_ws, strip_ws

# Fixed values.
MAX_CHARS = 100_000
KEYWORD_WEIGHT = 0.32
SHARPNESS = 14.0
MAX_DF_SHARE = 0.98
UNKNOWN = "Unknown"
MAX_NAMED_TERMS = 5000  # a larger vocabulary is left to the join alone

TOKEN = r"[\p{L}\p{N}_]{2,}"


def prepare_text(c: Column, max_chars: int | None = None) -> Column:
    """Text as the classifier reads it: all of it, or its two outer halves where ``max_chars`` is given (``MAX_CHARS`` as published)."""
    squashed = squash_ws(F.coalesce(c, F.lit("")))
    return strip_ws(head_tail(squashed, max_chars, " ")) if max_chars else squashed


def unigrams(prepared: Column) -> Column:
    """Maximal runs of at least two word characters."""
    return F.regexp_extract_all(prepared, F.lit(TOKEN), F.lit(0))


def with_bigrams(words: Column) -> Column:
    """1-grams followed by 2-grams."""
    pairs = F.greatest(F.size(words) - 1, F.lit(0))
    return F.concat(
        words,
        F.zip_with(F.slice(words, F.lit(1), pairs), F.slice(words, F.lit(2), pairs), lambda a, b: F.concat(a, F.lit(" "), b)),
    )


def _grams(text: str) -> list[str]:
    words = re.findall(r"\w\w+", text.lower())
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def taxonomy_weights(spark: SparkSession, taxonomy: Taxonomy) -> DataFrame:
    """``(term, df, class_pos, tf)`` of the seed texts."""
    per_class = [Counter(_grams(t)) for t in taxonomy.prototypes.values()]
    df = Counter(term for counts in per_class for term in counts)
    rows = [(t, df[t], pos, tf) for pos, counts in enumerate(per_class) for t, tf in counts.items()]
    return spark.createDataFrame(rows, "term string, df int, class_pos int, tf_class int")


def _idf(df: Column, n: int) -> Column:
    return F.log((1.0 + n) / (1.0 + df)) + 1.0


def _sublinear(tf: Column) -> Column:
    return 1.0 + F.log(tf)


def _static_norms(taxonomy: Taxonomy) -> list[float]:
    """Squared class norms with the document frequencies of the seed texts alone."""
    n = len(taxonomy.prototypes) + 1
    per_class = [Counter(_grams(t)) for t in taxonomy.prototypes.values()]
    df = Counter(term for counts in per_class for term in counts)
    return [
        sum(((1 + math.log(tf)) * (math.log((1 + n) / (1 + df[t])) + 1)) ** 2 for t, tf in counts.items())
        for counts in per_class
    ]


def keyword_intent(prepared: Column, hints: list[str]) -> Column:
    """Share of hint phrases found as substrings, at most 1."""
    if not hints:
        return F.lit(0.0)
    hits = sum(F.contains(prepared, F.lit(h.lower())).cast("int") for h in hints)
    return F.least(F.lit(1.0), hits / F.lit(max(4.0, 0.35 * len(hints))))


def keyword_intents(prepared: Column, hint_lists: list[list[str]]) -> Column:
    """``keyword_intent`` of each class, as one array.

    The phrases are a constant that is walked, so the code does not grow with them; spelled out, it passes what Spark compiles.
    """
    phrases = [F.array(*[F.lit(h.lower()) for h in hints]).cast("array<string>") for hints in hint_lists]
    classes = F.array(*[F.struct(p.alias("hints"), F.lit(max(4.0, 0.35 * len(hints))).alias("most")) for p, hints in zip(phrases, hint_lists)])
    return F.transform(classes, lambda c: F.least(F.lit(1.0), F.size(F.filter(c["hints"], lambda h: F.contains(prepared, h))) / c["most"]))


def counts_of(prepared: Column) -> Column:
    """``array<struct<term, tf>>`` over 1-grams and 2-grams, by term."""
    return sorted_runs(let(unigrams(prepared), lambda w: F.sort_array(with_bigrams(w))))


def term_counts(pages: DataFrame, prepared: str, out: str = "terms") -> DataFrame:
    """Adds ``out``: ``array<struct<term, tf>>`` over 1-grams and 2-grams, in the row."""
    return pages.withColumn(out, counts_of(F.col(prepared)))


def _vocabulary(spark: SparkSession, t: Taxonomy) -> DataFrame:
    """Class terms with their inverse frequencies, without and with the page in the corpus."""
    n = len(t.classes) + 1
    max_df = MAX_DF_SHARE * n
    one_row = F.col("class_pos") == F.min("class_pos").over(Window.partitionBy("term"))
    # A term in every text of the page's corpus is left out of all vectors.
    return taxonomy_weights(spark, t).select(
        "term",
        "class_pos",
        one_row.alias("first_of_term"),
        F.when(F.col("df") + 1 <= max_df, _idf(F.col("df") + 1, n)).otherwise(F.lit(0.0)).alias("idf_new"),
        F.when(F.col("df") <= max_df, _idf(F.col("df"), n)).otherwise(F.lit(0.0)).alias("idf_old"),
        _sublinear(F.col("tf_class")).alias("w_class"),
    )


def _matched_terms(pages: DataFrame, key: list[str], text: str, t: Taxonomy) -> DataFrame:
    """Terms a page shares with the taxonomy, plus one row with a null term for the page itself."""
    vocabulary = {term for x in t.prototypes.values() for term in _grams(x)}

    def measured(terms: Column) -> Column:
        # The norm takes all terms; of a taxonomy that is small enough to be named, the others need not leave the row.
        shared = F.filter(terms, lambda r: r["term"].isin(sorted(vocabulary))) if len(vocabulary) <= MAX_NAMED_TERMS else terms
        norm = F.aggregate(terms, F.lit(0.0), lambda acc, r: acc + F.pow(_sublinear(r["tf"]), 2))
        return F.struct(norm.alias("sum_sq"), shared.alias("terms"))

    prepared = pages.select(*key, prepare_text(F.col(text)).alias("__low"))
    counted = prepared.withColumn("__measured", let(counts_of(F.col("__low")), measured)).select(
        *key,
        (F.col("__low") != "").alias("has_text"),
        keyword_intents(F.col("__low"), [t.hints.get(c, []) for c in t.classes]).alias("keyword"),
        F.col("__measured.sum_sq").alias("__sum_sq"),
        F.col("__measured.terms").alias("__terms"),
    )
    carrier = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(None).cast("int").alias("tf")))
    exploded = counted.select("*", F.explode_outer(F.concat(carrier, F.col("__terms"))).alias("__t")).select(
        *key, "has_text", "keyword", "__sum_sq", F.col("__t.term").alias("term"), F.col("__t.tf").alias("tf")
    )
    weights = _vocabulary(pages.sparkSession, t)
    small = sum(len(_grams(x)) for x in t.prototypes.values()) <= MAX_TAXONOMY_TERMS
    return exploded.join(F.broadcast(weights) if small else weights, "term", "left").where("term is null or class_pos is not null")


def shared_terms(pages: DataFrame, key: list[str], text: str, taxonomy: Taxonomy | None = None) -> DataFrame:
    """``(key, class_pos, term, tf)``: terms of a page that a class seed text has too."""
    matched = _matched_terms(pages, key, text, taxonomy or Taxonomy())
    return matched.where("class_pos is not null").select(*key, "class_pos", "term", "tf")


def _page_norm(t: Taxonomy) -> Column:
    """Norm of the page vector: all its terms as its own, corrected on the shared ones."""
    own = math.log((2.0 + len(t.classes)) / 2.0) + 1.0
    return F.sqrt(F.col("__sum_sq") * own**2 + F.col("__page_delta"))


def _page_delta(t: Taxonomy) -> Column:
    own = math.log((2.0 + len(t.classes)) / 2.0) + 1.0
    changed = F.pow(_sublinear(F.col("tf")), 2) * (F.pow("idf_new", 2) - own**2)
    return F.coalesce(F.sum(F.when(F.col("first_of_term"), changed)), F.lit(0.0)).alias("__page_delta")


def page_norms(pages: DataFrame, key: list[str], text: str, taxonomy: Taxonomy | None = None) -> DataFrame:
    """``(key, norm)``: length of each page's weight vector in its own corpus."""
    t = taxonomy or Taxonomy()
    per_page = _matched_terms(pages, key, text, t).groupBy(*key, "__sum_sq").agg(_page_delta(t))
    return per_page.select(*key, _page_norm(t).alias("norm"))


def class_similarities(pages: DataFrame, key: list[str], text: str, taxonomy: Taxonomy | None = None) -> DataFrame:
    """One row per page: ``cosine`` and ``keyword`` arrays in class order, ``has_text``, ``has_terms``."""
    t = taxonomy or Taxonomy()
    matched = _matched_terms(pages, key, text, t)
    dot = _sublinear(F.col("tf")) * F.col("w_class") * F.pow("idf_new", 2)
    class_delta = F.pow("w_class", 2) * (F.pow("idf_new", 2) - F.pow("idf_old", 2))

    def per_class(value: Column, tag: str) -> list[Column]:
        return [
            F.coalesce(F.sum(F.when(F.col("class_pos") == i, value)), F.lit(0.0)).alias(f"__{tag}{i}") for i in range(len(t.classes))
        ]

    # Page-level values ride as grouping columns: the buffer stays fixed-width, so the
    # aggregate hashes instead of sorting, and it is combined before the shuffle.
    per_page = matched.groupBy(*key, "has_text", "keyword", "__sum_sq").agg(
        _page_delta(t), *per_class(dot, "dot"), *per_class(class_delta, "delta")
    )
    cosine = [
        F.coalesce(F.try_divide(F.col(f"__dot{i}"), _page_norm(t) * F.sqrt(F.lit(norm) + F.col(f"__delta{i}"))), F.lit(0.0))
        for i, norm in enumerate(_static_norms(t))
    ]
    return per_page.select(
        *key, "has_text", "keyword", (F.col("__sum_sq") > 0).alias("has_terms"), F.array(*cosine).alias("cosine")
    )


def fuse(cosine: Column, keyword: Column) -> Column:
    """Weighted blend per class, floored at zero."""
    return F.zip_with(
        cosine, keyword, lambda s, k: F.greatest(F.lit(0.0), (1.0 - KEYWORD_WEIGHT) * s + KEYWORD_WEIGHT * k)
    )


def argmax_class(scores: Column, classes: list[str]) -> Column:
    """Name of the highest score; a tie goes to the first class."""
    names = F.array(*[F.lit(c) for c in classes])
    return F.get(names, F.array_position(scores, F.array_max(scores)).cast("int") - 1)


def classify(pages: DataFrame, key: list[str], text: str, taxonomy: Taxonomy | None = None) -> DataFrame:
    """``(key, doc_class, score_list)``: the winning class and percents in class order.

    Blank text is ``Unknown`` without scores; text that resembles nothing is
    ``Unknown`` with zero scores.
    """
    t = taxonomy or Taxonomy()
    sims = class_similarities(pages, key, text, t)

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)

    def percents(combined: Column) -> Column:
        weights = let(F.array_max(combined), lambda top: F.transform(combined, lambda s: F.exp(SHARPNESS * (s - top))))
        return let(weights, lambda ws: let(total(ws), lambda t: F.transform(ws, lambda w: F.round(w / t * 100, 2))))

    def rate(combined: Column) -> Column:
        return F.struct((total(combined) > 0).alias("any"), percents(combined).alias("percent"))

    scored = sims.withColumn("__s", let(fuse(F.col("cosine"), F.col("keyword")), rate))
    anything = F.col("has_terms") & F.col("__s.any")
    zeros = F.array(*[F.lit(0.0)] * len(t.classes))
    return scored.select(
        *key,
        F.when(F.col("has_text") & anything, argmax_class(F.col("__s.percent"), t.classes)).otherwise(UNKNOWN).alias("doc_class"),
        F.when(~F.col("has_text") | ~F.col("has_terms"), F.lit(None))
        .when(anything, F.col("__s.percent"))
        .otherwise(zeros)
        .alias("score_list"),
    )


def score_map(score_list: Column, taxonomy: Taxonomy | None = None) -> Column:
    t = taxonomy or Taxonomy()
    empty = F.create_map().cast("map<string,double>")
    return F.coalesce(F.map_from_arrays(F.array(*[F.lit(c) for c in t.classes]), score_list), empty)


def long_scores(classified: DataFrame, key: list[str], taxonomy: Taxonomy | None = None) -> DataFrame:
    """One row per page and class: ``(key, class_pos, doc_class, score)``."""
    t = taxonomy or Taxonomy()
    names = F.array(*[F.lit(c) for c in t.classes])
    return classified.select(*key, F.posexplode_outer("score_list").alias("class_pos", "score")).select(
        *key, "class_pos", F.get(names, F.col("class_pos")).alias("class_name"), "score"
    ).where("class_pos is not null")


def ranked_classes(scores: DataFrame, key: list[str]) -> DataFrame:
    """Classes by descending score, with the bar length against the best (or 1 when that is zero)."""
    per_page = Window.partitionBy(*key)
    top = F.max("score").over(per_page)
    return scores.withColumn(
        "rank", F.row_number().over(per_page.orderBy(F.desc("score"), "class_pos"))
    ).withColumn("bar", F.col("score") / F.when(top == 0, F.lit(1.0)).otherwise(top))


def rollup_document_class(pages: DataFrame) -> DataFrame:
    """Class and scores of the lowest page that has a class; null when none has."""
    has_class = F.coalesce(F.col("page_doc_class"), F.lit("")) != ""
    picked = F.min_by(
        F.when(has_class, F.struct("page_doc_class", "page_doc_class_scores")),
        F.when(has_class, F.col("page_index")),
    )
    return pages.groupBy("document_id").agg(picked.alias("__p")).select(
        "document_id",
        F.col("__p.page_doc_class").alias("doc_class"),
        F.col("__p.page_doc_class_scores").alias("doc_class_scores"),
    )


def validate_class(label: Column, taxonomy: Taxonomy | None = None) -> Column:
    """Trimmed label when it is a class, else the class equal but for case, else ``Unknown``."""
    t = taxonomy or Taxonomy()
    name = strip_ws(label)
    alias = F.create_map(*[F.lit(x) for c in reversed(t.classes) for x in (c.lower(), c)])
    return (
        F.when(name.isin([*t.classes, UNKNOWN]), name)
        .otherwise(F.coalesce(F.try_element_at(alias, F.lower(name)), F.lit(UNKNOWN)))
    )


def parse_model_class(answers: DataFrame, raw: str, taxonomy: Taxonomy | None = None) -> DataFrame:
    """Adds ``model_class`` and ``model_scores`` from a model's JSON answer, null when unusable."""
    from quire.functions.model_json import clean_json

    t = taxonomy or Taxonomy()
    names = F.array(*[F.lit(c) for c in t.classes])
    variant = F.try_parse_json(clean_json(F.col(raw)))
    parsed = answers.withColumn(
        "__top", F.when(F.schema_of_variant(F.try_variant_get(variant, "$.top", "variant")) == "STRING", F.try_variant_get(variant, "$.top", "string"))
    ).withColumn("__raw_scores", F.from_json(F.get_json_object(clean_json(F.col(raw)), "$.scores"), "map<string,string>"))
    given = F.map_filter(
        F.map_from_arrays(
            names, F.transform(names, lambda c: F.round(F.try_element_at(F.col("__raw_scores"), c).try_cast("double"), 2))
        ),
        lambda _, v: v.isNotNull(),
    )
    label = validate_class(F.col("__top"), t)
    one_hot = F.map_from_arrays(names, F.transform(names, lambda c: F.when(c == F.col("__label"), 100.0).otherwise(0.0)))
    scored = (
        parsed.withColumn("__label", F.when(F.col("__top").isNotNull(), label))
        .withColumn("__given", F.when(F.col("__raw_scores").isNotNull(), given))
        .withColumn(
            "model_scores",
            F.when(F.col("__label").isNull(), F.lit(None))
            .when(F.size("__given") > 0, F.col("__given"))
            .when(F.col("__label") != UNKNOWN, one_hot),
        )
    )
    values = F.transform(names, lambda c: F.try_element_at(F.col("model_scores"), c))
    best = F.get(names, F.array_position(values, F.array_max(values)).cast("int") - 1)
    return scored.withColumn(
        "model_class",
        F.when(F.col("model_scores").isNull(), F.lit(None)).when(F.col("__label") == UNKNOWN, best).otherwise(F.col("__label")),
    ).drop("__top", "__raw_scores", "__label", "__given")


def classify_with_model(pages: DataFrame, key: list[str], text: str, answers: DataFrame, taxonomy: Taxonomy | None = None) -> DataFrame:
    """Model answer where it is usable, otherwise the statistical classifier.

    ``answers`` has the key columns and ``raw``. Only pages without a usable answer
    are vectorised.
    """
    t = taxonomy or Taxonomy()
    usable = parse_model_class(answers, "raw", t).where("model_class is not null")
    rest = pages.join(usable.select(*key), key, "left_anti")
    own = classify(rest, key, text, t).select(*key, "doc_class", score_map(F.col("score_list"), t).alias("scores"))
    from_model = pages.select(*key).join(usable, key).select(
        *key, F.col("model_class").alias("doc_class"), F.col("model_scores").alias("scores")
    )
    return from_model.unionByName(own)
