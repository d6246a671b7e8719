"""Personal data in texts, by weak supervision, with DataFrame functions only.

Candidates are the base matches of four kinds and looser matches (long mixed tokens, number groups, spelled-out addresses).
Five labelers vote on every candidate or abstain: base pattern, shape, gazetteer, context before the match, and signs against.
The votes of all candidates of all documents are counted by combination; there are few combinations however many documents,
and only those counts reach the driver. Expectation-maximisation over them estimates the class shares and each labeler's
confusion table without any labelled data, and the posteriors train a softmax classifier over votes and shape. Base matches
always stay; other candidates become spans where the classifier gives a kind of data at least ``least`` probability.

Positions are code points, ends exclusive. Patterns are written so that no text makes them backtrack: runs are possessive and
begin where a run begins, and separators that cannot belong to a match are neutralised beforehand, one character for one.

Null and empty texts have no spans. Rows are judged alone, so repeated rows get equal results; ties between classes go to the
first class. Further columns pass or do not matter. An empty table gives no rows (and an untrained classifier).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.arrays import free_name

KINDS = ("email", "ip", "card", "phone", "secret")
NONE = len(KINDS) + 1  # class numbers begin at 1; 0 is a vote withheld
MARK, OFF, SEP = "\u0001", "\u0002", "\u0003"
BEFORE = 32

# The base patterns, equal in what they match to the stated ones.
_LOCAL = rf"[A-Za-z0-9._%+{SEP}-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9][0-9 -]+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
# Looser candidates.
MIXED = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+"
NUMBERS = r"(?<![A-Za-z0-9+.(-])\(?[0-9][0-9 ().-]{7,}[0-9]"
SPELLED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]++ ?[\[(] ?dot ?[\])] ?[A-Za-z0-9-]++"
# Gazetteers and context words.
TOP_DOMAINS = r"\.(?:com|org|net|edu|gov|info|io|eu|de|fr|es|it|uk|us|ch|at|be|nl)$"
COUNTRY_CODES = r"^\+(?:1|3[0-9]|4[0-9]|5[1-8]|6[0-6]|7|8[1-6]|9[0-8])[^0-9]?"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"
KEY_PREFIXES = r"^(?:AKIA|ASIA|ghp_|gho_|sk-|sk_|pk_|xox|eyJ|glpat-)"
CONTEXT = {
    "email": r"(?i)(?:e-?mail|contact|courriel|correo|write to|mailto)[^A-Za-z0-9]{0,6}(?:[a-z]{1,4} )?$",
    "ip": r"(?i)(?:\bip|host|server|address|adresse|v4)[^A-Za-z0-9]{0,6}$",
    "card": r"(?i)(?:card|credit|visa|mastercard|karte|carte|tarjeta)[^A-Za-z0-9]{0,6}(?:no\.? ?|number ?|nr\.? ?)?$",
    "phone": r"(?i)(?:phone|call|tel|mobile|fax|telefon|appel)[^A-Za-z0-9]{0,6}(?:at ?|no\.? ?)?$",
    "secret": r"(?i)(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|private[_-]?key|credential)s?[\"' ]{0,2}[:=]\s?[\"']?$",
}
AGAINST = r"(?i)(?:version|release|isbn|issn|section|chapter|page|figure|no\.|sha256:|commit|\bv)[^A-Za-z0-9]{0,3}$"


def _matches(text: Column, pattern: str, base: str | None) -> Column:
    """Matches in order: start, end, value, what stands before, and the base kind to be confirmed."""
    pieces = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)
    entry = "struct<start: int, stop: int, value: string, before: string, base: string>"
    empty = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.lit("").alias("tail"), F.array().cast(f"array<{entry}>").alias("found"))

    def step(acc: Column, piece: Column) -> Column:
        stop = acc["at"] + F.char_length(piece)
        found = F.struct(acc["at"].alias("start"), stop.alias("stop"), piece.alias("value"), acc["tail"].alias("before"), F.lit(base).cast("string").alias("base"))
        return F.struct(stop.alias("at"), (acc["i"] + 1).alias("i"), F.right(piece, F.lit(BEFORE)).alias("tail"), F.when(acc["i"] % 2 == 1, F.concat(acc["found"], F.array(found))).otherwise(acc["found"]).alias("found"))

    return F.aggregate(pieces, empty, step, lambda acc: acc["found"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.char_length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _is_card(value: Column) -> Column:
    d = _digits(value)
    return F.char_length(d).between(13, 19) & luhn(d)


def _is_ip(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: (F.char_length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.regexp_replace(p, "^0+(?=[0-9])", "").cast("int") <= 255))


def _clear(a: Column, others: Column) -> Column:
    """Whether a candidate overlaps none of the others."""
    return ~F.exists(others, lambda o: (o["start"] < a["stop"]) & (a["start"] < o["stop"]))


CANDIDATE = "struct<start: int, stop: int, base: string, votes: array<int>, shape: array<int>>"


def _vote(c: Column) -> Column:
    """Votes of the five labelers and the shape of a candidate."""
    value, before = c["value"], c["before"]
    n_digits = F.char_length(_digits(value))
    number = {k: i + 1 for i, k in enumerate(KINDS)}
    dotted = value.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    hexes = value.rlike(r"^[0-9a-fA-F]{32,}$")
    at = F.contains(value, F.lit("@")) | value.rlike(r"[\[(] ?at ?[\])]")
    mixed = value.rlike("[0-9].*[0-9]") & value.rlike("[A-Za-z]") & ~at
    base = F.coalesce(*[F.when(c["base"] == k, F.lit(i)) for k, i in number.items()], F.lit(0))
    shape = F.when(at, number["email"]).when(dotted, number["ip"]).when(hexes, number["secret"]).when(value.rlike(r"^\+|[()]") & n_digits.between(9, 15), number["phone"]).when(value.rlike(r"^[0-9]{4}([ -]?[0-9]{4}){3}$"), number["card"]).otherwise(0)
    lists = F.when(at & value.rlike(TOP_DOMAINS), number["email"]).when(value.rlike(KEY_PREFIXES), number["secret"]).when(value.rlike(COUNTRY_CODES), number["phone"]).when(dotted & value.rlike(r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\."), number["ip"]).when(n_digits.between(13, 19) & value.rlike("^[0-9 -]+$") & value.rlike(ISSUERS), number["card"]).otherwise(0)
    context = F.coalesce(*[F.when(before.rlike(p), F.lit(number[k])) for k, p in CONTEXT.items()], F.lit(0))
    against = F.when(before.rlike(AGAINST), NONE).when(value.rlike(r"^[0-9 -]+$") & ~_is_card(value), NONE).when(value.rlike(r"^(.)\1+$"), NONE).when(~at & ~dotted & ~hexes & ~mixed & ~value.rlike(r"^\+|[()]"), NONE).otherwise(0)
    letters = F.char_length(F.regexp_replace(value, "[^A-Za-z]", ""))
    looks = F.array(F.least(n_digits, F.lit(20)), F.least(F.floor(F.char_length(value) / 4), F.lit(15)).cast("int"), F.when(letters == 0, 0).when(letters < n_digits, 1).otherwise(2))
    return F.struct(c["start"].alias("start"), c["stop"].alias("stop"), c["base"].alias("base"), F.array(base, shape, lists, context, against).cast("array<int>").alias("votes"), looks.cast("array<int>").alias("shape"))


def candidates(text: Column) -> Column:
    """All candidates of a text with their votes."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), MARK + OFF + SEP, "\u0004\u0004\u0004")
    none = F.array().cast("array<struct<start: int, stop: int, value: string, before: string, base: string>>")
    digit = plain.rlike("[0-9]")
    only = lambda when, found: F.when(when, found).otherwise(none)
    email = only(F.contains(plain, F.lit("@")), _matches(F.regexp_replace(plain, r"\.(?![A-Za-z0-9-])", SEP), EMAIL, "email"))
    ip = only(digit & F.contains(plain, F.lit(".")), F.filter(_matches(plain, IP, "ip"), lambda m: _is_ip(m["value"])))
    card = only(digit, F.filter(_matches(F.regexp_replace(plain, r"(?<=[0-9])[ -](?![0-9])", SEP), CARD, "card"), lambda m: _is_card(m["value"])))
    phone = only(F.contains(plain, F.lit("+")), F.filter(_matches(plain, PHONE, "phone"), lambda m: F.char_length(_digits(m["value"])).between(9, 15)))
    base = F.concat(email, ip, card, phone)
    mixed = only(digit, F.filter(_matches(plain, MIXED, None), lambda m: F.char_length(_digits(m["value"])) >= 4))
    # Longer groups of digits are cards or nothing, and the base pattern has judged those.
    numbers = only(digit, F.filter(_matches(plain, NUMBERS, None), lambda m: F.char_length(_digits(m["value"])) <= 12))
    loose = F.concat(mixed, numbers, only(plain.rlike(r"[\[(] ?at ?[\])]"), _matches(plain, SPELLED, None)))
    # The base matches are bound once; of the loose ones those remain that overlap none of them.
    both = F.transform(F.array(F.struct(base.alias("base"), loose.alias("loose"))), lambda x: F.concat(x["base"], F.filter(x["loose"], lambda m: _clear(m, x["base"]))))
    return F.transform(F.element_at(both, 1), _vote)


def annotate(docs: DataFrame, column: str) -> DataFrame:
    return docs.withColumn(column, candidates(F.col("text")))


def count_votes(found: DataFrame, column: str) -> list[tuple[tuple[int, ...], tuple[int, ...], int]]:
    """Number of candidates for each combination of votes and shape; there are at most as many as combinations."""
    rows = found.select(F.explode(column).alias("c")).groupBy("c.votes", "c.shape").count().collect()
    return sorted((tuple(r["votes"]), tuple(r["shape"]), r["count"]) for r in rows)


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of each combination, class shares and confusion tables (labeler, class, vote), by expectation-maximisation."""
    kinds, labelers = NONE, votes.shape[1]
    table = np.full((labelers, kinds, NONE + 1), 0.1 / NONE)
    table[:, :, 0] = 0.4
    for k in range(kinds):
        table[:, k, k + 1] = 0.5
    table /= table.sum(2, keepdims=True)
    share = np.full(kinds, 1 / kinds)
    prior = 2.0 * table
    for _ in range(rounds):
        log = np.log(share) + sum(np.log(table[j][:, votes[:, j]]).T for j in range(labelers))
        post = np.exp(log - log.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        mass = post * counts[:, None]
        share = (mass.sum(0) + 1) / (mass.sum() + kinds)
        for j in range(labelers):
            for v in range(NONE + 1):
                table[j, :, v] = mass[votes[:, j] == v].sum(0) + prior[j, :, v]
        table /= table.sum(2, keepdims=True)
    return post, share, table


class SpanClassifier:
    """Softmax over one-hot votes and shapes, as a Column."""

    SIZES = (NONE + 1,) * 5 + (21, 16, 3)

    def __init__(self, counted: list[tuple[tuple[int, ...], tuple[int, ...], int]], steps: int = 400, rate: float = 1.0, shrink: float = 1e-3) -> None:
        self.weights = [np.zeros((n, NONE)) for n in self.SIZES]
        self.bias = np.zeros(NONE)
        if not counted:
            return
        votes, shapes = np.array([c[0] for c in counted]), np.array([c[1] for c in counted])
        counts = np.array([c[2] for c in counted], float)
        post, self.share, self.tables = reliabilities(votes, counts)
        values = np.concatenate([votes, shapes], 1)
        # Rare combinations still count: weights grow with the logarithm of the number.
        mass = np.log1p(counts)
        mass /= mass.sum()
        for _ in range(steps):
            p = self._probabilities(values)
            error = (p - post) * mass[:, None]
            self.bias -= rate * error.sum(0)
            for f, w in enumerate(self.weights):
                gradient = np.zeros_like(w)
                np.add.at(gradient, values[:, f], error)
                w -= rate * (gradient + shrink * w)

    def _probabilities(self, values: np.ndarray) -> np.ndarray:
        score = self.bias + sum(w[values[:, f]] for f, w in enumerate(self.weights))
        score = np.exp(score - score.max(1, keepdims=True))
        return score / score.sum(1, keepdims=True)

    def kind(self, candidate: Column, least: float) -> Column:
        """The kind of a candidate, or null."""
        columns = [candidate["votes"][j] for j in range(5)] + [candidate["shape"][j] for j in range(3)]
        scores = []
        for k in range(NONE):
            parts = [F.array(*[F.lit(float(x)) for x in w[:, k]])[c] for w, c in zip(self.weights, columns)]
            scores.append(F.lit(float(self.bias[k])) + sum(parts[1:], parts[0]))
        # Bound once, since the scores are named several times.
        bound = F.element_at(F.transform(F.array(F.array(*scores)), lambda s: F.struct(s.alias("s"), F.array_max(s).alias("top"), F.aggregate(s, F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max(s))).alias("total"))), 1)
        best = F.element_at(F.transform(F.array(bound), lambda b: F.when(1 / b["total"] >= least, F.array_position(b["s"], b["top"]))), 1)
        names = F.array(*[F.lit(k) for k in KINDS], F.lit(None).cast("string"))
        return F.element_at(names, F.coalesce(best.cast("int"), F.lit(NONE)))


def spans(column: str, model: SpanClassifier, least: float = 0.5) -> Column:
    """``kind``, ``start``, ``stop`` and ``base`` of every span, by kind as listed, then start."""
    named = F.transform(column, lambda c: F.struct(F.coalesce(c["base"], model.kind(c, least)).alias("kind"), c["start"].alias("start"), c["stop"].alias("stop"), c["base"].isNotNull().alias("base")))
    placed = F.transform(F.filter(named, lambda c: c["kind"].isNotNull()), lambda c: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), c["kind"]).alias("order"), c["start"].alias("start"), c["stop"].alias("stop"), c["kind"].alias("kind"), c["base"].alias("base")))
    return F.array_sort(placed)


def digest(found: str | Column) -> Column:
    found = F.col(found) if isinstance(found, str) else found
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def find(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``doc_id``, the counts and digests of the base spans, and all spans, of every row."""
    from quire.llm.shared import store

    found = store(annotate(docs.select(F.col("doc_id").cast("long"), "text"), "found").drop("text"), "spans")
    model = SpanClassifier(count_votes(found, "found"))
    labelled = found.select("doc_id", spans("found", model, least).alias("found"))
    base = labelled.withColumn("base", F.filter("found", lambda s: s["base"]))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [number(k).alias(f"n_{k}") for k in KINDS[:4]]
    return base.select("doc_id", *counts, F.sha2(digest("base"), 256).alias("base_sha256"), digest("found").alias("spans"))


def mask(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets, and ``n_chars``, where there is one, counted anew."""
    column = free_name(docs, "found")
    model = SpanClassifier(count_votes(annotate(docs.select("text"), column), column))
    text = F.col("text").cast("string")

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(F.concat(gap, F.lit("["), F.upper(s["kind"]), F.lit("]"))))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    by_place = F.array_sort(F.transform(spans(column, model, least), lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("back"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    whole = F.aggregate(by_place, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.greatest(F.char_length(text), F.lit(1)))))
    masked = annotate(docs, column)
    masked = masked.withColumn("text", F.when(F.size(column) > 0, whole).otherwise(text)).drop(column)
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked
