"""Personal data by weak supervision (operator 6). DataFrame and SQL functions only.

1. Candidate spans come from regular expressions: the base kinds (email, ip, card,
   phone), which always stay, and loose ones (phone without a plus, email with
   written-out signs, national number, secret).
2. Labelers vote 1, 0 or abstain (2) on every candidate: the strict shape, the
   character mix, gazetteers of words before the span, its neighbouring characters,
   and well-known prefixes.
3. Expectation-maximisation over the counts of vote patterns (at most 3 to the
   power of the labelers) estimates the class share and every labeler's reliability.
4. The posteriors train a naive Bayes span classifier over shape, length, character
   and context features; loose spans stay if it gives them at least ``threshold``.

Positions: ``split`` gives the text between the matches, so a match starts after the
lengths of all pieces and matches before it; a running sum over the exploded matches
of one text gives them all in linear time. Only matches and one marker per row leave
the scan; texts are never shuffled.

The base patterns are written with possessive quantifiers and start anchors that
change no match but keep matching linear and without recursion on any text.

Defined results: a null text is empty; every input row gives one output row, repeated
rows one each; a null doc_id is an ordinary row; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sha256_hex, written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "national", "secret")

#: (kind, base, signs that a text must hold, pattern)
PATTERNS = (
    ("email", True, "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", True, ".", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", True, "", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", True, "+", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("phone", False, "", r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])"),
    ("email", False, "at", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{1,64}+"
                           r"(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]{1,64}+){1,8}+"),
    ("national", False, "-", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    ("secret", False, "", r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,}+"),
)

#: Words before a span that speak for or against personal data.
WORDS_FOR = ("password", "passwd", "pwd", "token", "secret", "key", "api", "auth", "bearer", "credential", "phone",
             "tel", "mobile", "cell", "call", "fax", "email", "mail", "contact", "card", "visa", "account", "iban",
             "ssn", "social", "passport", "login")
WORDS_AGAINST = ("isbn", "issn", "version", "order", "invoice", "sku", "serial", "article", "page", "chapter", "figure",
                 "model", "commit", "build", "doi", "http", "https")
#: Fixed value: how well-known access keys begin.
PREFIXES = r"^(AKIA|ASIA|AIza|sk-|sk_|pk_|ghp_|gho_|xox|glpat-|eyJ)"

LABELERS = ("shape", "mix", "gazetteer", "neighbours", "prefix")
ROUNDS, THRESHOLD, CONTEXT = 15, 0.5, 24


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def part(i):
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))
    each = F.transform(F.sequence(F.lit(0), F.length(digits) - 1), part)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: Column, base: Column, m: Column) -> Column:
    """The checks of a base match after its pattern; loose candidates of a secret hold letters and digits."""
    n = F.length(_digits(m))
    # a part is at most 255 as a number, however many zeros lead
    ip = F.forall(F.split(m, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (
        F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    return (F.when(~base, (kind != "secret") | (m.rlike("[0-9]") & m.rlike("[A-Za-z]")))
            .when(kind == "ip", ip)
            .when(kind == "card", F.when(n.between(16, 19), luhn(_digits(m))).otherwise(False))
            .when(kind == "phone", n.between(8, 15)).otherwise(True))


def _matches(text: Column, number: int, sign: str, pattern: str) -> Column:
    """Array of (pattern number, i, characters before since the last match, match, left, right)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    each = F.when(F.size(found) > 0, F.transform(F.sequence(F.lit(0), F.size(found) - 1), lambda i: F.struct(
        F.lit(number).alias("pattern"), i.alias("i"), F.length(between[i]).cast("long").alias("gap"),
        found[i].alias("match"), F.right(between[i], F.lit(CONTEXT)).alias("before"),
        F.left(between[i + 1], F.lit(1)).alias("after"))))
    need = F.contains(text, F.lit(sign)) if sign else F.lit(True)
    if sign not in ("@", "at"):
        need = need & text.rlike("[0-9]")
    return F.when(need, each)


def candidates(docs: DataFrame) -> DataFrame:
    """One row per candidate span: row_key, doc_id, kind, base, start, stop, match, before, after;
    and per input row a marker with a null kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marker = F.array(F.struct(F.lit(-1).alias("pattern"), F.lit(0).alias("i"), F.lit(0).cast("long").alias("gap"),
                              F.lit("").alias("match"), F.lit("").alias("before"), F.lit("").alias("after")))
    none = F.slice(marker, 1, 0)
    parts = [F.coalesce(_matches(F.col("t"), i, sign, p), none) for i, (_, _, sign, p) in enumerate(PATTERNS)]
    # the key is used inside the shuffles of what is written next, and read from there afterwards
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"),
                       F.monotonically_increasing_id().alias("row_key"))
    rows = rows.select("doc_id", "row_key", F.explode(F.concat(marker, *parts)).alias("m"))
    rows = written(rows.select("doc_id", "row_key", "m.*"), "pii-matches")
    w = Window.partitionBy("row_key", "pattern").orderBy("i")
    length = F.length("match")
    rows = rows.withColumn("stop", F.sum(F.col("gap") + length).over(w)).withColumn("start", F.col("stop") - length)
    kinds, base = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for i, (kind, is_base, _, _) in enumerate(PATTERNS):
        kinds = F.when(F.col("pattern") == i, F.lit(kind)).otherwise(kinds)
        base = F.when(F.col("pattern") == i, F.lit(is_base)).otherwise(base)
    rows = rows.withColumns({"kind": kinds, "base": base}).where(
        F.col("kind").isNull() | passes(F.col("kind"), F.col("base"), F.col("match")))
    # loose spans give way to the base spans they overlap
    v = Window.partitionBy("row_key").orderBy("start", F.coalesce(F.col("base").cast("int"), F.lit(2)).desc())
    rows = rows.withColumns({
        "last": F.max(F.when(F.col("base"), F.col("stop"))).over(v.rowsBetween(Window.unboundedPreceding, -1)),
        "next": F.min(F.when(F.col("base"), F.col("start"))).over(v.rowsBetween(1, Window.unboundedFollowing))})
    clear = ~F.coalesce(F.col("last") > F.col("start"), F.lit(False)) & ~F.coalesce(F.col("next") < F.col("stop"),
                                                                                    F.lit(False))
    return rows.where(F.col("kind").isNull() | F.col("base") | clear).select(
        "row_key", "doc_id", "kind", "base", "start", "stop", "match", "before", "after")


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, 0).otherwise(2)


def labeled(spans: DataFrame) -> DataFrame:
    """The candidates with a vote of every labeler and the classifier's features."""
    m, kind = F.col("match"), F.col("kind")
    digits, letters = F.length(_digits(m)), F.length(F.regexp_replace(m, "[^A-Za-z]", ""))
    share = digits / F.greatest(F.length(m), F.lit(1))
    one_word = m.rlike("^[A-Za-z0-9+/]+$")
    words = "|".join
    before = F.lower("before")
    left = F.right("before", F.lit(1))
    votes = {
        "shape": _vote(F.col("base") | (kind.isin("phone", "national", "email")) | one_word,
                       (kind == "secret") & m.rlike("[-_/].*[-_/].*[-_/]")),
        "mix": _vote((kind == "secret") & (F.length(m) >= 16) & share.between(0.12, 0.9) & (letters >= 3),
                     (kind == "secret") & ((share < 0.08) | m.rlike("[A-Za-z]{12,}"))),
        "gazetteer": _vote(before.rlike(rf"(?:{words(WORDS_FOR)})[^\n]{{0,8}}$"),
                           before.rlike(rf"(?:{words(WORDS_AGAINST)})[^\n]{{0,8}}$")),
        "neighbours": _vote(left.rlike("[=:\"'(]"), left.rlike(r"[A-Za-z0-9./#]") | F.col("after").rlike("[%/]")),
        "prefix": _vote(m.rlike(PREFIXES), F.lit(False)),
    }
    features = {
        "f_kind": F.concat(kind, F.when(F.col("base"), F.lit("+")).otherwise(F.lit("-"))),
        "f_length": F.least(F.floor(F.length(m) / 8), F.lit(6)).cast("string"),
        "f_digits": F.floor(share * 5).cast("string"),
        "f_case": F.concat(m.rlike("[a-z]").cast("string"), m.rlike("[A-Z]").cast("string")),
        "f_signs": m.rlike("[-_/]").cast("string"),
        "f_left": F.when(left == "", "none").when(left.rlike(r"\s"), "space").when(left.rlike("[=:\"'(]"), "sets")
        .when(left.rlike("[A-Za-z0-9]"), "word").otherwise("sign"),
        "f_right": F.when(F.col("after") == "", "none").when(F.col("after").rlike(r"\s"), "space")
        .when(F.col("after").rlike("[A-Za-z0-9]"), "word").otherwise("sign"),
        "f_word": F.when(votes["gazetteer"] == 1, "for").when(votes["gazetteer"] == 0, "against").otherwise("none"),
    }
    return spans.withColumns(votes).withColumns(features)


FEATURES = ("f_kind", "f_length", "f_digits", "f_case", "f_signs", "f_left", "f_right", "f_word")


def _posterior(model: dict) -> Column:
    """Probability of personal data given the votes, as an expression."""
    logit = F.lit(math.log(model["share"] / (1 - model["share"])))
    for name in LABELERS:
        ratio = [math.log(model[name, 1, v] / model[name, 0, v]) for v in range(3)]
        logit = logit + F.when(F.col(name) == 0, ratio[0]).when(F.col(name) == 1, ratio[1]).otherwise(ratio[2])
    return 1 / (1 + F.exp(-logit))


def fit_labelers(spans: DataFrame, rounds: int = ROUNDS) -> dict:
    """Class share and P(vote | class) of every labeler. Each round is one aggregate over
    the table of vote patterns; one row of sums comes back."""
    patterns = written(spans.groupBy(*LABELERS).agg(F.count("*").alias("n")), "pii-votes").coalesce(1)
    model = {"share": 0.5}
    for name in LABELERS:  # labelers start out better than chance
        model |= {(name, 1, 1): 0.45, (name, 1, 0): 0.1, (name, 1, 2): 0.45,
                  (name, 0, 1): 0.1, (name, 0, 0): 0.45, (name, 0, 2): 0.45}
    for _ in range(rounds):
        p = patterns.withColumn("p", _posterior(model))
        weight = {1: F.col("n") * F.col("p"), 0: F.col("n") * (1 - F.col("p"))}
        sums = p.agg(*(F.coalesce(F.sum(w), F.lit(0.0)).alias(f"all_{c}") for c, w in weight.items()),
                     *(F.coalesce(F.sum(F.when(F.col(name) == v, w)), F.lit(0.0)).alias(f"{name}_{c}_{v}")
                       for name in LABELERS for c, w in weight.items() for v in range(3))).first()
        total = sums["all_1"] + sums["all_0"]
        model = {"share": (sums["all_1"] + 1) / (total + 2)}
        for name in LABELERS:
            for c in (0, 1):
                for v in range(3):
                    model[name, c, v] = (sums[f"{name}_{c}_{v}"] + 1) / (sums[f"all_{c}"] + 3)
    return model


def fit_classifier(spans: DataFrame, model: dict) -> tuple[float, dict]:
    """(log odds of the classes, log ratio of each feature value): naive Bayes on the posteriors.
    The table has a row per feature value, of which there are a few dozen."""
    p = spans.withColumn("p", _posterior(model))
    each = p.select("p", F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).alias("v"))
                                             for f in FEATURES))).alias("x"))
    rows = each.groupBy("x.f", "x.v").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    yes = sum(r.yes for r in rows if r.f == FEATURES[0])
    no = sum(r.no for r in rows if r.f == FEATURES[0])
    table = {}
    for r in rows:
        kinds = sum(x.f == r.f for x in rows)
        table[r.f, r.v] = math.log((r.yes + 1) / (yes + kinds)) - math.log((r.no + 1) / (no + kinds))
    return math.log((yes + 1) / (no + 1)), table


def _score(odds: float, table: dict) -> Column:
    logit = F.lit(odds)
    for f in FEATURES:
        part = F.lit(0.0)
        for (name, value), ratio in table.items():
            if name == f:
                part = F.when(F.col(f) == value, F.lit(ratio)).otherwise(part)
        logit = logit + part
    return 1 / (1 + F.exp(-logit))


def personal_spans(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per span that stays: row_key, doc_id, kind, base, start, stop, match, score; and per
    input row a marker with a null kind."""
    found = written(labeled(candidates(docs)), "pii-spans")
    real = found.where("kind IS NOT NULL")
    model = fit_labelers(real)
    odds, table = fit_classifier(real, model)
    scored = found.withColumn("score", _score(odds, table))
    return scored.where(F.col("kind").isNull() | F.col("base") | (F.col("score") >= threshold)).select(
        "row_key", "doc_id", "kind", "base", "start", "stop", "match", "score")


def personal_data(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per input row: counts of the base kinds, digest of the base spans, and all spans."""
    spans = personal_spans(docs, threshold)
    order = F.lit(len(KINDS))
    for i, kind in enumerate(KINDS):
        order = F.when(F.col("kind") == kind, F.lit(i)).otherwise(order)
    item = F.struct(order.alias("o"), F.col("start"), F.col("stop"), F.col("kind"))

    def joined(rows):
        return F.array_join(F.transform(F.array_sort(rows), lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    counts = [F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in BASE]
    return spans.groupBy("row_key").agg(
        F.first("doc_id").alias("doc_id"), *counts, F.collect_list(F.when(F.col("base"), item)).alias("b"),
        F.collect_list(F.when(F.col("kind").isNotNull(), item)).alias("a")).select(
        "doc_id", *(f"n_{k}" for k in BASE), sha256_hex(joined(F.col("b"))).alias("base_sha256"),
        joined(F.col("a")).alias("spans"))
