"""Quality by weak supervision, in DataFrame operations only.

Simple rules vote good (1), bad (0) or abstain (null). Expectation-maximisation over the histogram of vote patterns (at
most 3^rules rows, whatever the corpus size) estimates how often each rule is right on good and on bad documents, and a
document's posterior probability of being good replaces the demand that it passes every rule.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from roadframe.llm.common import let, words_of, written

WINDOW = 5
#: rule -> (feature, bad when, good when); a document between both, or without the feature, makes the rule abstain.
RULES = {
    "symbols": ("n_symbols / n_words", "> 0.2", "< 0.05"),
    "runs": ("n_run_chars / n_words", "> 0.2", "< 0.05"),
    "pipes": ("n_pipes / n_words", "> 0.1", "< 0.02"),
    "alnum": ("n_alnum / word_chars", "< 0.9", "> 0.95"),
    "repeats": ("n_repeat_words / n_words", "> 0.15", "< 0.1"),
    "lines": ("n_dup_lines / n_lines", "> 0.5", "< 0.3"),
    "variety": ("n_distinct / n_words", "< 0.15", "> 0.35"),
    "capitals": ("n_upper / n_alnum", "> 0.4", "< 0.15"),
    "shouting": ("n_exclaim / n_words", "> 0.3", "< 0.05"),
    "length": ("word_chars / n_words", "> 7", "< 6.3"),
    "endings": ("n_ended / n_lines", "< 0.2", "> 0.6"),
}
#: Rounds of EM; share of good documents and how often a rule is right on good and on bad ones at the start; the least
#: that a rule may come down to (rules are taken to be better than chance); posterior from which a document is kept.
ROUNDS, PRIOR, START, FLOOR, THRESHOLD = 10, 0.9, (0.97, 0.5), (0.9, 0.2), 0.5
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_alnum", "n_exclaim", "n_ended", "n_pipes", "n_run_chars")


def _repeat_words(w: Column) -> Column:
    """Words that stand in a window of WINDOW words found twice or more."""
    grams = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.array_join(F.slice(w, i, WINDOW), " "))

    def covered(starts: Column) -> Column:
        gain = F.transform(starts, lambda v, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - v, F.lit(WINDOW))))
        return F.aggregate(gain, F.lit(0), lambda a, x: a + x)

    def twice(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["g"] == x["g"], F.lit(False))
        found = F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return let(F.sort_array(F.transform(found, lambda x: x["i"])), covered)

    def counted(g: Column) -> Column:
        tagged = F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i")))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(F.sort_array(tagged), twice))

    return F.when(F.size(w) < WINDOW, F.lit(0)).otherwise(let(grams, counted)).cast("bigint")


def _count(text: Column, keep_out: str) -> Column:
    """Characters of a class."""
    return (F.length(text) - F.length(F.regexp_replace(text, keep_out, ""))).cast("bigint")


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with `_q_` columns for the FEATURES of every whole text; a null text has no words, lines or symbols."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select("*", text.alias("_q_text")).withColumn("_q_words", words_of(F.col("_q_text")))
    d = d.withColumn("_q_lines", F.filter(F.split("_q_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    w, lines, t = F.col("_q_words"), F.col("_q_lines"), F.col("_q_text")
    made = {
        "n_words": F.size(w), "word_chars": F.length(F.array_join(w, "")), "n_symbols": _count(t, r"[#*$%&|<>]"),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)), "n_repeat_words": _repeat_words(w),
        "n_lines": F.size(lines), "n_distinct": F.size(F.array_distinct(w)), "n_upper": _count(t, r"\p{Lu}"),
        "n_exclaim": _count(t, "!"), "n_ended": F.size(F.filter(lines, lambda x: x.rlike(r"[.!?:;\")][\x20\x09-\x0D]*\z"))),
        "n_alnum": F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]+", "")), "n_pipes": _count(t, r"\|"),
        "n_run_chars": _count(t, r"##+|\*\*+|\$\$+|%%+|&&+|!!+"),
    }
    return d.select(*docs.columns, *[c.cast("bigint").alias(f"_q_{n}") for n, c in made.items()])


def base_failed(prefix: str = "_q_") -> Column:
    n, r = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < 10) | (100 * r > 20 * n)


def _votes(prefix: str = "_q_") -> dict[str, Column]:
    out = {}
    for rule, (ratio, bad, good) in RULES.items():
        a, b = (f"{prefix}{x.strip()}" for x in ratio.split("/"))
        value = f"(CAST({a} AS DOUBLE) / nullif({b}, 0))"
        out[rule] = F.expr(f"CASE WHEN {value} {bad} THEN 0 WHEN {value} {good} THEN 1 END")
    return out


def _log_odds(params: dict, vote: dict[str, Column]) -> Column:
    total = F.lit(math.log(params["prior"] / (1 - params["prior"])))
    for rule, v in vote.items():
        g, b = params[rule]
        total = total + F.when(v == 1, F.lit(math.log(g / (1 - b)))).when(v == 0, F.lit(math.log((1 - g) / b))).otherwise(F.lit(0.0))
    return total


def _posterior(odds: Column) -> Column:
    return 1 / (1 + F.exp(-odds))


def estimate(votes: DataFrame, rounds: int = ROUNDS) -> dict:
    """EM over a table with one column per rule: {"prior": share of good, rule: (right on good, right on bad)}.

    Only the histogram of patterns is read in each round, and one row of sums comes back. Shares are smoothed by one
    count and rounded to 6 decimals, so the order of summation cannot change them.
    """
    params: dict = {"prior": PRIOR} | dict.fromkeys(RULES, START)
    names = list(RULES)
    hist = written(votes.groupBy(*names).agg(F.count(F.lit(1)).cast("double").alias("_n")))
    for _ in range(rounds):
        h = hist.withColumn("_p", _posterior(_log_odds(params, {r: F.col(r) for r in names})))
        good, bad = F.col("_n") * F.col("_p"), F.col("_n") * (1 - F.col("_p"))
        sums = [F.sum(good).alias("good"), F.sum("_n").alias("all")]
        for r in names:
            sums += [F.sum(F.when(F.col(r) == 1, good)).alias(f"{r}_gr"), F.sum(F.when(F.col(r).isNotNull(), good)).alias(f"{r}_g"),
                     F.sum(F.when(F.col(r) == 0, bad)).alias(f"{r}_br"), F.sum(F.when(F.col(r).isNotNull(), bad)).alias(f"{r}_b")]
        s = h.agg(*sums).first().asDict()
        share = lambda a, b, least=1e-6: min(max(round(((s[a] or 0.0) + 1) / ((s[b] or 0.0) + 2), 6), least), 1 - 1e-6)
        params = {"prior": share("good", "all")} | {r: (share(f"{r}_gr", f"{r}_g", FLOOR[0]), share(f"{r}_br", f"{r}_b", FLOOR[1])) for r in names}
    return params


def _judged(table: DataFrame, rounds: int) -> DataFrame:
    """A table with `_q_` features, judged by rules that are weighed over all rows that pass the base rule."""
    d = written(table)
    params = estimate(d.filter(~base_failed()).select(*[v.alias(r) for r, v in _votes().items()]), rounds)
    d = d.withColumn("_q_posterior", _posterior(_log_odds(params, _votes())))
    return d.withColumn("_q_failed", base_failed()).withColumn("_q_kept", ~F.col("_q_failed") & (F.col("_q_posterior") >= THRESHOLD))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior.

    A document that fails the base rule is dropped whatever its votes. A null or blank text has no words and fails.
    Every row gives a row, repeated ones too; null ids stay null. Other columns of `docs` are ignored, so their names
    cannot clash.
    """
    d = _judged(features(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")), "_text").drop("_text"), rounds)
    return d.select("doc_id", *[F.col(f"_q_{n}").alias(n) for n in FEATURES[:5]], F.col("_q_failed").alias("base_failed"),
                    F.col("_q_kept").alias("kept"), F.col("_q_posterior").alias("posterior"))


def keep_good(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """The rows of `docs` that are kept, with all their columns."""
    return _judged(features(docs, text_col), rounds).filter("_q_kept").select(*docs.columns)
