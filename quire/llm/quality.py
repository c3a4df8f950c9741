"""Quality by weak supervision: rules vote or abstain, expectation-maximisation estimates how right they are, the posterior decides.

Only SQL expressions touch the documents. What is fitted is the histogram of vote patterns, at most 3 ** (number of rules) rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import common as C

_BLANKS = " \t\n\x0b\x0c\r"
_BREAK = r"[\x20\x09-\x0D]+"
#: Fixed value: frequent function words of the languages at hand.
STOP_WORDS = "the of and to in is that for with as und der die das ist von mit zu den ein le la les de et des un une que est el los las por con para del se".split()


def words_of(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _BREAK, -1))


def count_of(text: Column, characters: str) -> Column:
    """How many characters of a class (the inside of a regular expression's brackets) the text has."""
    return F.regexp_count(text, F.lit(f"[{characters}]")).cast("long")


def with_features(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and counts that the rules use.

    n_repeat_words: words in three-word windows that the text has twice or more. Only texts with a repeated window sort them.
    """
    text = F.coalesce("text", F.lit(""))
    a = docs.select("doc_id", text.alias("t"))
    a = a.select(
        "doc_id",
        words_of(F.col("t")).alias("words"),
        F.filter(F.split("t", "\n", -1), lambda x: F.btrim(x, F.lit(_BLANKS)) != "").alias("lines"),
        count_of(F.col("t"), "#*$%&|<>").alias("n_symbols"),
        count_of(F.col("t"), "A-ZÀ-ÖØ-Þ").alias("n_upper"),
        count_of(F.col("t"), "!").alias("n_bangs"),
        count_of(F.col("t"), ".?!").alias("n_stops"),
        count_of(F.col("t"), "0-9").alias("n_digits"),
    )
    n = F.size("words")
    hashes = F.transform("words", lambda w: F.xxhash64(w)).alias("h")
    a = a.select(
        *(c for c in a.columns if c not in ("words", "lines")),
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_intersect("words", F.array(*map(F.lit, STOP_WORDS)))).alias("n_stop_words"),
        hashes,
    )
    m = F.size("h") - 2
    part = lambda i: F.slice("h", F.lit(i), F.greatest(m, F.lit(0)))
    windows = F.zip_with(F.zip_with(part(1), part(2), lambda x, y: F.xxhash64(x, y)), part(3), lambda x, y: F.xxhash64(x, y))
    a = a.select("*", windows.alias("windows"), (F.size(F.array_distinct("h")).cast("long")).alias("n_distinct")).drop("h")
    at = F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    a = a.select("*", F.when(F.size("windows") > F.size(F.array_distinct("windows")), at).alias("sorted")).drop("windows")
    k = F.size("sorted") - 1
    twice = F.zip_with(F.slice("sorted", F.lit(1), k), F.slice("sorted", F.lit(2), k), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])))
    starts = F.flatten(F.filter(twice, lambda x: x.isNotNull()))
    covered = F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))
    return a.select("*", F.when(F.col("sorted").isNull(), F.lit(0)).otherwise(covered).cast("long").alias("n_repeat_words")).drop("sorted")


def base_failed(n_words: Column, n_repeat_words: Column, least: int = 50, most: float = 0.5) -> Column:
    """Too short, or more repeated words than a share of all."""
    return (n_words < least) | (100 * n_repeat_words > round(100 * most) * n_words)


def rules() -> dict[str, Column]:
    """Each rule votes 1 (good), -1 (bad) or 0 (abstains)."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    share = lambda c, of=n: F.col(c) / of

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    chars = F.greatest(F.col("word_chars"), F.lit(1))
    mean = F.col("word_chars") / n
    return {
        "symbols": vote(share("n_symbols") > 0.1, share("n_symbols") < 0.005),
        "capitals": vote(share("n_upper", chars) > 0.3, share("n_upper", chars) < 0.1),
        "bangs": vote(share("n_bangs") > 0.1, share("n_bangs") < 0.01),
        "word_length": vote((mean < 2.5) | (mean > 14), mean.between(3.5, 9)),
        "repeated_lines": vote(F.col("n_dup_lines") > 0.25 * F.greatest(F.col("n_lines"), F.lit(1)), (F.col("n_dup_lines") == 0) & (F.col("n_lines") >= 3)),
        "repeated_words": vote(share("n_repeat_words") > 0.3, (share("n_repeat_words") < 0.05) & (F.col("n_words") >= 50)),
        "sentences": vote((share("n_stops") < 0.005) & (F.col("n_words") >= 50), share("n_stops").between(0.02, 0.35)),
        "function_words": vote((F.col("n_stop_words") == 0) & (F.col("n_words") >= 100), F.col("n_stop_words") >= 5),
        "digits": vote(share("n_digits", chars) > 0.2, share("n_digits", chars) < 0.02),
    }


@dataclass(frozen=True)
class Accuracies:
    """prior: share of good documents. good[i], bad[i]: how often rule i, where it votes, is right about good and bad ones."""

    prior: float
    good: tuple[float, ...]
    bad: tuple[float, ...]

    def weights(self) -> list[tuple[float, float]]:
        """What a vote for good and a vote for bad add to the log-odds."""
        return [(math.log(g / (1 - b)), math.log((1 - g) / b)) for g, b in zip(self.good, self.bad)]


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100, smooth: float = 1.0) -> Accuracies:
    """Expectation-maximisation over (votes, how many documents), from the start that a document without a vote against it is good.

    Rules are taken to be right more often than not (0.5 to 0.999), the prior to lie between 0.02 and 0.98. No patterns: a prior of 0.5
    and accuracies of 0.7.
    """
    m = len(patterns[0][0]) if patterns else len(rules())
    if not patterns:
        return Accuracies(0.5, (0.7,) * m, (0.7,) * m)
    post = [0.9 if min(v) >= 0 else 0.15 for v, _ in patterns]
    acc = None
    for _ in range(rounds):
        total = sum(n for _, n in patterns)
        prior = min(0.98, max(0.02, sum(p * n for p, (_, n) in zip(post, patterns)) / total))
        good, bad = [], []
        for j in range(m):
            s = {(c, v): smooth for c in (0, 1) for v in (-1, 1)}
            for p, (votes, n) in zip(post, patterns):
                if votes[j]:
                    s[1, votes[j]] += p * n
                    s[0, votes[j]] += (1 - p) * n
            clip = lambda x, lo: min(0.999, max(lo, x))
            good.append(clip(s[1, 1] / (s[1, 1] + s[1, -1]), 0.5))
            bad.append(clip(s[0, -1] / (s[0, -1] + s[0, 1]), 0.02))
        new = Accuracies(prior, tuple(good), tuple(bad))
        w, odds = new.weights(), math.log(prior / (1 - prior))
        post = [1 / (1 + math.exp(-max(-500, min(500, odds + sum(w[j][v < 0] for j, v in enumerate(votes) if v))))) for votes, _ in patterns]
        if acc and max(abs(x - y) for x, y in zip((*acc.good, *acc.bad), (*good, *bad))) < 1e-9:
            break
        acc = new
    return new


def score(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs(doc_id, text) with the features, base_failed, each rule's vote, posterior (that it is good) and kept.

    Null and blank texts have no words and fail the base rules. Ties of the posterior with the threshold are kept. Rows are
    judged one by one, so repeated rows and ids get equal verdicts. An empty table gives no rows.
    """
    made = C.cut(with_features(docs))  # numbers only; so the texts are read once
    names = list(rules())
    voted = made.select("*", base_failed(F.col("n_words"), F.col("n_repeat_words")).alias("base_failed"), *(r.alias(f"vote_{k}") for k, r in rules().items()))
    code = sum((F.col(f"vote_{k}") + 1) * 3**i for i, k in enumerate(names))
    histogram = voted.where("not base_failed").groupBy(code.alias("code")).count().collect()  # at most 3 ** len(names) rows
    patterns = [(tuple(int(c) // 3**i % 3 - 1 for i in range(len(names))), int(n)) for c, n in sorted(histogram)]
    acc = estimate(patterns)
    odds = F.lit(math.log(acc.prior / (1 - acc.prior)))
    for k, (for_good, for_bad) in zip(names, acc.weights()):
        odds = odds + F.when(F.col(f"vote_{k}") == 1, for_good).when(F.col(f"vote_{k}") == -1, for_bad).otherwise(0.0)
    out = voted.withColumn("posterior", 1 / (1 + F.exp(-odds)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score() keeps, all columns; joined by doc_id, so rows that share an id stay if one of them is kept."""
    return docs.join(score(docs, threshold).where("kept").select("doc_id").distinct(), "doc_id", "left_semi").select(docs.columns)
