"""Quality rules as weak supervision.

Each rule votes good or bad on a text, or abstains.  Expectation-maximisation
over the vote patterns of all rows estimates how often each rule is right about
good and about bad texts, without labels; a text's posterior probability of
being good, given its votes, replaces the demand to pass every rule.  There are
at most 3 ** rules patterns, so the estimation works on their counts, which is
the same as on the rows.

Null and empty texts have no words and fail the base rule; very long texts are
read whole.  A posterior of exactly the threshold counts as kept.  Rows with equal
ids get a row each.  An empty table gives no rows.  Other columns do not matter.
Five-word windows are compared by 64-bit hashes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatlens.llm import native, shared

WINDOW = 5
GOOD, BAD, ABSTAIN = 1, 0, 2
#: EM ends when no parameter moves by more than TOLERANCE, or after ROUNDS.
ROUNDS, TOLERANCE = 2000, 1e-9
#: Bounds of the share of good texts.
LEAST_PRIOR, MOST_PRIOR = 1e-4, 1 - 1e-4
#: A word of letters with at most one mark behind it.
PLAIN_WORD = r"(?<![^\x20\x09-\x0D])[\p{L}’'-]++[.,;:!?]?(?![^\x20\x09-\x0D])"
#: Bounds of an estimated accuracy: rules are better than chance and never infallible.
LEAST, MOST = 0.55, 0.99


def _repeated(w: Column) -> Column:
    """Words that lie in a window found twice or more."""
    def covered(hashes: Column) -> Column:
        """Only texts with an equal pair of windows are sorted."""
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        found = native.bound(pairs, lambda s: F.sort_array(F.transform(
            F.filter(native.indices(F.size(s)), lambda j: (F.get(s, j)["h"] == F.get(s, j - 1)["h"])
                     | (F.get(s, j)["h"] == F.get(s, j + 1)["h"])),
            lambda j: F.get(s, j)["i"])))
        total = F.aggregate(found, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
                            lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"),
                                                    p.alias("last")), lambda acc: acc["n"])
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), total).otherwise(0)
    windows = F.transform(native.indices(F.size(w) - (WINDOW - 1)),
                          lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    return native.bound(windows, covered).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the counts the rules look at, for every row."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"),
                        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                        F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
                        _repeated(w).alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"),
                        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return docs.select(
        "doc_id", native.bound(native.words(text), of_words).alias("w"), native.bound(lines, of_lines).alias("l"),
        native.count_of(text, "#*$%&|<>").alias("n_symbols"), native.count_of(text, "A-Z").alias("n_upper"),
        native.count_of(text, ".?").alias("n_stops"), native.count_of(text, "!").alias("n_cries"),
        native.count_of(text, r"\p{L}").alias("n_letters"),
        F.regexp_count(text, F.lit(PLAIN_WORD)).cast("long").alias("n_plain")).select(
        "doc_id", "w.*", "l.*", "n_symbols", "n_upper", "n_stops", "n_cries", "n_letters", "n_plain")


def _vote(bad: Column, good: Column | None = None) -> Column:
    vote = F.when(bad, BAD)
    return (vote if good is None else vote.when(good, GOOD)).otherwise(ABSTAIN)


def votes() -> dict[str, Column]:
    """Each rule's vote, from the columns of ``measured``.

    Most rules look for one fault; a text without it may have others, so they
    abstain.  Three tell what good texts look like and vote either way.
    """
    n, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    length, plain, stops = chars / n, F.col("n_plain") / n, F.col("n_stops") / n
    enough = n >= 20
    return {
        "word_length": _vote((length < 2.5) | (length > 12), length.between(3.5, 9)),
        "symbols": _vote(F.col("n_symbols") / n > 0.3),
        "equal_lines": _vote(F.col("n_dup_lines") / lines > 0.3),
        "repeated_words": _vote(enough & (F.col("n_repeat_words") / n > 0.2)),
        "upper_case": _vote(F.col("n_upper") / chars > 0.4),
        "variety": _vote(enough & (F.log1p("n_distinct") / F.log1p(n) < 0.6)),
        "sentences": _vote(enough & (stops == 0), stops.between(0.02, 0.5)),
        "cries": _vote(F.col("n_cries") / n > 0.3),
        "letters": _vote(F.col("n_letters") / chars < 0.75),
        "plain_words": _vote(plain < 0.6, plain > 0.9),
    }


def estimate(patterns: dict[tuple[int, ...], int], rules: int, rounds: int = ROUNDS) -> tuple[float, list[list[float]]]:
    """Share of good texts, and per rule its accuracy on bad and on good texts, by EM from pattern counts.

    Rules that abstain say nothing.  Starts from accuracy 0.8 and an even split, and goes on until
    prior and accuracies all stand still.
    """
    prior, accuracy = 0.5, [[0.8, 0.8] for _ in range(rules)]
    total = sum(patterns.values())
    for _ in range(rounds if total else 0):
        good = 0.0
        right = [[0.0, 0.0] for _ in range(rules)]
        voted = [[0.0, 0.0] for _ in range(rules)]
        for pattern, n in patterns.items():
            p = 1 / (1 + math.exp(-log_odds(pattern, prior, accuracy)))
            good += n * p
            for r, vote in enumerate(pattern):
                if vote != ABSTAIN:
                    for label, share in ((BAD, 1 - p), (GOOD, p)):
                        voted[r][label] += n * share
                        right[r][label] += n * share * (vote == label)
        before = [prior, *(a for pair in accuracy for a in pair)]
        prior = min(max(good / total, LEAST_PRIOR), MOST_PRIOR)
        accuracy = [[min(max((right[r][y] + 1) / (voted[r][y] + 1.25), LEAST), MOST) for y in (BAD, GOOD)]
                    for r in range(rules)]
        if max(abs(a - b) for a, b in zip(before, [prior, *(a for pair in accuracy for a in pair)])) < TOLERANCE:
            break
    return prior, accuracy


def weights(accuracy: list[float]) -> dict[int, float]:
    """What a rule's vote adds to the log odds of good."""
    bad, good = accuracy
    return {GOOD: math.log(good / (1 - bad)), BAD: math.log((1 - good) / bad), ABSTAIN: 0.0}


def log_odds(pattern: tuple[int, ...], prior: float, accuracy: list[list[float]]) -> float:
    return math.log(prior / (1 - prior)) + sum(weights(a)[v] for a, v in zip(accuracy, pattern))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judged(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Counts, base verdict, posterior and verdict of every row."""
    shared.prepare(docs.sparkSession)
    rows = shared.staged(measured(docs), "rule-counts")
    rules = votes()
    counted = rows.select(*[v.alias(k) for k, v in rules.items()]).groupBy(*rules).agg(F.count("*").alias("n"))
    patterns = {tuple(r[:-1]): r.n for r in counted.collect()}      # at most 3 ** 10
    prior, accuracy = estimate(patterns, len(rules))
    odds = F.lit(math.log(prior / (1 - prior)))
    for vote, a in zip(rules.values(), accuracy):
        w = weights(a)
        odds = odds + F.when(vote == GOOD, w[GOOD]).when(vote == BAD, w[BAD]).otherwise(0.0)
    posterior = 1 / (1 + F.exp(-odds))
    return rows.withColumn("base_failed", base_failed()).withColumn("posterior", posterior).withColumn(
        "kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
