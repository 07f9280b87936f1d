"""Quality rules as weak supervision, in DataFrame operations only.

Each rule votes good, votes bad or abstains on a document. Rules overlap: several look at one fault in different ways, so
that votes can contradict one another. Expectation-maximisation over the histogram of vote patterns (at most 3 to the number
of rules, whatever the corpus) estimates how often each rule votes which way on good and on bad documents, and a document is
kept if its posterior probability of being good is at least a threshold. A rule that is often right counts for much, one that
says the same of both classes for nothing, and an abstention for as much as it tells the classes apart.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, let, materialize

SPLIT = "[ \\t\\n\\x0B\\f\\r]+"
#: Fixed values of the contract.
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20
SYMBOLS = "[#*$%&|<>]"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPLIT), "")


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of WINDOW words that the text has twice or more."""
    none = F.array().cast("array<bigint>")
    keys = let(words, lambda w: F.when(F.size(w) > WINDOW, F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))).otherwise(none))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(pairs, lambda s: F.filter(s, lambda x, k: (F.when(k > 0, F.get(s, k - 1)["h"]) == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])))
        starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
        return let(starts, lambda q: F.aggregate(F.transform(q, lambda v, k: F.least(F.lit(WINDOW), F.coalesce(F.get(q, k + 1) - v, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b))

    return let(keys, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))).cast("long")


def features(docs: DataFrame) -> DataFrame:
    """docs, which has a column text and none whose name starts with __q_, with the base counts and what the rules look at."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    words = words_of(F.col("text"))
    counted = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    listed = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return docs.withColumns(
        {
            "__q_words": counted,
            "__q_lines": listed,
            "__q_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "__q_upper": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"),
            "__q_shouts": F.regexp_count(text, F.lit("!")).cast("long"),
            "__q_signs": F.regexp_count(text, F.lit(r"[^\p{L}\s]")).cast("long"),
            "__q_wordless": F.regexp_count(text, F.lit(r"(?<!\S)[^\p{L}\s]+(?!\S)")).cast("long"),
            "__q_stops": F.regexp_count(text, F.lit(r"[.!?](?=\s|$)")).cast("long"),
        }
    )


@dataclass(frozen=True)
class Rule:
    """Votes bad at ``bad`` and beyond, good up to ``good``, and abstains between."""

    name: str
    value: Callable[[], Column]
    good: float
    bad: float


def _share(part: str, whole: str) -> Callable[[], Column]:
    return lambda: F.col(part) / F.greatest(F.col(whole), F.lit(1))


RULES = (
    Rule("symbols_per_word", _share("__q_symbols", "__q_words.n_words"), 0.066, 0.2),
    Rule("symbols_per_character", _share("__q_symbols", "__q_words.word_chars"), 0.01, 0.03),
    Rule("signs", _share("__q_signs", "__q_words.word_chars"), 0.1, 0.25),
    Rule("wordless", _share("__q_wordless", "__q_words.n_words"), 0.05, 0.2),
    Rule("word_length", lambda: F.abs(F.col("__q_words.word_chars") / F.greatest(F.col("__q_words.n_words"), F.lit(1)) - 5.5), 1.25, 2.0),
    Rule("sentences", lambda: 0.04 - _share("__q_stops", "__q_words.n_words")(), 0.0, 0.025),
    Rule("upper_case", _share("__q_upper", "__q_words.word_chars"), 0.1, 0.3),
    Rule("shouting", _share("__q_shouts", "__q_words.n_words"), 0.05, 0.2),
    Rule("repeated_words", _share("__q_words.n_repeat_words", "__q_words.n_words"), 0.05, 0.2),
    Rule("repeated_lines", _share("__q_lines.n_dup_lines", "__q_lines.n_lines"), 0.1, 0.4),
)


def vote(rule: Rule) -> Column:
    value = rule.value()
    return F.when(value >= rule.bad, -1).when(value <= rule.good, 1).otherwise(0)


#: Documents of each class that estimates begin from besides those seen, and how their votes (bad, abstained, good) are
#: spread: so few that they only say which class is which, and that nothing is impossible.
LITTLE = 2.0
PRIOR = {"good": (0.1, 0.3, 0.6), "bad": (0.4, 0.3, 0.3)}


@dataclass(frozen=True)
class Model:
    """share: of good documents; good and bad: for each rule, how often it votes (bad, abstains, good) on documents of the
    class; rounds: how many it took."""

    share: float
    good: tuple[tuple[float, float, float], ...]
    bad: tuple[tuple[float, float, float], ...]
    rounds: int = 0

    def weights(self) -> list[list[float]]:
        """The evidence of each rule's votes (bad, abstained, good) for a good document, as log odds."""
        return [[math.log(g / b) for g, b in zip(good, bad, strict=True)] for good, bad in zip(self.good, self.bad, strict=True)]

    def posterior(self, votes: list[Column]) -> Column:
        """The probability of being good."""
        each = [F.when(v < 0, w[0]).when(v > 0, w[2]).otherwise(w[1]) for v, w in zip(votes, self.weights(), strict=True)]
        return 1 / (1 + F.exp(-reduce(add, each, F.lit(math.log(self.share / (1 - self.share))))))


def fit(patterns: list[tuple[tuple[int, ...], float]], n_rules: int, rounds: int = 500, tolerance: float = 1e-7) -> Model:
    """patterns: votes (-1, 0 or 1 of each rule) and how many documents have them: distinct, so 3 ** n_rules at most.

    At the start a document is good by the share of its votes that say so. Votes are held to be independent within a class.
    Rates are estimated freely: only a little prior keeps them off zero. Ends when no document's probability moves by more
    than the tolerance, and warns if one still does after the last round."""
    ways = [[v + 1 for v in votes] for votes, _ in patterns]
    counts = [n for _, n in patterns]
    probability = [(w.count(2) + 0.5) / (w.count(2) + w.count(0) + 1.0) for w in ways]
    total, model, moved = sum(counts), None, 1.0
    for k in range(1, rounds + 1):
        rates = {}
        for name in ("good", "bad"):
            seen = [[LITTLE * p for p in PRIOR[name]] for _ in range(n_rules)]
            for w, n, p in zip(ways, counts, probability, strict=True):
                part = n * (p if name == "good" else 1 - p)
                for own, way in zip(seen, w, strict=True):
                    own[way] += part
            rates[name] = tuple(tuple(x / sum(own) for x in own) for own in seen)
        share = (sum(n * p for n, p in zip(counts, probability, strict=True)) + 1) / (total + 2)
        model = Model(share, rates["good"], rates["bad"], k)
        weights, base = model.weights(), math.log(share / (1 - share))
        odds = [base + sum(own[way] for own, way in zip(weights, w, strict=True)) for w in ways]
        new = [1 / (1 + math.exp(-max(-700.0, min(700.0, x)))) for x in odds]
        moved = max((abs(a - b) for a, b in zip(new, probability, strict=True)), default=0.0)
        probability = new
        if moved <= tolerance:
            return model
    warnings.warn(f"probabilities still move by {moved:.2g} after {rounds} rounds", stacklevel=2)
    return model


def judged(docs: DataFrame, threshold: float = 0.5, keep_text: bool = True) -> DataFrame:
    """docs, all columns as they came, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    quality (the posterior) and kept, where docs has no such column of its own (else the operator's stands).

    A null or empty text has no words and fails the base; a text of any length counts whole. Repeated rows are judged
    alike and each is returned. An empty table gives no rows. The counts are written once to the shared folder: they feed both the estimate and the verdicts.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", "kept"]
    own = [c for c in docs.columns if c not in added and (keep_text or c != "text")]
    # what the table has besides is held together, so that no name of it can clash with one of these
    base = features(docs.select(F.struct(*own).alias("row"), "text"))
    voted = base.withColumns({f"__v{i}": vote(r).cast("tinyint") for i, r in enumerate(RULES)})
    stored = materialize(voted.select("row", "__q_words.*", "__q_lines.n_dup_lines", F.col("__q_symbols").alias("n_symbols"), *[f"__v{i}" for i in range(len(RULES))]))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    # what fails the base is decided; the model is of the rest
    names = [f"__v{i}" for i in range(len(RULES))]
    counted = stored.where(~failed).groupBy(*names).agg(F.count(F.lit(1)).cast("double").alias("n"))
    # one job; a row for each pattern of votes, so 3 ** rules rows at most
    model = fit([(tuple(r[c] for c in names), r["n"]) for r in counted.orderBy(*names).collect()], len(RULES))
    posterior = F.round(model.posterior([F.col(c) for c in names]), 6)
    judged_ = stored.withColumns({"base_failed": failed, "quality": posterior}).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
    return judged_.select("row.*", *added)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep_text=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
