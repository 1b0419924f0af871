"""Quality rules as weak supervision, in built-in functions alone.

Each rule votes good (1), bad (-1) or abstains (0). The rows of equal votes are
counted (at most 3^rules patterns, whatever the corpus holds), and
expectation-maximisation over those counts estimates the share of good
documents and how each rule votes on good and on bad ones. A document's
posterior probability of being good then decides, in place of a demand that it
pass all rules.

Counts are exact: repeated windows are found by 64-bit hashes first, which miss
none, and counted by their words where any hash repeats. Null and blank texts
have no words, and all counts are 0. Rows are judged one by one, so repeated
rows and null ids give a result each. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.store import written
from marlstone.llm.text import BLANKS, let, words

#: A window of words that counts as repeated when it is found twice in a text.
WINDOW = 5

#: A word of letters, with an apostrophe or hyphen inside and one mark at its end at most.
PLAIN = "(?<![^\\s])\\p{L}++(?:['-]\\p{L}++)*+[.,;:!?]?(?![^\\s])"


def _repeated(ws: Column) -> Column:
    """Words inside windows that are found twice or more."""

    def hashed(wh: Column) -> Column:
        first = F.slice(wh, F.lit(1), F.size(wh) - (WINDOW - 1))
        return F.transform(first, lambda x, i: F.xxhash64(x, *(F.get(wh, i + k) for k in range(1, WINDOW))))

    def again(c: str) -> Callable[[Column], Column]:
        """Those of a sorted array whose field c a neighbour has too."""
        return lambda g: F.filter(g, lambda x, k: (x[c] == F.get(g, k - 1)[c]) | (x[c] == F.get(g, k + 1)[c]))

    def exact(hashes: Column) -> Column:
        # windows whose hash is found again, and of these the ones whose words are
        marked = let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), (i + 1).alias("i")))), again("h"))
        windows = F.sort_array(F.transform(marked, lambda x: F.struct(F.array_join(F.slice(ws, x["i"], WINDOW), " ").alias("s"), x["i"].alias("i"))))
        places = F.sort_array(F.transform(let(windows, again("s")), lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n"), (p + WINDOW).alias("end"))
        return F.aggregate(places, zero, step, lambda a: a["n"])

    hashes = let(F.transform(ws, lambda w: F.xxhash64(w)), hashed)
    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), exact(h)).otherwise(F.lit(0)))
    return F.when(F.size(ws) >= WINDOW, some).otherwise(F.lit(0)).cast("long")


def counts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The key and what the rules look at, one row per row."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), body.alias("body"))
    lines = F.filter(F.split("body", "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")

    def measured(ws: Column) -> Column:
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            _repeated(ws).alias("n_repeat_words"),
            F.size(F.filter(ws, lambda w, i: w == F.get(ws, i + 1))).cast("long").alias("n_stutters"),
            F.size(F.array_distinct(ws)).cast("long").alias("n_distinct"),
        )

    line_counts = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    out = rows.select(
        "doc_id",
        let(words(F.col("body")), measured).alias("w"),
        line_counts.alias("l"),
        F.regexp_count("body", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("body", F.lit("\\p{Lu}{3,}")).cast("long").alias("n_shouts"),
        F.regexp_count("body", F.lit(PLAIN)).cast("long").alias("n_plain"),
    )
    return out.select("doc_id", "w.*", "l.*", "n_symbols", "n_shouts", "n_plain")


def _vote(bad: Column, good: Column | None = None) -> Column:
    vote = F.when(bad, -1)
    return (vote if good is None else vote.when(good, 1)).otherwise(0)


def rules() -> dict[str, Column]:
    """Each rule's vote over the columns of counts(). Most rules only know what is bad; two also know what is good."""
    share = lambda c, of: F.col(c) / F.greatest(F.col(of), F.lit(1))
    plain, distinct, mean = (share(c, "n_words") for c in ("n_plain", "n_distinct", "word_chars"))
    return {
        "plain": _vote(plain < 0.6, plain > 0.9),
        "variety": _vote(distinct < 0.2, distinct > 0.3),
        "symbols": _vote(share("n_symbols", "n_words") > 0.2),
        "lines": _vote(share("n_dup_lines", "n_lines") > 0.5),
        "windows": _vote(share("n_repeat_words", "n_words") > 0.2),
        "stutters": _vote(share("n_stutters", "n_words") > 0.2),
        "shouts": _vote(share("n_shouts", "n_words") > 0.3),
        "lengths": _vote((F.col("n_words") > 0) & ((mean < 2) | (mean > 20))),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100, prior: float = 0.8, weight: float = 20.0) -> dict:
    """Expectation-maximisation over counts of vote patterns.

    Returns good (share of good documents) and, by rule, the chances of the
    votes -1, 0 and 1 on bad and on good documents. At the start a bad vote is
    strong evidence and any other vote weak, for a bad document breaks few
    rules. weight is the number of made-up documents per rule and class that
    vote as expected; it keeps the classes from trading names and all chances
    above 0.
    """
    n_rules = len(patterns[0][0]) if patterns else 0
    expected = ((0.3, 0.35, 0.35), (0.003, 0.4985, 0.4985))
    chance = [[list(row) for row in expected] for _ in range(n_rules)]
    good = prior
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        seen = [[[weight * p for p in row] for row in expected] for _ in range(n_rules)]
        good_n = weight * prior
        for votes, n in patterns:
            p = n * posterior(votes, good, chance)
            good_n += p
            for j, v in enumerate(votes):
                seen[j][0][v + 1] += n - p
                seen[j][1][v + 1] += p
        before, good = good, good_n / (total + weight)
        chance = [[[x / sum(row) for x in row] for row in rule] for rule in seen]
        if abs(before - good) < 1e-9:
            break
    return {"good": good, "chance": chance}


def logit(p: float) -> float:
    return math.log(p) - math.log1p(-p)


def gains(chance: list[list[float]]) -> list[float]:
    """What the votes -1, 0 and 1 of a rule add to the log odds of being good."""
    return [math.log(g) - math.log(b) for b, g in zip(*chance, strict=True)]


def posterior(votes: tuple[int, ...], good: float, chance: list) -> float:
    odds = logit(good) + sum(gains(c)[v + 1] for v, c in zip(votes, chance, strict=True))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def score(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = 0.5) -> DataFrame:
    """counts() with p_good, the votes, base_failed and kept."""
    named = rules()
    voted = written(counts(docs, text, key).withColumns({f"vote_{k}": v for k, v in named.items()}))
    cols = [f"vote_{k}" for k in named]
    found = voted.groupBy(*cols).count().collect()  # at most 3^rules rows
    model = estimate([(tuple(r[c] for c in cols), r["count"]) for r in sorted(found, key=lambda r: tuple(r[:-1]))])
    odds = F.lit(logit(model["good"]))
    for c, chance in zip(cols, model["chance"], strict=False):  # no chances of an empty table
        bad, none, good = gains(chance)
        odds = odds + F.when(F.col(c) < 0, bad).when(F.col(c) > 0, good).otherwise(none)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = voted.withColumn("p_good", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least))
