"""Quality rules as weak supervision, in DataFrame functions only.

Eight rules vote good (1), bad (-1) or abstain (0) on each document.  A document's class is latent and each rule has an
accuracy, the probability that a vote of it is right.  Expectation-maximisation estimates the accuracies and the share
of good documents from the counts of the vote patterns (at most 3^8 rows, whatever the corpus).  The posterior
probability of "good" replaces a demand that every rule pass.  Rules that find one kind of junk only (capitals,
repetition) never vote good: their silence says little about other kinds.

Word windows inside a document are compared by chained 64-bit hashes.  Defined results: null and empty texts have no
words, fail the base checks and are not kept; repeated rows are judged alike; an empty table gives an empty result;
further columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import cut

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Characters that prose has few of.
ODD = SYMBOLS + "!\"()+/:=@[]^_`{}~0123456789"
#: (name, measure, of what, bad under, good from, good to, bad over): a share votes good in the inner interval (None:
#: never), bad outside the outer one, and the rule abstains in between or without a base.
RULES = (
    ("symbols", "n_symbols", "word_chars", 0.0, 0.0, 0.01, 0.04),
    ("symbol_runs", "n_symbol_runs", "n_words", 0.0, 0.0, 0.04, 0.15),
    ("odd_characters", "n_odd", "n_words", 0.0, 0.0, 0.15, 0.5),
    ("sentence_ends", "n_ends", "n_words", 0.004, 0.01, 0.4, 0.6),
    ("capitals", "n_upper", "word_chars", 0.0, None, None, 0.4),
    ("repeated_words", "n_repeat_words", "n_words", 0.0, None, None, 0.3),
    ("repeated_lines", "n_dup_lines", "n_lines", 0.0, None, None, 0.3),
    ("word_length", "word_chars", "n_words", 2.0, None, None, 14.0),
)
STEPS, PSEUDO = 25, 1.0
#: Where the estimates start, and the interval they are held in: a rule is better than a coin.
START_PRIOR, START_RIGHT = 0.8, 0.9
LEAST_PRIOR, MOST_PRIOR, LEAST_RIGHT, MOST_RIGHT = 0.5, 0.95, 0.6, 0.99


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def with_features(docs: DataFrame, text_col: str = "text", into: str = "_quality") -> DataFrame:
    """`docs` with a struct of the counts that contract and rules need."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    text, as_name = F.coalesce(F.col(f"`{text_col}`"), F.lit("")), lambda c: f"{into}_{c}"
    one = docs.select(
        *names, text.alias(as_name("t")), F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "").alias(as_name("w")),
        F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, SPACE, "") != "").alias(as_name("l")),
    )
    t, w, lines = (F.col(as_name(c)) for c in "twl")
    two = one.select(
        *names, F.transform(w, lambda x: F.xxhash64(x)).alias(as_name("h")),
        F.struct(
            F.size(w).cast("long").alias("n_words"), _without(t, SPACE).cast("long").alias("word_chars"),
            (F.length(t) - _without(t, SYMBOLS)).cast("long").alias("n_symbols"), F.regexp_count(t, F.lit("[#*$%&|<>]+")).cast("long").alias("n_symbol_runs"),
            (F.length(t) - _without(t, ODD)).cast("long").alias("n_odd"), F.regexp_count(t, F.lit("[.!?]+[\\x20\\x09-\\x0D\"]|[.!?]$")).cast("long").alias("n_ends"),
            (F.length(t) - _without(t, UPPER)).cast("long").alias("n_upper"), F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        ).alias(as_name("c")),
    )
    h = F.col(as_name("h"))
    short = F.greatest(F.size(h) - 2, F.lit(0))
    grams = F.zip_with(F.zip_with(F.slice(h, 1, short), F.slice(h, 2, short), lambda a, b: F.xxhash64(a, b)), F.slice(h, 3, short), lambda a, b: F.xxhash64(a, b))
    three = two.select(*names, F.col(as_name("c")), grams.alias(as_name("g")))
    g = F.col(as_name("g"))
    placed = F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    four = three.select(*names, F.col(as_name("c")), F.when(F.size(F.array_distinct(g)) < F.size(g), F.sort_array(placed)).alias(as_name("s")))
    s = F.col(as_name("s"))
    rest = F.size(s) - 1
    twice = F.filter(F.zip_with(F.slice(s, 1, rest), F.slice(s, 2, rest), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))), lambda x: x.isNotNull())
    covered = F.array_distinct(F.flatten(F.transform(F.flatten(twice), lambda i: F.array(i, i + 1, i + 2))))
    return four.select(*names, F.struct(F.col(as_name("c") + ".*"), F.when(s.isNull(), 0).otherwise(F.size(covered)).cast("long").alias("n_repeat_words")).alias(into))


def votes(q: Column) -> Column:
    """The rules' votes, as an array in the order of RULES."""
    def vote(part: str, whole: str, low: float, good_from: float | None, good_to: float | None, high: float) -> Column:
        share = q[part] / q[whole].cast("double")
        cast = F.when(q[whole] == 0, 0).when((share < low) | (share > high), -1)
        return (cast if good_from is None else cast.when((share >= good_from) & (share <= good_to), 1)).otherwise(0)

    return F.array(*(vote(*rule[1:]) for rule in RULES))


def base_failed(q: Column) -> Column:
    return (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])


def _log_odds(prior: str, votes_: str, right: str) -> str:
    return f"aggregate(zip_with({votes_}, {right}, (v, r) -> v * ln(r / (1D - r))), ln({prior} / (1D - {prior})), (x, y) -> x + y)"


def fit(voted: DataFrame, votes_col: str = "votes") -> dict:
    """{"prior", "right"}: the EM estimates, from one aggregation over all rows of `voted`."""
    m = len(RULES)
    patterns = voted.groupBy(F.col(votes_col).alias("v")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("p"))
    clamp = lambda x, least, most: f"least({most}D, greatest({least}D, {x}))"
    total = lambda what: f"aggregate(post, 0D, (acc, x) -> acc + {what})"
    right = f"transform(sequence(0, {m - 1}), j -> " + clamp(f"({total('x.n * CASE x.v[j] WHEN 1 THEN x.p WHEN -1 THEN 1D - x.p ELSE 0D END')} + {PSEUDO}D) / ({total('IF(x.v[j] <> 0, x.n, 0D)')} + {2 * PSEUDO}D)", LEAST_RIGHT, MOST_RIGHT) + ")"
    prior = clamp(f"({total('x.n * x.p')} + {PSEUDO}D) / ({total('x.n')} + {2 * PSEUDO}D)", LEAST_PRIOR, MOST_PRIOR)
    step = f"named_struct('prior', {prior}, 'right', {right})"
    post = f"transform(p, y -> named_struct('v', y.v, 'n', y.n, 'p', 1D / (1D + exp(-({_log_odds('s.prior', 'y.v', 's.right')})))))"
    begin = f"named_struct('prior', {START_PRIOR}D, 'right', array_repeat({START_RIGHT}D, {m}))"
    row = one.select(F.expr(f"aggregate(sequence(1, {STEPS}), {begin}, (s, i) -> transform(array({post}), post -> {step})[0])").alias("s")).first()["s"]
    return {"prior": row["prior"], "right": list(row["right"])}


def probability(votes_: str, model: dict) -> Column:
    right = "array(" + ", ".join(f"{x!r}D" for x in model["right"]) + ")"
    return F.expr(f"1D / (1D + exp(-({_log_odds(repr(model['prior']) + 'D', votes_, right)})))")


def score(docs: DataFrame, text_col: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keys`, the counts, votes, the posterior and `kept` of every row."""
    counted = with_features(docs.select(*(F.col(f"`{k}`") for k in dict.fromkeys((*keys, text_col)))), text_col)
    held = cut(counted.select(*(F.col(f"`{k}`") for k in keys), "_quality.*", votes(F.col("_quality")).alias("votes")))
    model = fit(held)
    q = F.struct(*(F.col(c) for c in ("n_words", "n_repeat_words")))
    return held.withColumn("base_failed", base_failed(q)).withColumn("p_good", probability("votes", model)).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that are kept, with their own columns.

    Texts are counted once: votes are held under two hashes of the row (maps have none and stay out), by which the
    rows meet their verdicts, so that copies of a text do not meet in one task.
    """
    names = docs.columns
    rows = F.struct(*(F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"))
    keyed = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)), F.xxhash64(rows).alias("a"), F.xxhash64(F.lit(1), rows).alias("b"))
    counted = with_features(keyed.select(F.col(f"c{names.index(text_col)}").alias("t"), "a", "b"), "t")
    held = cut(counted.select("a", "b", votes(F.col("_quality")).alias("votes"), base_failed(F.col("_quality")).alias("failed")))
    kept = held.where(~F.col("failed") & (probability("votes", fit(held)) >= 0.5)).select("a", "b")
    return keyed.join(kept, ["a", "b"], "left_semi").select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(names)))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
