"""Quality rules whose cutoffs come with a guarantee, in DataFrame expressions only.

Each rule gives a document an integer level; a cutoff rejects what is above it. Labelled documents are dealt into two halves.
On the holdout, for each stratum and rule, cutoffs are tested from the mildest to the strictest: one passes if the exact
binomial probability of so few false rejections, were their rate at its limit, is at most the allowed error; the first that
does not pass ends the sequence, so a rule costs one test however many cutoffs it has. The error is divided by strata and rules
(Bonferroni), the limit on false rejections by rules (union bound). Among those that passed, the other half picks the one that
rejects most bad documents, the mildest of equals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, durable, only, shielded

#: Levels by rule, as SQL on the counts; integers, so that any engine gives the same.
RULES = {
    "symbols": "least(100, (100 * n_symbols + greatest(word_chars, 1) - 1) div greatest(word_chars, 1))",
    "repeats": "(100 * n_repeat_words + greatest(n_words, 1) - 1) div greatest(n_words, 1)",
    "duplicates": "(100 * n_dup_lines + greatest(n_lines, 1) - 1) div greatest(n_lines, 1)",
    "long_words": "least(300, (10 * word_chars) div greatest(n_words, 1))",
    "short_words": "300 - least(300, (10 * word_chars) div greatest(n_words, 1))",
}
BASE = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def let(value, body):
    """``body`` of a value that is computed once, even where ``body`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated(words):
    """How many words lie in three-word windows that occur twice or more in the list.

    Windows are compared by a 64-bit hash, sorted with their places; time n log n, whatever repeats.
    """

    def covered(places):
        step = lambda p, i: F.coalesce(F.least(F.lit(3), F.get(places, i + 1) - p), F.lit(3))
        return F.aggregate(F.transform(places, step), F.lit(0), lambda s, x: s + x)

    def places(rows):
        same = lambda r, i: F.coalesce(F.get(rows, i - 1)["h"] == r["h"], F.lit(False)) | F.coalesce(F.get(rows, i + 1)["h"] == r["h"], F.lit(False))
        return F.sort_array(F.filter(F.transform(rows, lambda r, i: F.when(same(r, i), r["p"])), lambda p: p.isNotNull()))

    def of(hashes):
        rows = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(rows, lambda r: let(places(r), covered)))

    hash_ = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(F.transform(F.sequence(F.lit(0), F.size(words) - 3), hash_), of))


def counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the counts of each whole text (null: none) as longs, and base_failed. Columns of these names are replaced."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    found = lambda w: F.struct(F.size(w).alias("n_words"), repeated(w).alias("n_repeat_words"))
    by_line = lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))
    made = (
        df.withColumn("_words", let(F.regexp_extract_all(t, F.lit(f"({WORD})"), F.lit(1)), found))
        .withColumn("_lines", let(lines, by_line))
        .withColumns({
            "n_words": F.col("_words.n_words").cast("long"),
            "word_chars": F.length(F.translate(t, " \t\n\x0b\f\r", "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
            "n_dup_lines": F.col("_lines.n_dup_lines").cast("long"),
            "n_repeat_words": F.col("_words.n_repeat_words").cast("long"),
            "n_lines": F.col("_lines.n_lines").cast("long"),
        })
    )
    return made.drop("_words", "_lines").withColumn("base_failed", F.expr(BASE))


def log_factorial(n):
    """Natural logarithm of n!, exact to about 1e-13 relative."""
    x = n.cast("double")
    small = F.aggregate(F.sequence(F.lit(0), F.least(n, F.lit(32)).cast("int")), F.lit(0.0), lambda s, i: s + F.when(i > 1, F.ln(i.cast("double"))).otherwise(0.0))
    large = x * F.ln(x) - x + 0.5 * F.ln(2 * F.pi() * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n <= 32, small).otherwise(large)


def tail(k, n, rate: float):
    """P(Bin(n, rate) <= k), or 1 where k is at or above its mean: terms from k down, those left out bounded from above by a geometric row."""
    odds = (1 - rate) / rate
    x, at = k.cast("double"), n.cast("double")
    top = F.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k) + x * F.ln(F.lit(rate)) + (at - x) * F.ln(F.lit(1 - rate)))
    steps = F.sequence(F.lit(1), F.least(k, F.ceil(20 * F.sqrt(at * rate)) + 60).cast("int"))
    ratio = lambda i: (x - i + 1) / (at - x + i) * odds
    add = lambda s, i: F.struct((s["p"] * ratio(i)).alias("p"), (s["sum"] + s["p"] * ratio(i)).alias("sum"), ratio(i + 1).alias("r"))
    start = F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("sum"), F.lit(0.0).alias("r"))
    total = F.aggregate(steps, start, add, lambda s: s["sum"] + s["p"] * s["r"] / F.greatest(1 - s["r"], F.lit(1e-9)))
    return F.when(x >= at * rate, F.lit(1.0)).when(k == 0, F.exp(at * F.ln(F.lit(1 - rate)))).otherwise(F.least(F.lit(1.0), top * total))


def fit(labelled: DataFrame, stratum: str = "lang", good: str = "quality", key: str = "doc_id", risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """Cutoffs: rows (stratum, rule, cutoff, n_good, n_false, bound) for each pair that has one with a guarantee.

    With probability 1 - ``error`` over the holdout, the rules together reject at most ``risk`` of the good documents of every
    stratum. ``labelled`` has the counts, the stratum (null is one of its own), 0 or 1 in ``good`` (others are left out) and ``key``,
    whose third-lowest bit deals the halves. Documents that fail the base are rejected anyway and left out. Few labels mean no cutoff.
    """
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.expr(level).cast("int").alias("level")) for name, level in RULES.items()])
    side = F.coalesce(F.col(key).cast("long").bitwiseAND(F.lit(4)) == 4, F.lit(False))
    rows = labelled.where(~F.col("base_failed") & F.col(good).isin(0, 1)).select(F.coalesce(stratum, F.lit("")).alias("stratum"), F.col(good).alias("_good"), side.alias("_held"), F.explode(rules).alias("_r"))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    levels = rows.groupBy("stratum", F.col("_r.rule").alias("rule"), F.col("_r.level").alias("level")).agg(
        one(F.col("_held") & (F.col("_good") == 1)).alias("held"), one(~F.col("_held") & (F.col("_good") == 0)).alias("bad")
    )
    # A cutoff just under each level that occurs: what is at that level or above is rejected. At most 301 rows a window.
    above = Window.partitionBy("stratum", "rule").orderBy(F.desc("level"))
    every = Window.partitionBy("stratum", "rule")
    milder = every.orderBy(F.desc("cutoff"))
    steps = levels.select(
        "stratum", "rule", (F.col("level") - 1).alias("cutoff"), F.sum("held").over(above).alias("n_false"), F.sum("held").over(every).alias("n_good"), F.sum("bad").over(above).alias("n_bad")
    )
    strata = steps.select("stratum").distinct().agg(F.count("*").alias("_strata"))
    tested = steps.crossJoin(F.broadcast(strata)).withColumn("bound", tail(F.col("n_false"), F.col("n_good"), risk / len(RULES)))  # one row
    passed = tested.withColumn("_passed", F.min(F.when(F.col("bound") <= error / (len(RULES) * F.col("_strata")), 1).otherwise(0)).over(milder))
    best = every.orderBy(F.desc("n_bad"), F.desc("cutoff"))
    return passed.where("_passed = 1 and n_bad > 0").withColumn("_n", F.row_number().over(best)).where("_n = 1").select("stratum", "rule", "cutoff", "n_good", "n_false", "bound")


def judge(counted: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """``counted`` with kept: false where the base failed or a level is above its stratum's cutoff."""
    limits = cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_limits")).withColumnRenamed("stratum", "_stratum")
    above = F.lit(False)
    for name, level in RULES.items():
        above = above | F.coalesce(F.expr(level) > F.col("_limits")[name], F.lit(False))
    joined = counted.join(limits, F.coalesce(stratum, F.lit("")) == F.col("_stratum"), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~above).drop("_limits", "_stratum")


def rules(df: DataFrame, labels: DataFrame, stratum: str = "lang", keep: list[str] | None = None, **options: float) -> DataFrame:
    """Columns ``keep`` (all, unless given) of ``df``, the counts, base_failed and kept.

    ``labels`` has doc_id and quality; a row of ``df`` with several labels counts with each. Null texts have no words and fail
    the base. The counted rows are written once to the shared folder; only cutoffs, a few rows a stratum, are joined to them.
    """
    keep = list(df.columns if keep is None else keep)
    keep = [c for c in keep if c not in (*COUNTS, "base_failed", "kept")]
    rows, _, to = shielded(df)
    work = rows.select(*{to[c]: 0 for c in keep}, F.col(to["doc_id"]).alias("_doc_id"), F.col(to[stratum]).alias("_lang"), F.col(to["text"]).alias("_whole"))
    counted = durable(counts(work, "_whole").drop("_whole"))
    marks = only(labels, "doc_id", "quality").withColumnRenamed("doc_id", "_doc")
    small = counted.select("_doc_id", "_lang", "base_failed", *COUNTS)
    cutoffs = durable(fit(small.join(marks, F.col("_doc_id") == F.col("_doc")), "_lang", "quality", "_doc_id", **options).coalesce(1))
    return judge(counted, cutoffs, "_lang").select(*[F.col(to[c]).alias(c) for c in keep], *COUNTS, "base_failed", "kept")
