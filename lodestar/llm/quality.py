"""Quality rules: fixed base rules and robust multivariate outliers; DataFrame functions only.

For each language and source the minimum-covariance-determinant estimate of the transformed statistics
of its documents is sought: from several deterministic starts concentration steps go on until the
determinant falls no more, and the estimate of the least determinant stays. Documents are rejected by
their Mahalanobis distance from it. Groups too small for an estimate take that of their language, else
of their source, else of all documents. Quantiles inside a group come from histograms and moments from
sums, both aggregated before the shuffle, so a hot source never meets in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACES, saved, table

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30

#: Share of a group's rows that the estimate rests on, and the tail of the chi-square law that is cut off.
HALF = 0.75
TAIL = 1e-9
#: Concentration steps of every start, and the most that the best start then takes.
FIRST_STEPS, MOST_STEPS = 2, 40
#: Groups of fewer rows that passed the base rules are judged by a wider estimate: their own would mean nothing.
LEAST_ROWS = 50
#: Least standard deviation of each transformed statistic, so that a statistic that is constant in a group does not reject by itself.
FLOORS = (0.5, 0.15, 0.3, 0.3, 0.3)
D = len(FLOORS)


def chi2_cdf(x: float, k: int) -> float:
    a, y = k / 2, x / 2
    term = total = 1 / a
    n = 1
    while term > total * 1e-16:
        term *= y / (a + n)
        total += term
        n += 1
    return total * math.exp(-y + a * math.log(y) - math.lgamma(a)) if x > 0 else 0.0


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return hi


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words covered by windows of WINDOW words that occur twice or more."""
    n = F.size(words)

    def pair(x: Column, step: int, m: Column) -> Column:
        """Hashes of each element with the one `step` later; m: how many there are."""
        return F.zip_with(F.slice(x, 1, m), F.slice(x, 1 + step, m), lambda a, b: F.xxhash64(a, b))

    w1 = F.transform(words, lambda w: F.xxhash64(w))
    w2 = _let(w1, lambda x: pair(x, 1, n - 1))
    w4 = _let(w2, lambda x: pair(x, 2, n - 3))
    w8 = _let(w4, lambda x: pair(x, 4, n - 7))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def of_sorted(s: Column) -> Column:
            last = F.zip_with(s, F.concat(F.slice(s, 2, F.size(s)), F.array(F.lit(None).cast("struct<h:bigint,i:int>"))), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))

            def of_same(e: Column) -> Column:
                twice = F.zip_with(e, F.concat(F.array(F.lit(False)), F.slice(e, 1, F.size(e) - 1)), lambda a, b: a | b)
                starts = F.sort_array(F.array_compact(F.zip_with(s, twice, lambda a, t: F.when(t, a["i"]))))
                steps = lambda p: F.aggregate(F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.lit(WINDOW), b - a)), F.lit(WINDOW), lambda x, y: x + y)
                return _let(starts, steps)

            return _let(last, of_same)

        return _let(ordered, of_sorted)

    repeats = _let(w8, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(n < WINDOW + 1, F.lit(0)).otherwise(repeats)


def statistics(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every whole text (null: none)."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(t, "[\\x20\\x09-\\x0D]+"), "")
    of_words = _let(words, lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r")))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    d = docs.select(
        *keep,
        of_words.alias("_w"),
        F.length(F.translate(t, SPACES, "")).alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
    )
    return d.select(*keep, F.col("_w.n").cast("long").alias("n_words"), *(F.col(c).cast("long") for c in ("word_chars", "n_symbols", "n_dup_lines")), F.col("_w.r").cast("long").alias("n_repeat_words"))


def _transformed() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log1p(F.col("n_words").cast("double")),
        F.log1p(F.col("word_chars") / n),
        F.sqrt(100.0 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double")),
        F.log1p(F.col("n_dup_lines").cast("double")),
        F.sqrt(10.0 * F.col("n_repeat_words") / n),
    ]


_X = [f"x{i}" for i in range(D)]
_LOW = [(i, j) for i in range(D) for j in range(i + 1)]
_PART = ["g_lang", "g_source"]


def _distance() -> Column:
    """Squared Mahalanobis distance: the squared length of the inverse Cholesky factor times (x - mean)."""
    return F.expr(" + ".join(f"power({' + '.join(f'v{i}{j} * (x{j} - m{j})' for j in range(i + 1))}, 2)" for i in range(D)))


def _factor(c: DataFrame) -> DataFrame:
    """From the columns c_ij of covariances the inverse v_ij of their Cholesky factors, element by element, and the log of their determinant.

    Variances below a floor are the floor; what the earlier statistics leave of one stays above a quarter of it.
    """
    new = []
    for j in range(D):
        for i in range(j, D):
            rest = "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            if i == j:
                new.append(f"sqrt(greatest(greatest(c{i}{i}, {FLOORS[i] ** 2}D){rest}, {FLOORS[i] ** 2 / 4}D)) as l{i}{i}")
            else:
                new.append(f"(c{i}{j}{rest}) / l{j}{j} as l{i}{j}")
    for i in range(D):
        new.append(f"1D / l{i}{i} as v{i}{i}")
        for j in range(i):
            new.append(f"(0D{''.join(f' - l{i}{k} * v{k}{j}' for k in range(j, i))}) / l{i}{i} as v{i}{j}")
    new.append(f"round(2 * ({' + '.join(f'ln(l{i}{i})' for i in range(D))}), 9) as log_det")
    return c.selectExpr(*c.columns, *new)


_MODEL = [*(f"m{i}" for i in range(D)), *(f"v{i}{j}" for i, j in _LOW)]


def _starts(rows: DataFrame) -> DataFrame:
    """(model, start, _MODEL): three deterministic first guesses about the medians of each model's rows.

    The scatter is that of the quartile ranges alone, of the hyperbolic tangents of the scaled rows, or of
    their directions. Quartiles come from histograms.
    """
    long = rows.select("model", F.explode(F.array(*(F.struct(F.lit(i).alias("k"), F.floor(F.col(x) * 100).alias("b")) for i, x in enumerate(_X)))).alias("e"))
    h = long.groupBy("model", "e.k", "e.b").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("model", "k")
    h = h.withColumn("cum", F.sum("n").over(w.orderBy("b"))).withColumn("all", F.sum("n").over(w))
    at = lambda q: F.min(F.when(F.col("cum") >= q * F.col("all"), F.col("b"))) / 100.0
    q = h.groupBy("model", "k").agg(at(0.25).alias("lo"), at(0.5).alias("mid"), at(0.75).alias("hi"))
    spread = saved(q.groupBy("model").agg(
        *(F.max(F.when(F.col("k") == i, F.col("mid"))).alias(f"m{i}") for i in range(D)),
        *(F.max(F.when(F.col("k") == i, F.greatest((F.col("hi") - F.col("lo")) / 1.349, F.lit(FLOORS[i])))).alias(f"s{i}") for i in range(D)),
    ))
    z = rows.join(spread, "model").selectExpr("model", *(f"(x{i} - m{i}) / s{i} as z{i}" for i in range(D)), *(f"tanh(z{i}) as t{i}" for i in range(D)), f"greatest({' + '.join(f'z{i} * z{i}' for i in range(D))}, 1e-9D) as length")
    r = z.groupBy("model").agg(*(F.expr(f"covar_pop(t{i}, t{j}) as t{i}{j}") for i, j in _LOW), *(F.expr(f"avg(z{i} * z{j} / length) as d{i}{j}") for i, j in _LOW))
    forms = (lambda i, j: f"{float(i == j)}D", "t{}{}".format, "d{}{}".format)
    guesses = ", ".join(f"named_struct('start', {k}, {', '.join(f'{chr(39)}c{i}{j}{chr(39)}, {form(i, j)} * s{i} * s{j}' for i, j in _LOW)})" for k, form in enumerate(forms))
    c = spread.join(r, "model").selectExpr("model", *(f"m{i}" for i in range(D)), f"inline(array({guesses}))")
    return saved(_factor(c).select("model", "start", *_MODEL))


def _bin(x: Column) -> Column:
    return F.floor(F.log2(x + 1e-9) * 32)


def _step(rows: DataFrame, model: DataFrame) -> DataFrame:
    """One concentration step of each model and start: mean and covariance of the HALF of its rows that is nearest to the last ones.

    Distances are ordered in classes of two percent, and the last class is taken whole.
    """
    near = rows.join(model, "model").select("model", "start", *_X, _bin(_distance()).alias("b"))
    h = near.groupBy("model", "start", "b").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("model", "start")
    h = h.withColumn("cum", F.sum("n").over(w.orderBy("b"))).withColumn("all", F.sum("n").over(w))
    cut = h.groupBy("model", "start").agg(F.min(F.when(F.col("cum") >= HALF * F.col("all"), F.col("b"))).alias("cut"))
    half = near.join(cut, ["model", "start"]).where("b <= cut")
    # moments about the coordinates as they are: logarithms and roots of ratios, all of one magnitude
    m = half.groupBy("model", "start").agg(*(F.expr(f"round(avg(x{i}), 9) as m{i}") for i in range(D)), *(F.expr(f"avg(x{i} * x{j}) as s{i}{j}") for i, j in _LOW))
    # the nearest rows spread less than all: the factor makes the estimate right for a normal law
    wider = HALF / chi2_cdf(chi2_quantile(HALF, D), D + 2)
    m = m.selectExpr("model", "start", *(f"m{i}" for i in range(D)), *(f"round((s{i}{j} - m{i} * m{j}) * {wider!r}D, 9) as c{i}{j}" for i, j in _LOW))
    return _factor(m).select("model", "start", "log_det", *_MODEL)


def least_determinant(rows: DataFrame, first_steps: int = FIRST_STEPS, most_steps: int = MOST_STEPS) -> DataFrame:
    """(model, log_det, _MODEL) for each `model` of rows (model, x0..): the estimate of the least determinant.

    All starts take first_steps; the one of the least determinant then concentrates until its
    determinant falls no more (by a thousandth, at most most_steps times), and of its last two estimates
    the one with the smaller determinant stays.
    """
    now = _starts(rows)
    for _ in range(first_steps):
        now = saved(_step(rows, now))
    best = F.row_number().over(W.partitionBy("model").orderBy("log_det", "start"))
    now = now.withColumn("_n", best).where("_n = 1").drop("_n")
    done: DataFrame | None = None
    for _ in range(most_steps):
        nxt = _step(rows, now)
        old = now.select("model", *(F.col(c).alias("o_" + c) for c in ["start", "log_det", *_MODEL]))
        both = nxt.join(old, "model").withColumn("fell", F.col("o_log_det") - F.col("log_det"))
        pick = lambda c: F.when(F.col("fell") > 0, F.col(c)).otherwise(F.col("o_" + c)).alias(c)
        both = saved(both.select("model", "fell", *(pick(c) for c in ["start", "log_det", *_MODEL])))
        settled = both.where("fell <= 0.001").drop("fell")
        done = settled if done is None else done.union(settled)
        now = both.where("fell > 0.001").drop("fell")
        if now.isEmpty():
            break
    out = now if done is None else done.union(now)
    return saved(out.select("model", "log_det", *_MODEL))


def _name(lang: Column, source: Column) -> Column:
    """The name of the model of a language and a source, encoded as below; a star for all."""
    return F.to_json(F.array(lang, source))


def _judges(passed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g_lang, g_source, model) of the model that judges each group, and of all the models that each group's rows belong to.

    A group's own model, or if fewer than LEAST_ROWS rows passed the base rules there its language's,
    its source's, or that of all rows (whatever their number). One row a group.
    """
    star = F.lit("*")
    n = saved(passed.groupBy(*_PART).agg(F.count(F.lit(1)).alias("own")))
    by_lang, by_source = (n.groupBy(g).agg(F.sum("own").alias(k)) for g, k in zip(_PART, ("of_lang", "of_source")))
    names = [_name(F.col("g_lang"), F.col("g_source")), _name(F.col("g_lang"), star), _name(star, F.col("g_source")), _name(star, star)]
    enough = lambda c: F.col(c) >= LEAST_ROWS
    judge = F.when(enough("own"), names[0]).when(enough("of_lang"), names[1]).when(enough("of_source"), names[2]).otherwise(names[3])
    judges = saved(n.join(by_lang, "g_lang").join(by_source, "g_source").select(*_PART, judge.alias("model")))
    parts = n.select(*_PART, F.explode(F.array(*names)).alias("model")).join(judges.select("model").distinct(), "model", "left_semi")
    return judges, saved(parts.select(*_PART, "model"))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", tail: float = TAIL) -> DataFrame:
    """(doc_id, the statistics, base_failed, kept) for each row of docs.

    kept is false if a base rule failed, else the verdict of the estimate that judges the row's group,
    which rests on rows that passed the base rules. Every row gets a verdict: groups with fewer than
    LEAST_ROWS such rows are judged by their language's, source's or the whole estimate. Null languages
    and sources are groups like others; repeated rows count each. Only the four columns are read. No
    rows: an empty result.
    """
    coded = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    d = docs.select(F.col(id_col).alias("doc_id"), coded(lang_col).alias("g_lang"), coded(source_col).alias("g_source"), F.col(text_col).alias("_text"))
    s = statistics(d, "_text", ["doc_id", *_PART])
    s = s.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    s = saved(s.select("*", *(x.alias(n) for x, n in zip(_transformed(), _X))))
    judges, parts = _judges(s.where(~F.col("base_failed")).select(*_PART))
    rows = saved(s.where(~F.col("base_failed")).select(*_PART, *_X).join(parts, _PART).select("model", *_X))
    models = judges.join(least_determinant(rows), "model").select(*_PART, *_MODEL)
    all_rows = s.join(models, _PART, "left")
    fits = F.coalesce(_distance() <= chi2_quantile(1 - tail, D), F.lit(True))  # only groups whose rows all failed a base rule have no model
    return all_rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & fits).alias("kept"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))
