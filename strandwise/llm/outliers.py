"""Quality rules by robust multivariate outliers.

Every document gets counts and, from these, a vector of transformed statistics.  For each language and
source the minimum covariance determinant (MCD) of the vectors is estimated by C-steps: the share ``keep`` of
documents nearest to the last estimate gives the next mean and covariance.  There are two starts (median
deviations, and these with the correlations of spatial signs); steps go on until no group's determinant
falls by more than a hundredth (``steps`` at most), and the start with the smaller determinant holds.  After scaling to the
chi-square median and one reweighting, documents beyond a chi-square quantile in Mahalanobis distance are rejected.

Everything is estimated over all documents: a C-step is one aggregate of moments by (group, start, distance
bin), combined before the shuffle, so a group of any size is a few hundred rows by the time it meets.  The bin in
which the share is reached counts in part, so the share is met exactly, while which of that bin's documents
are in it is not resolved.  Every statistic has a least deviation (``STATS``), added to the covariance, so that
a statistic that is constant in a group doesn't reject all that differ.

Small groups have weak estimates of their own: with n documents an estimate weighs n against ``PRIOR_ROWS`` of its
language's, which is pooled from its sources' and weighs likewise against the pool of all.  This holds for every
size, without a switch.

A null text counts as empty: no words, base_failed.  Null languages and sources are groups like others.
Repeated rows count as often as they occur, rows with null or repeated ids are judged each by its own text, and
texts of any length are read whole.  Ties at the bound are kept.  An empty table gives an empty result.
Whole rows are carried as a struct, so names of other columns can't clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import beside_rows, cut

SYMBOLS = b"#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Transformed statistics, and the least standard deviation that each is given.
STATS = {"length": 0.5, "word_len": 0.1, "symbols": 0.05, "dup_lines": 0.1, "repeats": 0.16, "capitals": 0.06, "variety": 0.08}
BINS = 16  # of squared distance, for each doubling
#: Documents that a pooled estimate counts as, beside a group's own.
PRIOR_ROWS = 50


def text_counts(text: str | None, window: int = 3) -> tuple[int, ...]:
    """The five base counts, then capitals, letters and distinct words."""
    if not text:
        return (0,) * 8
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - (len(raw) - sum(map(len, words)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    index: dict[bytes, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
    repeated = 0
    if n >= window:
        key, v = ids[: n - window + 1], len(index)
        for k in range(1, window):  # pairs are renumbered, so keys stay small however many distinct words there are
            if k > 1:
                key = np.unique(key, return_inverse=True)[1]
            key = key * v + ids[k : n - window + 1 + k]
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        if same.any():
            twice = np.zeros(len(key), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = np.zeros(n, bool)
            for k in range(window):
                covered[k : len(key) + k] |= twice
            repeated = int(covered.sum())
    upper = sum(map(str.isupper, text)) if not text.isascii() else len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, upper, len(lines), len(index)


def statistics(c: np.ndarray) -> np.ndarray:
    """Rows of counts to rows of transformed statistics."""
    n, chars, symbols, dup, rep, upper, lines, distinct = np.maximum(c.astype(float).T, 0)
    n1, c1 = np.maximum(n, 1), np.maximum(chars, 1)
    return np.stack([np.log1p(n), np.log((chars + 1) / n1), np.sqrt(symbols / c1), np.sqrt(dup / np.maximum(lines, 1)), np.sqrt(rep / n1), np.sqrt(upper / c1), np.log((distinct + 1) / (n1 + 1))], 1)


def document_statistics(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(_row, base counts, statistics) of every row; one map pass."""

    def make():
        def run(texts):
            c = np.array([text_counts(t) for t in texts], np.int64).reshape(-1, 8)
            x = statistics(c)
            return [*[pa.array(c[:, k]) for k in range(5)], *[pa.array(x[:, k]) for k in range(len(STATS))]]

        return run

    return beside_rows(docs, text_col, ", ".join([*(f"{x} long" for x in BASE), *(f"{x} double" for x in STATS)]), make, carry)


def chi2_quantile(p: int, z: float) -> float:
    """Quantile of chi-square with p degrees of freedom at the normal score z (Wilson and Hilferty)."""
    return p * (1 - 2 / (9 * p) + z * (2 / (9 * p)) ** 0.5) ** 3


def _squared_distance(names: list[str], m: str = "m", inverse: str = "P"):
    p = len(names)
    d = [F.col(x) - F.col(m)[k] for k, x in enumerate(names)]
    return sum((F.col(inverse)[k * p + j] * d[k] * d[j] * (1 if j == k else 2) for k in range(p) for j in range(k, p)), F.lit(0.0))


def _inverted(p: int):
    """(P, logdet) of covariances given as rows in one array; vectorised over groups."""

    @F.pandas_udf("struct<P: array<double>, logdet: double>")
    def run(cov: pd.Series) -> pd.DataFrame:
        a = np.array(cov.tolist(), float).reshape(-1, p, p)
        return pd.DataFrame({"P": list(np.linalg.inv(a).reshape(-1, p * p)), "logdet": np.linalg.slogdet(a)[1]})

    return run


def _symmetric(entry, p: int):
    """An array of p * p columns from those of its upper triangle."""
    return F.array(*[entry(min(k, j), max(k, j)) for k in range(p) for j in range(p)])


def raw_mcd(rows: DataFrame, group: str = "g", floors: dict[str, float] = STATS, keep: float = 0.75, steps: int = 8):
    """The estimates with the least determinant by group, and two functions: one that reweights estimates, one that scales."""
    names, least = list(floors), [float(x) for x in floors.values()]
    p = len(names)
    pairs = [(k, j) for k in range(p) for j in range(k, p)]
    invert = _inverted(p)
    rows = rows.select(F.col(group).alias("g"), *names)
    middle = cut(rows.groupBy("g").agg(*[F.percentile_approx(x, 0.5, 1000).alias(f"o{k}") for k, x in enumerate(names)], F.count("*").alias("n")), "medians")
    y = [F.col(x) - F.col(f"o{k}") for k, x in enumerate(names)]
    deviations = rows.join(middle, "g").groupBy("g").agg(*[F.percentile_approx(F.abs(y[k]), 0.5, 1000).alias(f"_d{k}") for k in range(p)])
    scaled_by = [F.sqrt(F.pow(1.4826 * F.col(f"_d{k}"), 2) + F.lit(least[k] ** 2)).alias(f"d{k}") for k in range(p)]
    middle = cut(middle.join(deviations, "g").select("g", "n", *[f"o{k}" for k in range(p)], *scaled_by), "deviations")
    unit = [y[k] / F.col(f"d{k}") for k in range(p)]
    length = F.greatest(sum((u * u for u in unit), F.lit(0.0)), F.lit(1e-12))
    signs = rows.join(middle, "g").groupBy("g").agg(*[(F.avg(unit[k] * unit[j] / length) + F.lit(1e-3 if k == j else 0.0)).alias(f"c{k}_{j}") for k, j in pairs])
    # Two starts: deviations alone, and with the correlations of spatial signs.
    own = lambda k, j: F.col(f"d{k}") * F.col(f"d{j}")
    plain = _symmetric(lambda k, j: own(k, j) if k == j else F.lit(0.0), p)
    tilted = _symmetric(lambda k, j: own(k, j) * F.col(f"c{k}_{j}") / F.sqrt(F.col(f"c{k}_{k}") * F.col(f"c{j}_{j}")), p)
    starts = middle.join(signs, "g").select("g", "n", F.array(*[F.col(f"o{k}") for k in range(p)]).alias("m"), F.posexplode(F.array(plain, tilted)).alias("start", "cov"))
    est = cut(starts.select("g", "start", "n", "m", invert("cov").alias("x")).select("g", "start", "n", "m", "x.P", "x.logdet", F.lit(False).alias("settled")), "mcd")

    def binned(est):
        # One bin for each sixteenth of a doubling; those below 2^-20 are one.
        return rows.join(est.drop("n"), "g").withColumn("bin", F.floor(F.log2(_squared_distance(names) + F.lit(2.0**-20)) * BINS).cast("int"))

    by = W.partitionBy("g", "start")

    def stepped(est, reweight=False, first=False):
        d = [F.col(x) - F.col("m")[k] for k, x in enumerate(names)]
        sums = [*[F.sum(d[k]).alias(f"s{k}") for k in range(p)], *[F.sum(d[k] * d[j]).alias(f"c{k}_{j}") for k, j in pairs]]
        moments = binned(est).groupBy("g", "start", "bin").agg(F.count("*").alias("n"), *sums)
        upto = F.sum("n").over(by.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow))
        # The bin that reaches the share counts in part.
        part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.sum("n").over(by) * F.lit(keep) - upto + F.col("n")) / F.col("n")))
        if reweight:
            part = F.greatest(part, (F.col("bin") <= F.lit(int(np.floor(np.log2(chi2_quantile(p, 1.96)) * BINS)))).cast("double"))
        kept = moments.withColumn("_part", part).groupBy("g", "start").agg(
            F.sum("n").alias("n"), F.sum(F.col("n") * F.col("_part")).alias("h"), *[F.sum(F.col(c) * F.col("_part")).alias(c) for c in (*[f"s{k}" for k in range(p)], *[f"c{k}_{j}" for k, j in pairs])]
        )
        h = F.col("h")
        cov = _symmetric(lambda k, j: F.col(f"c{k}_{j}") / h - F.col(f"s{k}") * F.col(f"s{j}") / h / h + F.lit(least[k] ** 2 if k == j else 0.0), p)
        new = kept.join(est.select("g", "start", "m", F.col("logdet").alias("before")), ["g", "start"])
        new = new.select("g", "start", "n", F.array(*[F.col("m")[k] + F.col(f"s{k}") / h for k in range(p)]).alias("m"), "before", invert(cov).alias("x"))
        # The starts are no subsets' determinants, so the first step settles nothing.
        settled = F.lit(False) if first else F.col("x.logdet") >= F.col("before") - 1e-2
        return cut(new.select("g", "start", "n", "m", "x.P", "x.logdet", settled.alias("settled")), "mcd")

    def scaled(est):
        """The median squared distance becomes that of chi-square."""
        counts = binned(est).groupBy("g", "start", "bin").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(by.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow))
        middle = counts.withColumn("_upto", upto).withColumn("_all", F.sum("n").over(by)).groupBy("g", "start").agg(F.min(F.when(2 * F.col("_upto") >= F.col("_all"), F.col("bin"))).alias("bin"))
        c = F.greatest(F.pow(F.lit(2.0), (F.col("bin") + 0.5) / F.lit(BINS)) / F.lit(chi2_quantile(p, 0.0)), F.lit(1.0))
        return cut(est.join(middle, ["g", "start"]).withColumn("_c", c).withColumn("P", F.transform("P", lambda x: x / F.col("_c"))).select(est.columns), "mcd")

    for k in range(steps):
        est = stepped(est, first=k == 0)
        if not est.filter("NOT settled").limit(1).count():
            break
    best = est.groupBy("g").agg(F.min_by(F.struct("start", "n", "m", "P", "logdet", "settled"), F.struct("logdet", "start")).alias("x")).select("g", "x.*")
    return cut(best, "mcd"), lambda est: stepped(est, reweight=True), scaled


def mcd_estimates(rows: DataFrame, group: str = "g", floors: dict[str, float] = STATS, **how) -> DataFrame:
    """(g, n, m, P): robust centre and inverse covariance of the columns ``floors`` by group, scaled and reweighted."""
    est, reweighted, scaled = raw_mcd(rows, group, floors, **how)
    return scaled(reweighted(scaled(est))).select("g", "n", "m", "P")


def _pooled(est: DataFrame, by: list[str], p: int) -> DataFrame:
    """Pooled estimate (pn, pm, pS) of the estimates (n, m, S) in each group of ``by``, their spread included."""
    n = F.col("n")
    mean = [F.sum(n * F.col("m")[k]) / F.sum(n) for k in range(p)]
    second = [F.sum(n * (F.col("S")[k * p + j] + F.col("m")[k] * F.col("m")[j])) / F.sum(n) for k in range(p) for j in range(p)]
    out = est.groupBy(*by).agg(F.sum(n).alias("pn"), F.array(*mean).alias("pm"), F.array(*second).alias("_second"))
    return out.withColumn("pS", F.array(*[F.col("_second")[k * p + j] - F.col("pm")[k] * F.col("pm")[j] for k in range(p) for j in range(p)])).drop("_second")


def _shrunk(n, own: str, pool: str):
    return F.zip_with(own, pool, lambda a, b: (n * a + F.lit(float(PRIOR_ROWS)) * b) / (n + F.lit(float(PRIOR_ROWS))))


def shrunk_estimates(est: DataFrame, of_lang: DataFrame, p: int) -> DataFrame:
    """(g, m, P): each group's estimate drawn towards its language's, and that towards the pool of all.

    ``of_lang`` has the language g1 of each group g.  A group of n rows weighs n against ``PRIOR_ROWS``.
    """

    inverse = lambda c: _inverted(p)(c)["P"]
    est = cut(est.select("g", "n", "m", inverse("P").alias("S")).join(of_lang, "g"), "covariances")
    everything = _pooled(est, [], p).select(F.col("pm").alias("am"), F.col("pS").alias("aS"))  # one row
    lang = _pooled(est, ["g1"], p).crossJoin(F.broadcast(everything))
    lang = lang.select("g1", _shrunk(F.col("pn"), "pm", "am").alias("lm"), _shrunk(F.col("pn"), "pS", "aS").alias("lS"))
    both = est.join(lang, "g1").select("g", _shrunk(F.col("n"), "m", "lm").alias("m"), _shrunk(F.col("n"), "S", "lS").alias("S"))
    return cut(both.select("g", "m", inverse("S").alias("P")), "shrunk")


def _judged(docs: DataFrame, text_col: str, lang_col: str, source_col: str, z: float, carry: list[str] | None) -> DataFrame:
    """(_row, base counts, base_failed, kept, distance2) of every row.  Rows are written once; none is shuffled after."""
    rows = document_statistics(docs, text_col, carry)
    rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col("_row")[c].cast("string")), F.lit("-"))
    rows = cut(rows.withColumn("g1", named(lang_col)).withColumn("g", F.to_json(F.struct(named(lang_col).alias("l"), named(source_col).alias("s")))), "statistics")
    usable = rows.filter(~F.col("base_failed")).select("g", "g1", *STATS)
    of_lang = usable.select("g", "g1").distinct()
    est = shrunk_estimates(mcd_estimates(usable.drop("g1")), of_lang, len(STATS))
    judged = rows.join(est, "g", "left").withColumn("distance2", _squared_distance(list(STATS)))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance2"), F.lit(0.0)) <= F.lit(chi2_quantile(len(STATS), z)))
    return judged.withColumn("kept", kept)


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", z: float = 6.0) -> DataFrame:
    """Counts of every row with base_failed, its squared distance, and kept.

    base_failed: under 50 words, or over half of the words in repeated windows.  Estimates come from all
    rows that pass; a row that passes is kept if its squared distance is at most the chi-square quantile
    at the normal score ``z``.
    """
    judged = _judged(docs, text_col, lang_col, source_col, z, list(dict.fromkeys([id_col, lang_col, source_col])))
    return judged.select(F.col("_row")[id_col].alias("doc_id"), *BASE, "base_failed", "kept", "distance2")


def kept_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", z: float = 6.0) -> DataFrame:
    """The rows of ``docs`` that ``quality_verdicts`` keeps, each judged by its own text."""
    return _judged(docs, text_col, lang_col, source_col, z, None).filter("kept").select("_row.*")
