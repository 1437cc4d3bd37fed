"""Naive Bayes over term counts, and baselines, as joins and grouped aggregates.

Documents are scored out of sample: with ``fold`` a document's model counts
all documents of the other folds.  Counts are summed once per (term, class,
fold) and each fold's own part is taken off again, so several folds cost one
pass.  A class's score splits into a part that depends on the class alone, one
on the document alone, and gains of the (term, class) pairs that occur, so only
those are joined: a term's gains are one row, and a document's terms meet them
where the document is, but for seldom terms.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import Stat
from ..plans.rows import written
from ..plans.session import CONF_BROADCAST_ROWS, conf_int
from .windows import lagged, running

EPSILON = 10e-10  # fixed value: added to probabilities of the Bernoulli form
SENT_TERMS = 150_000  # terms times folds that are sent to all tasks, those of the most documents
WIDE = 50  # classes up to which a document's sums are columns, one a class
MAX_CLASSES = 10_000  # classes times folds up to which their table is sent to all tasks


def _others(counts: DataFrame, keys: list[str], sums: list[str], folds: list) -> DataFrame:
    """For each key and fold, the sums over all other folds (rows without any are left out)."""
    total = counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
    own = counts.groupBy(*keys, "fold").agg(*[F.sum(c).alias(f"own_{c}") for c in sums])
    # a key seen in one fold only has nothing left there; elsewhere nothing is taken off
    grid = total.withColumn("fold", F.explode(F.array(*[F.lit(f) for f in folds]))).join(own, [*keys, "fold"], "left")
    out = grid.select(*keys, "fold", *[(F.col(c) - F.coalesce(f"own_{c}", F.lit(0))).alias(c) for c in sums])
    return out.filter(" OR ".join(f"{c} > 0" for c in sums))


def _known(rows: DataFrame, classes: DataFrame, folds: list) -> DataFrame:
    """(term, fold, t, d, met, of): each term of the other folds with its counts there, ``of`` an array of (y, n, d, docs) by class.

    ``met`` tells whether the fold itself has the term.  All counts of a term
    meet in one task once; what follows needs no further shuffle.
    """
    counts = rows.groupBy("term", "y", "fold").agg(F.sum("n").alias("n"), F.count(F.lit(1)).cast("double").alias("d"))
    cells = counts.groupBy("term").agg(F.collect_list(F.struct("y", F.col("fold").alias("from"), "n", "d")).alias("cells"))
    grid = cells.withColumn("fold", F.explode(F.array(*[F.lit(f) for f in folds if f is not None]).cast("array<int>")))
    others = F.filter("cells", lambda c: c["y"].isNotNull() & ~c["from"].eqNullSafe(F.col("fold")))
    met = F.exists("cells", lambda c: c["from"].eqNullSafe(F.col("fold")))
    pairs = grid.select("term", "fold", met.alias("met"), F.explode(others).alias("c"))
    pairs = pairs.groupBy("term", "fold", "met", F.col("c.y").alias("y")).agg(F.sum("c.n").alias("n"), F.sum("c.d").alias("d"))
    pairs = pairs.join(classes.select("y", "fold", "docs"), ["y", "fold"])
    return pairs.groupBy("term", "fold", "met").agg(F.sum("n").alias("t"), F.sum("d").alias("d"), F.collect_list(F.struct("y", "n", "d", "docs")).alias("of"))


def _met(rows: DataFrame, gains: DataFrame) -> DataFrame:
    """``rows`` with the gains of their term, null where the other folds do not know it.

    Terms of the most documents are sent to all tasks, so that only rows of
    other terms are shuffled.
    """
    most = conf_int(rows.sparkSession, CONF_BROADCAST_ROWS, SENT_TERMS)
    size = F.floor(F.log2("d"))
    held, least, whole = 0, math.inf, True
    for r in gains.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect():  # one row a power of two
        held += r["count"]
        if held > most:
            whole = False
            break
        least = 2.0 ** r["size"]
    keys = ["term", "fold"]
    if whole:
        return rows.join(F.broadcast(gains), keys, "left")
    if least == math.inf:
        return rows.join(gains, keys, "left")
    often = F.broadcast(gains.filter(F.col("d") >= least))
    seldom = rows.join(often.select(*keys), keys, "left_anti").join(gains.filter(F.col("d") < least), keys, "left")
    return rows.join(often, keys).unionByName(seldom)


def naive_bayes(
    bow: DataFrame,
    docs: DataFrame,
    id_col: str,
    y: str,
    kind: str = "multinomial",
    alpha: float = 1.0,
    fold: str | None = None,
) -> DataFrame:
    """(id, y_pred, score, proba): the class of greatest joint log-likelihood of every document with a term.

    ``kind``: ``multinomial``, ``bernoulli`` (a term is there or not) or
    ``complement`` (the counts of all other classes).  ``fold``: an integer
    column of ``docs``; without it documents are scored by a model that has
    seen them.  Documents with a null class are scored, not learnt from; ties
    go to the greater class; ``proba`` is the class's share of the likelihoods.
    """
    if kind not in ("multinomial", "bernoulli", "complement"):
        raise ValueError(f"unknown kind {kind}")
    about = docs.select(id_col, F.col(y).alias("y"), (F.col(fold).cast("int") if fold else F.lit(0)).alias("fold"))
    folds = [r[0] for r in about.select("fold").distinct().orderBy("fold").limit(1001).collect()] if fold else [-1]
    if len(folds) > 1000:
        raise ValueError(f"{fold} has more than 1000 folds")
    rows = written(bow.select(id_col, "term", F.col("n").cast("double").alias("n")).join(about, id_col), "counts")
    if not fold:  # no document is in the fold that is left out
        rows = rows.withColumn("fold", F.lit(-1))
        about = about.withColumn("fold", F.lit(-1))
    labelled = about.filter("y IS NOT NULL")
    labelled = labelled if fold else labelled.withColumn("fold", F.lit(0))
    classes = written(_others(labelled.groupBy("y", "fold").agg(F.count(F.lit(1)).cast("double").alias("docs")), ["y"], ["docs"], folds), "docs")
    few = classes.count() <= MAX_CLASSES
    known = written(_known(rows if fold else rows.withColumn("fold", F.lit(0)), F.broadcast(classes) if few else classes, folds), "pairs")
    sizes = known.groupBy("fold").agg(F.count(F.lit(1)).alias("v"), F.sum("t").alias("t"))
    pairs = known.select("term", "fold", F.explode("of").alias("c")).select("term", "fold", "c.*")
    totals = pairs.groupBy("y", "fold").agg(F.sum("n").alias("n_c"), F.count(F.lit(1)).alias("terms_c"))
    classes = classes.join(totals, ["y", "fold"], "left").fillna({"n_c": 0.0, "terms_c": 0}).join(sizes, "fold", "left").fillna({"v": 0, "t": 0.0})
    prior = F.log(F.col("docs") / F.sum("docs").over(Window.partitionBy("fold")))
    a = F.lit(float(alpha))
    if kind == "multinomial":
        below = F.log(F.col("n_c") + a * F.col("v"))
        classes = classes.select("fold", "y", prior.alias("at_class"), (math.log(alpha) - below).alias("at_word"), F.lit(0.0).alias("at_term"))
        gain = lambda c: F.log(c["n"] + a) - math.log(alpha)
    elif kind == "bernoulli":
        there, absent = _bernoulli(F.lit(0.0), F.col("docs"), a)
        _, none = _bernoulli(F.col("d"), F.col("docs"), a)
        rest = pairs.groupBy("fold", "y").agg(F.sum(none - absent).alias("rest"))
        classes = classes.join(rest, ["fold", "y"], "left").fillna({"rest": 0.0})
        classes = classes.select("fold", "y", (prior + F.col("v") * absent + F.col("rest")).alias("at_class"), F.lit(0.0).alias("at_word"), (there - absent).alias("at_term"))

        def gain(c):
            one, none = _bernoulli(c["d"], c["docs"], a)
            zero_one, zero_none = _bernoulli(F.lit(0.0), c["docs"], a)
            return one - none - zero_one + zero_none
    else:
        left = F.col("t") + a * F.col("v") - F.col("n_c")
        classes = classes.select("fold", "y", F.lit(0.0).alias("at_class"), F.log(left).alias("at_word"), F.lit(0.0).alias("at_term"))
        gain = lambda c: F.log(F.col("t") + a) - F.log(F.col("t") - c["n"] + a)
    classes = written(classes, "classes")

    # what a document's terms give whatever the class, and to each class
    gains = known.filter("met") if fold else known
    gains = gains.select("term", "fold", "t", "d", F.transform("of", lambda c: F.struct(c["y"].alias("y"), gain(c).alias("gain"))).alias("gains"))
    labels = [r[0] for r in classes.select("y").distinct().orderBy("y").limit(WIDE + 1).collect()]
    wide = len(labels) <= WIDE
    if wide:  # one number a class, by its place
        of = lambda y: F.coalesce(F.get(F.filter("gains", lambda g: g["y"] == y), F.lit(0))["gain"], F.lit(0.0))
        gains = gains.select("term", "fold", "t", "d", *[of(F.lit(y)).alias(f"g{i}") for i, y in enumerate(labels)])
    met = _met(rows.select(id_col, "term", "fold", "n"), gains)
    common = -F.col("n") * F.log(F.coalesce("t", F.lit(0.0)) + a) if kind == "complement" else F.lit(0.0)
    weight = F.lit(1.0) if kind == "bernoulli" else F.col("n")
    about_doc = [F.sum("n").alias("words"), F.count("t").alias("known"), F.sum(common).alias("common")]
    if wide:
        sums = [F.coalesce(F.sum(weight * F.col(f"g{i}")), F.lit(0.0)).alias(f"g{i}") for i in range(len(labels))]
        texts = written(met.groupBy(id_col, "fold").agg(*about_doc, *sums), "sums")
        each = F.array(*[F.struct(F.lit(y).alias("y"), F.col(f"g{i}").alias("won")) for i, y in enumerate(labels)])
        parts = texts.select(id_col, F.explode(each).alias("c")).select(id_col, "c.*") if labels else texts.select(id_col, F.lit(None).alias("y"), F.lit(0.0).alias("won")).limit(0)
    else:
        met = written(met, "met")
        texts = met.groupBy(id_col, "fold").agg(*about_doc)
        parts = met.select(id_col, weight.alias("w"), F.explode("gains").alias("g")).select(id_col, "g.y", (F.col("w") * F.col("g.gain")).alias("won"))
    won = parts.groupBy(id_col, "y").agg(F.sum("won").alias("won"))
    scores = texts.join(F.broadcast(classes) if few else classes, "fold")
    base = F.col("at_class") + F.col("words") * F.col("at_word") + F.col("known") * F.col("at_term") + F.col("common")
    scores = scores.select(id_col, "y", base.alias("base")).join(won, [id_col, "y"], "left")
    scores = scores.select(id_col, "y", (F.col("base") + F.coalesce("won", F.lit(0.0))).alias("score"))
    held = scores.groupBy(id_col).agg(F.max(F.struct("score", "y")).alias("best"), F.collect_list("score").alias("all"))
    share = 1.0 / F.aggregate("all", F.lit(0.0), lambda acc, s: acc + F.exp(s - F.col("best.score")))
    return held.select(id_col, F.col("best.y").alias("y_pred"), F.col("best.score").alias("score"), share.alias("proba"))


def _bernoulli(there: Column, docs: Column, alpha: Column) -> tuple[Column, Column]:
    """Logarithms of the probabilities that a term is in a document of a class, and that it is not."""
    p = (there + alpha) / (docs + 2 * alpha)
    return F.log(EPSILON + p), F.log(EPSILON + (1.0 - p))


def no_change(df: DataFrame, y: str, by, order, name: str = "y_pred") -> DataFrame:
    """Predict the previous label of the key."""
    return lagged(df, {name: (F.col(y), 1, None)}, by, order)


def prior_classifier(df: DataFrame, y: str, by, order, name: str = "y_pred") -> DataFrame:
    """Predict the most frequent earlier label (ties: the label seen first)."""
    from .sequence import running_mode

    d = lagged(df, {"_ordo_prev": (F.col(y), 1, None)}, by, order)
    return running_mode(d, "_ordo_prev", by, order, k=-1, name=name).drop("_ordo_prev")


def statistic_regressor(df: DataFrame, y: str, by, order, how: str = "mean", name: str = "y_pred") -> DataFrame:
    """Predict a running statistic of earlier targets."""
    return running(df, {name: Stat.of(how, y)}, by=by, order=order, lagged=True)
