"""Operator 9: quality classifier as a sparse ensemble of rules, compiled into column expressions.

A random forest is grown on statistics of labelled texts; each path from a root to a node is a rule, a conjunction of bounds. A lasso
logistic regression weighs the rules and leaves few; those become one Spark expression over the statistics, which are
expressions over the text too, so scoring a corpus runs without Python.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.llm.shared import COMMON, fresh, held_out, table

#: Labelled documents that training may use, the first by a seeded hash of the id.
SAMPLE = 6000
Rule = tuple[tuple[str, bool, float], ...]


def statistics(docs: DataFrame, name: str = "q_") -> DataFrame:
    """Adds the struct ``name`` of statistics of ``text`` (null: empty), all doubles; an empty text has zeros. ``name`` must be no column's."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words_, lines_ = fresh(docs, f"{name}words_", f"{name}lines_")
    out = docs.withColumn(words_, F.filter(F.split(text, r"\s+"), lambda w: w != "")).withColumn(lines_, F.split(text, "\n"))
    n = F.size(words_).cast("double")
    per_word = lambda c: F.when(n > 0, c / n).otherwise(0.0)
    each = lambda pattern: F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("double")
    values = {
        "log_words": F.log1p(n),
        "distinct": per_word(F.size(F.array_distinct(words_))),
        "word_length": per_word(F.length(text).cast("double")),
        "common": per_word(F.size(F.filter(words_, lambda w: F.lower(w).isin(COMMON)))),
        "upper": per_word(each(r"\p{Lu}")),
        "symbols": per_word(each(r"[#$%&*|~^<>{}\[\]=_+@\\/]")),
        "exclaim": per_word(each(r"!")),
        "stops": per_word(each(r"[.?](?:\s|$)")),
        "digits": per_word(each(r"[0-9]")),
        "lines_distinct": F.size(F.array_distinct(lines_)) / F.size(lines_).cast("double"),
        "lines_per_word": per_word(F.size(lines_).cast("double")),
    }
    return out.withColumn(name, F.struct(*[values[s].alias(s) for s in STATISTICS])).drop(words_, lines_)


STATISTICS = ("log_words", "distinct", "word_length", "common", "upper", "symbols", "exclaim", "stops", "digits", "lines_distinct", "lines_per_word")


class RuleModel:
    """Weighted rules over statistics. ``constant`` alone decides where labels were of one kind (its logit) or absent (0)."""

    def __init__(self, constant: float, rules: list[tuple[Rule, float]]):
        self.constant, self.rules = constant, rules

    def column(self, name: str = "q_") -> Column:
        """The score as an expression over the struct ``name`` of statistics."""
        margin = F.lit(float(self.constant))
        for rule, weight in self.rules:
            test = None
            for statistic, at_most, bound in rule:
                value = F.col(name)[statistic]
                c = value <= F.lit(bound) if at_most else value > F.lit(bound)
                test = c if test is None else test & c
            margin = margin + F.when(test, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def _paths(node, names: tuple[str, ...], above: dict) -> list[Rule]:
    """Rules of all nodes below one of Spark's tree nodes; bounds on one statistic merge."""
    rules = [tuple((n, le, b) for (n, le), b in sorted(above.items()))] if above else []
    if node.getClass().getSimpleName() == "InternalNode":
        name, bound = names[node.split().featureIndex()], float(f"{node.split().threshold():.6g}")
        low, high = dict(above), dict(above)
        low[name, True] = min(bound, above.get((name, True), math.inf))
        high[name, False] = max(bound, above.get((name, False), -math.inf))
        rules += _paths(node.leftChild(), names, low) + _paths(node.rightChild(), names, high)
    return rules


def train(docs: DataFrame, labels: DataFrame, spark: SparkSession, sample: int = SAMPLE, trees: int = 16, depth: int = 3, lasso: float = 2e-3) -> RuleModel:
    """A rule model of ``labels(doc_id, quality)`` over ``docs(doc_id, text)``, from ``sample`` documents at most, none held out.

    Of several texts under one id, the one of the least hash stands for it, so reruns train on the same rows.
    """
    one = labels.where(F.col("quality").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("y"))
    one = one.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(one, "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = sorted(statistics(texts).select("doc_id", "y", "q_.*").collect(), key=lambda r: r.doc_id)  # `sample` rows of numbers
    y = np.array([r.y for r in rows], float)
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return RuleModel(math.log((share + 1e-3) / (1 - share + 1e-3)), [])
    x = np.array([[r[s] for s in STATISTICS] for r in rows], float)
    frame = spark.createDataFrame([(float(a), Vectors.dense(b)) for a, b in zip(y, x, strict=True)], ["label", "features"]).coalesce(1).cache()
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=5, subsamplingRate=0.8, featureSubsetStrategy="4").fit(frame)
    frame.unpersist()
    rules: dict[bytes, Rule] = {}
    for tree in forest.trees:
        for rule in _paths(tree._call_java("rootNode"), STATISTICS, {}):
            hit = np.all([(x[:, STATISTICS.index(n)] <= b) == le for n, le, b in rule], axis=0)
            if 0 < hit.sum() < len(y):
                rules.setdefault(hit.tobytes(), rule)  # rules that pick the same documents are one
    chosen = list(rules.values())
    design = np.array([np.frombuffer(k, bool) for k in rules], float).T
    frame = spark.createDataFrame([(float(a), Vectors.dense(b)) for a, b in zip(y, design, strict=True)], ["label", "features"]).coalesce(1).cache()
    fitted = LogisticRegression(regParam=lasso, elasticNetParam=1.0, standardization=False, maxIter=100).fit(frame)
    frame.unpersist()
    return RuleModel(fitted.intercept, [(r, w) for r, w in zip(chosen, fitted.coefficients.toArray().tolist(), strict=True) if abs(w) > 1e-6])


def score(docs: DataFrame, model: RuleModel, threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (in place of columns so named), a row a row; other columns pass through.

    Null and empty texts get the score of zeros. Very long texts are counted whole. Repeated rows score alike. No rows: none.
    """
    docs = docs.drop("score", "predicted")
    (q,) = fresh(docs, "q_")
    return statistics(docs, q).withColumn("score", model.column(q)).withColumn("predicted", (F.col("score") >= threshold).cast("int")).drop(q)


def keep(docs: DataFrame, model: RuleModel, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with their own columns, whatever their names."""
    q, s, kept = fresh(docs, "q_", "q_score", "q_keep")
    scored = statistics(docs, q).withColumn(s, model.column(q))
    # a filter on the score would be pushed below the statistics and repeat them in every rule; rows leave by a generator instead
    return scored.withColumn(kept, F.explode(F.filter(F.array(s), lambda x: x >= threshold))).drop(q, s, kept)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), spark)
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
