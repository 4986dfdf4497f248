"""Quality classifier: a sparse rule ensemble compiled to Spark expressions.

A shallow random forest is fitted on labelled text statistics; every path from
a root becomes a conjunctive rule. A lasso logistic regression over the rules
leaves few of them, and those are summed as ordinary Spark columns. Labels are
learned from a bounded sample (``MAX_LABELLED``); every document is scored.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairframe.llm.common import stored
from pairframe.llm.stats import FEATURES, id_crc, labelled_sample, text_stats

MAX_LABELLED, TREES, DEPTH, LASSO = 100_000, 16, 3, 0.001

#: (feature, above, threshold) terms that hold together.
Rule = tuple[tuple[str, bool, float], ...]


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for name, above, cut in rule:
        out = out & (F.col(name) > F.lit(cut) if above else F.col(name) <= F.lit(cut))
    return out


def tree_rules(model) -> list[Rule]:
    """Every path from a root to another node of the forest, once, in a fixed order."""
    found: set[Rule] = set()

    def walk(node, terms: dict) -> None:
        if terms:
            found.add(tuple(sorted((f, above, cut) for (f, above), cut in terms.items())))
        if node.subtreeDepth() == 0:
            return
        name, cut = FEATURES[node.split().featureIndex()], node.split().threshold()
        low, high = terms.get((name, False), math.inf), terms.get((name, True), -math.inf)
        walk(node.leftChild(), terms | {(name, False): min(low, cut)})
        walk(node.rightChild(), terms | {(name, True): max(high, cut)})

    for tree in model.trees:
        walk(tree._call_java("rootNode"), {})
    return sorted(found)


def fit_rules(sample: DataFrame) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and weighted rules from rows of FEATURES and label; no rule where the labels don't differ."""
    good, rows = sample.agg(F.sum("label"), F.count("*")).first()
    if not rows or good in (0, rows):
        rate = ((good or 0) + 1) / ((rows or 0) + 2)
        return math.log(rate / (1 - rate)), []
    data = sample.select(F.col("label").cast("double").alias("label"), array_to_vector(F.array(*FEATURES)).alias("features"), *FEATURES)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=5, featureSubsetStrategy="onethird", seed=11).fit(data)
    rules = tree_rules(forest)
    if not rules:
        return math.log(good / (rows - good)), []
    fired = data.select("label", array_to_vector(F.array(*[holds(r).cast("double") for r in rules])).alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=False).fit(fired)
    weights = [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if abs(w) > 1e-6]
    return float(lasso.intercept), weights


def compiled(intercept: float, weights: list[tuple[Rule, float]]) -> Column:
    margin = F.lit(intercept)
    for rule, weight in weights:
        margin = margin + F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-margin))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Rows whose crc32 of the id as text is 1 modulo 3 are held out of learning.
    Null and empty texts are scored by their all-zero statistics, long ones
    whole. With no usable labels every score is the same prior. Labels that are
    null or in conflict are left out; repeated rows and ties of ids get a row
    each, an empty table gives none; other columns are ignored.
    """
    renamed = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    stats = stored(text_stats(renamed, "text", ["doc_id"]), "stats").withColumn("held_out", id_crc() % 3 == 1)
    sample = stored(labelled_sample(stats.filter("not held_out"), labels, max_labelled), "sample")
    score = compiled(*fit_rules(sample))
    scored = stats.select("doc_id", "held_out", score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
