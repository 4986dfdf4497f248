"""Quality rules: an ordered decision list learned by sequential covering.

A rule is a conjunction of at most ``MAX_TERMS`` thresholds on text statistics
and says keep or reject. For each verdict one rule is grown term by term by
FOIL gain on two thirds of the labelled rows and pruned from its end on the last
third. The more precise of the two joins the list, the rows it covers are set
aside, and the next pair is grown on what is left, so a later rule speaks only
of what earlier ones let pass. A rule that isn't precise enough is dropped, its
first term is set aside, and another one is grown in its place; learning ends
when ``PATIENCE`` rules of either verdict have failed in a row. What no rule
matches gets the majority's verdict.

Spark counts (verdict, feature, bin, label) for every step; the driver sees
those few counts only. The list comes out as one ordered Spark conditional.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairframe.llm.common import stored
from pairframe.llm.stats import FEATURES, labelled_sample, sampled_labels, text_stats

MAX_LABELLED, BINS, MAX_TERMS, PATIENCE = 200_000, 24, 3, 3
#: A rule covers MIN_COVER rows to grow on and MIN_SHARE of its verdict's rows to be pruned on, and MIN_PRECISION of those it covers there are its own.
MIN_COVER, MIN_SHARE, MIN_PRECISION = 5, 0.005, 0.9


@dataclass(frozen=True)
class Term:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)


Rule = tuple[Term, ...]


def matches(rule: Rule) -> Column:
    out = F.lit(True)
    for term in rule:
        out = out & term.column()
    return out


@dataclass(frozen=True)
class DecisionList:
    """Rules in order, each with whether it keeps, and what holds where none matches."""

    rules: tuple[tuple[Rule, bool], ...] = ()
    default: bool = True

    def column(self) -> Column:
        """The list as one conditional: the first rule that matches decides."""
        if not self.rules:
            return F.lit(self.default)
        (first, keeps), *rest = self.rules
        out = F.when(matches(first), F.lit(keeps))
        for rule, keeps in rest:
            out = out.when(matches(rule), F.lit(keeps))
        return out.otherwise(F.lit(self.default))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _bin(feature: str, cuts: list[float]) -> Column:
    """How many cuts the feature lies above."""
    return F.aggregate(F.array(*[F.lit(float(x)) for x in cuts]).cast("array<double>"), F.lit(0), lambda acc, x: acc + (F.col(feature) > x).cast("int"))


def _counts(rows: DataFrame, heads: dict[int, Rule]) -> dict[int, dict[tuple[int, int], list[int]]]:
    """label wanted -> (feature, bin) -> rows of label 0 and 1 under its head, in one pass."""
    under = F.array_compact(F.array(*[F.when(matches(head), F.lit(want)) for want, head in heads.items()]))
    long = rows.select("label", "bins", F.explode(under).alias("want")).select("want", F.posexplode("bins").alias("feature", "bin"), "label")
    got = long.groupBy("want", "feature", "bin").agg(F.count_if(F.col("label") == 0).alias("bad"), F.count_if(F.col("label") == 1).alias("good")).collect()
    out: dict[int, dict[tuple[int, int], list[int]]] = {want: {} for want in heads}
    for r in got:
        out[r.want][r.feature, r.bin] = [r.bad, r.good]
    return out


def _best_term(counts: dict, cuts: list[list[float]], want: int, banned: set[Term]) -> Term | None:
    """The threshold of the largest FOIL gain for a label; none where all rows have it or no threshold gains."""
    best, found = 1e-9, None
    for j, name in enumerate(FEATURES):
        bins = [counts.get((j, b), [0, 0]) for b in range(len(cuts[j]) + 1)]
        own, other = sum(b[want] for b in bins), sum(b[1 - want] for b in bins)
        if not own or not other:
            return None
        low_own = low_other = 0
        for b, cut in enumerate(cuts[j]):
            low_own, low_other = low_own + bins[b][want], low_other + bins[b][1 - want]
            for above, p, n in ((False, low_own, low_other), (True, own - low_own, other - low_other)):
                if p >= MIN_COVER and p + n < own + other and (term := Term(name, above, cut)) not in banned:
                    gain = p * (math.log2(p / (p + n)) - math.log2(own / (own + other)))
                    if gain > best:
                        best, found = gain, term
    return found


def _grown(rows: DataFrame, cuts: list[list[float]], wanted: list[int], banned: dict[int, set[Term]], max_terms: int) -> dict[int, Rule]:
    """A rule for each label wanted, as far as terms gain; labels without one are left out."""
    heads: dict[int, Rule] = {want: () for want in wanted}
    growing = set(wanted)
    while growing:
        counts = _counts(rows, {want: heads[want] for want in growing})
        for want in sorted(growing):
            term = _best_term(counts[want], cuts, want, banned[want] if not heads[want] else set())
            if term is not None:
                heads[want] += (term,)
            if term is None or len(heads[want]) == max_terms:
                growing.discard(want)
    return {want: head for want, head in heads.items() if head}


def _pruned(rows: DataFrame, rules: dict[int, Rule]) -> dict[int, tuple[Rule, int, int]]:
    """label -> the rule's best beginning, and how many rows of its own and of the other label that covers."""
    heads = [(want, rule[:k]) for want, rule in rules.items() for k in range(len(rule), 0, -1)]
    cover = [F.count_if(matches(head) & (F.col("label") == label)).alias(f"n{i}_{label}") for i, (_, head) in enumerate(heads) for label in (0, 1)]
    seen = rows.agg(*cover).first()
    out: dict[int, tuple[Rule, int, int]] = {}
    worth = lambda p, n: (p - n) / max(1, p + n)
    for i, (want, head) in enumerate(heads):
        own, other = seen[f"n{i}_{want}"], seen[f"n{i}_{1 - want}"]
        if want not in out or worth(own, other) > worth(*out[want][1:]):
            out[want] = head, own, other
    return out


def learn(labelled: DataFrame, max_terms: int = MAX_TERMS, patience: int = PATIENCE) -> DecisionList:
    """The list from rows of doc_id, label and statistics; empty where no label is 0 or none is 1."""
    rows = labelled.filter(~base_failed())
    probs = [i / BINS for i in range(1, BINS)]
    asked = [F.percentile_approx(f, probs, 1000).alias(f) for f in FEATURES]
    # cuts of the rejected ones too: a rare fault may lie beyond all quantiles of the whole
    rare = [F.percentile_approx(F.when(F.col("label") == 0, F.col(f)), probs, 1000).alias(f"{f}_bad") for f in FEATURES]
    fold = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) == 0
    top = rows.agg(*[F.count_if((F.col("label") == label) & held).alias(f"n{label}{name}") for label in (0, 1) for name, held in (("", F.lit(True)), ("_prune", fold))], *asked, *rare).first()
    if not top.n0 or not top.n1:
        return DecisionList()
    # halfway between neighbouring quantiles, so that no threshold sits on a value that rows have
    seen = [sorted({*top[f], *top[f"{f}_bad"]}) for f in FEATURES]
    cuts = [[(a + b) / 2 for a, b in zip(values, values[1:], strict=False)] for values in seen]
    place = [_bin(f, cut) for f, cut in zip(FEATURES, cuts, strict=True)]
    rows = stored(rows.select("label", *FEATURES, F.array(*place).alias("bins"), fold.alias("prune")), "labelled")

    rules: list[tuple[Rule, bool]] = []
    left = F.lit(True)
    failed, banned = {0: 0, 1: 0}, {0: set(), 1: set()}
    while wanted := [want for want in (0, 1) if failed[want] < patience]:
        grown = _grown(rows.filter(left & ~F.col("prune")), cuts, wanted, banned, max_terms)
        for want in wanted:
            if want not in grown:
                failed[want] = patience
        if not grown:
            break
        pruned = _pruned(rows.filter(left & F.col("prune")), grown)
        good = {}
        for want, (head, own, other) in pruned.items():
            if own >= max(2, MIN_SHARE * top[f"n{want}_prune"]) and own >= MIN_PRECISION * (own + other):
                good[want] = own / (own + other), want == 0, own
            else:
                failed[want] += 1
                banned[want].add(grown[want][0])
        if good:
            want = max(good, key=good.__getitem__)
            rules.append((pruned[want][0], want == 1))
            left = left & ~matches(pruned[want][0])
            failed = {0: min(failed[0], patience - 1), 1: min(failed[1], patience - 1)} if patience > 1 else failed
    rest = rows.filter(left).agg(F.count_if(F.col("label") == 1).alias("good"), F.count_if(F.col("label") == 0).alias("bad")).first()
    return DecisionList(tuple(rules), rest.good >= rest.bad)


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """One row per row of docs: doc_id, the statistics, base_failed and kept.

    Null and empty texts have no words and fail the base rule. With no usable
    labels the learned list is empty and the base rule decides alone. At most
    about ``max_labelled`` labels are learned from; of two rules equally precise
    the one that rejects goes first. Repeated rows get a row each; an empty
    table gives no rows; other columns are ignored.
    """
    renamed = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    stats = stored(text_stats(renamed, "text", ["doc_id"]), "stats")
    found = learn(labelled_sample(stats, labels, max_labelled))
    return stats.select("*", base_failed().alias("base_failed"), (~base_failed() & found.column()).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of docs that quality_verdicts keeps, with their columns, whatever those are called.

    Statistics of the labelled rows are worked out for learning, those of all
    rows once, in the scan that filters; no text is shuffled, for the labels
    (``max_labelled`` bounds them) go to the texts.
    """
    few = F.broadcast(sampled_labels(labels, max_labelled))
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    found = learn(stored(text_stats(texts.join(few, "doc_id"), "text", ["doc_id", "label"]), "labelled-stats"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    return text_stats(whole, "text", ["row"]).filter(~base_failed() & found.column()).select("row.*")
