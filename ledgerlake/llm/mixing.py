"""Mixing to target weights by iterative proportional fitting.

Documents are counted into cells (source, language, topic), by whitespace
tokens. Values a target does not name fall into one cell "other", so the
number of cells is bounded by the targets' sizes, whatever the corpus
holds. Raking scales the cells' token weights to one marginal after the
other. No document can be kept more than once, so no cell's weight is more
than its tokens.

With a ``budget`` (a part of all tokens) that many tokens are kept whatever
a margin holds: a value whose goal is over its tokens gives all it has, and
what is missing is shared by the other values of its margin in proportion to
their goals, so one scarce value never sets the share of the corpus.

Without a ``keep_share`` or ``budget`` the share is the largest part of all tokens at which no
named value needs more than its tokens, lowered until the capped weights
meet every margin within ``TOLERANCE``; the cell table, bounded as it is,
is fitted on the driver, and each step solves for the scale with the caps
in it. With a ``keep_share``, weights are raked to that part of all tokens
in ``sweeps`` windows over one partition, and cut after each sweep: targets
that then ask for more than there is are missed. Targets that the weights
miss are named in a warning, by value, share got and share asked for.

A document is kept with the calibrated probability weight /
tokens of its cell: the expected kept tokens are the weights. The draw is a
hash of the document's id and text against that probability: the same on
every run and after a lost executor, and no shuffle of documents.

Targets are shares; each marginal's named values share one minus the part
that "other" has in the data. A named value without documents gets none, and
its share goes to the others in proportion.

Defined results: null texts and empty texts have no tokens but are drawn
like their cell; null source or language counts as "other"; repeated rows
are drawn alike; a cell without tokens keeps its documents with probability
the share kept; an empty table gives an empty result; other columns pass
through.
"""

from __future__ import annotations

import warnings
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.llm.common import text_or_empty
from ledgerlake.session import ensure_checkpoint_dir

OTHER = "other"
SWEEPS = 12
KEEP_SHARE = 0.5
#: Part of its goal by which a margin's weight may differ.
TOLERANCE = 1e-4
#: Sweeps of a fit on the driver, at most, and how close they go.
FIT_SWEEPS, FIT_TOLERANCE = 300, 1e-9
#: Times the share is halved, and then narrowed down.
HALVINGS, NARROWINGS = 12, 10
#: Sweeps in one plan; then the cells are checkpointed.
PLANNED_SWEEPS = 3
MARGINS = ("mix_source", "mix_lang", "mix_topic")
#: Topics by what a text holds: the first pattern that matches.
TOPIC_RULES = (
    ("legal", r"(?i)licen[sc]e|copyright"),
    ("contact", r"@[A-Za-z0-9-]+\.|\+[0-9]"),
    ("noise", r"[%&#*$]{3}|!!"),
)
DEFAULT_TOPIC = "prose"
#: Lower-case pieces of which a text must hold one to match the rule; most
#: texts are then not searched by its pattern.
TOPIC_HINTS = {"legal": ("licen", "copyright"), "contact": ("@", "+")}


def topic_of(text: Column, rules=TOPIC_RULES, default: str = DEFAULT_TOPIC, hints=TOPIC_HINTS) -> Column:
    """The first rule's topic whose pattern the text holds."""
    out = F.lit(default)
    for name, pattern in reversed(rules):
        found = F.regexp_like(text, F.lit(pattern))
        if name in hints:
            lowered = F.lower(text) if any(x.upper() != x for x in hints[name]) else text
            found = reduce(or_, [F.contains(lowered, F.lit(x)) for x in hints[name]]) & found
        out = F.when(found, F.lit(name)).otherwise(out)
    return out


def token_count(text: Column) -> Column:
    """Whitespace-separated words."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _named(c: Column, targets: dict[str, float]) -> Column:
    return F.when(c.isin(*targets), c).otherwise(F.lit(OTHER))


def rake(
    cells: DataFrame, targets: dict[str, dict[str, float]], keep_share: float = KEEP_SHARE, sweeps: int = SWEEPS
) -> DataFrame:
    """``cells`` (margin columns and ``tokens``) with ``weight``: tokens
    raked to ``targets`` (margin column to {value: share}) of ``keep_share``
    of all tokens, in no cell more than its tokens."""
    everything = Window.partitionBy(F.lit(1))
    df = cells.withColumn("total", F.sum("tokens").over(everything))
    for margin, shares in targets.items():
        share = F.lit(None).cast("double")
        for value, x in shares.items():
            share = F.when(F.col(margin) == value, F.lit(float(x))).otherwise(share)
        own = F.sum("tokens").over(Window.partitionBy(margin))
        rest = F.sum(F.when(F.col(margin) == OTHER, F.col("tokens")).otherwise(0)).over(everything)
        each = Window.partitionBy(margin).orderBy(*MARGINS)
        first = F.when((F.row_number().over(each) == 1) & (own > 0), share)
        df = (
            df.withColumn("own", own).withColumn("rest", rest).withColumn("share", share).withColumn("first", first)
            .withColumn("present", F.sum("first").over(everything))
            .withColumn(
                f"goal_{margin}",
                F.when(F.col("share").isNull(), F.col("own").cast("double"))
                .otherwise(F.col("share") / F.col("present") * (F.col("total") - F.col("rest"))),
            )
            .drop("own", "rest", "share", "first", "present")
        )
    df = df.withColumn("weight", F.col("tokens") * keep_share)
    for sweep in range(sweeps):
        for margin in targets:
            now = F.sum("weight").over(Window.partitionBy(margin))
            goal = F.col(f"goal_{margin}") * keep_share
            df = df.withColumn("weight", F.when(now > 0, F.col("weight") * goal / now).otherwise(0.0))
        df = df.withColumn("weight", F.least("weight", F.col("tokens").cast("double")))
        if sweep % PLANNED_SWEEPS == PLANNED_SWEEPS - 1:
            df = df.checkpoint()
    return df.drop("total", *[f"goal_{m}" for m in targets])


class _Cells:
    """The cell table on the driver: tokens, and by margin the values, the
    cells of each and its goal at a keep share of one."""

    def __init__(self, rows: list, targets: dict[str, dict[str, float]]):
        self.tokens = np.array([r["tokens"] for r in rows], float)
        self.goals: list[tuple[str, str, np.ndarray, float]] = []
        total = self.tokens.sum()
        for margin, shares in targets.items():
            of = np.array([r[margin] for r in rows], object)
            own = {v: self.tokens[of == v].sum() for v in sorted(set(of))}
            present = sum(x for v, x in shares.items() if own.get(v, 0) > 0)
            for v, n in own.items():
                goal = n if v not in shares else shares[v] / present * (total - own.get(OTHER, 0.0)) if n > 0 and shares[v] > 0 else 0.0
                self.goals.append((margin, v, np.flatnonzero(of == v), goal))

    def refill(self, share: float) -> None:
        """Bound each goal by what its value has at ``share``, and give the
        rest to the other values of the margin, again while one is over."""
        margins = dict.fromkeys(m for m, *_ in self.goals)
        for margin in margins:
            entries = [i for i, g in enumerate(self.goals) if g[0] == margin]
            most = {i: self.tokens[self.goals[i][2]].sum() / share for i in entries}
            goal = {i: self.goals[i][3] for i in entries}
            full: set[int] = set()
            while True:
                over = {i for i in entries if i not in full and goal[i] > most[i]}
                if not over:
                    break
                full |= over
                open_ = [i for i in entries if i not in full]
                left = sum(goal.values()) - sum(most[i] for i in full) - sum(goal[i] for i in open_)
                rest = sum(goal[i] for i in open_)
                goal |= {i: most[i] for i in full}
                if rest > 0:
                    goal |= {i: goal[i] * (1 + left / rest) for i in open_}
            for i in entries:
                self.goals[i] = (*self.goals[i][:3], goal[i])

    def most(self) -> float:
        """The largest share at which no value needs more than it has."""
        return min([1.0, *(self.tokens[at].sum() / goal for _, _, at, goal in self.goals if goal > 0)])

    def misses(self, weights: np.ndarray, share: float) -> dict[tuple[str, str], tuple[float, float]]:
        """(margin, value) to its weight and its goal, as parts of what is
        to be kept, for the values that are off by more than TOLERANCE."""
        kept = self.tokens.sum() * share
        found = {(m, v): (weights[at].sum(), goal * share) for m, v, at, goal in self.goals}
        return {k: (w / kept, g / kept) for k, (w, g) in found.items() if abs(w - g) > TOLERANCE * max(g, 1e-12 * kept)}

    def fit(self, share: float) -> np.ndarray:
        """Weights for ``share``, each at most its cell's tokens: scales are
        solved with the caps in place, one value after the other."""
        x, t = self.tokens * share, self.tokens
        for _ in range(FIT_SWEEPS):
            for _, _, at, goal in self.goals:
                x[at] *= _scale(x[at], t[at], goal * share)
            w = np.minimum(x, t)
            if all(abs(w[at].sum() - goal * share) <= FIT_TOLERANCE * goal * share for _, _, at, goal in self.goals):
                break
        return np.minimum(x, t)


def _scale(x: np.ndarray, t: np.ndarray, goal: float) -> float:
    """The factor that makes sum(min(t, factor * x)) the goal, or the
    smallest that caps all."""
    x, t = x[x > 0], t[x > 0]
    if goal <= 0 or not len(x):
        return 0.0 if goal <= 0 else 1.0
    order = np.argsort(t / x)
    x, t = x[order], t[order]
    capped = np.concatenate([[0.0], np.cumsum(t)])[:-1]
    open_ = np.cumsum(x[::-1])[::-1]
    # With cells before i capped, the factor would be (goal - capped[i]) / open_[i].
    factors, limits = (goal - capped) / open_, t / x
    fits = np.flatnonzero(factors <= limits)
    return float(factors[fits[0]]) if len(fits) else float(limits[-1])


def rake_within(cells: DataFrame, targets: dict[str, dict[str, float]]) -> tuple[DataFrame, float]:
    """``cells`` with ``weight``, and the share of all tokens that it keeps:
    the largest found at which every margin is met within TOLERANCE. If no
    share meets them, as with values that stand in no common cell, the
    weights come near them at the largest share that each value allows."""
    rows = cells.collect()
    table = _Cells(rows, targets)
    share = table.most()
    weights = table.fit(share)
    if table.misses(weights, share):
        met = None
        for i in range(1, HALVINGS + 1):
            tried = table.fit(share * 0.5**i)
            if not table.misses(tried, share * 0.5**i):
                met = share * 0.5**i
                break
        if met is not None:
            low, high, weights = met, 2 * met, tried
            for _ in range(NARROWINGS):
                middle = (low + high) / 2
                tried = table.fit(middle)
                if table.misses(tried, middle):
                    high = middle
                else:
                    low, weights = middle, tried
            share = low
    schema = T.StructType([*cells.schema.fields, T.StructField("weight", T.DoubleType())])
    made = [(*r, float(w)) for r, w in zip(rows, weights)]
    return cells.sparkSession.createDataFrame(made, schema).coalesce(1), share


def rake_budget(cells: DataFrame, targets: dict[str, dict[str, float]], budget: float) -> DataFrame:
    """``cells`` with ``weight``: ``budget`` of all tokens, by margins whose
    short values are made up for by the others."""
    rows = cells.collect()
    table = _Cells(rows, targets)
    table.refill(budget)
    schema = T.StructType([*cells.schema.fields, T.StructField("weight", T.DoubleType())])
    made = [(*r, float(w)) for r, w in zip(rows, table.fit(budget))]
    return cells.sparkSession.createDataFrame(made, schema).coalesce(1)


def residuals(fitted: DataFrame, targets: dict[str, dict[str, float]]) -> DataFrame:
    """(margin, value, tokens, weight, target, got): by value of each margin
    what there is, what is kept, and the shares asked for and got."""
    total = F.sum("weight").over(Window.partitionBy("margin"))
    out = None
    for margin, shares in targets.items():
        # At most one row a target.
        asked = fitted.sparkSession.createDataFrame([(v, float(x)) for v, x in shares.items()], "value string, target double")
        by_value = fitted.groupBy(F.col(margin).alias("value")).agg(F.sum("tokens").alias("tokens"), F.sum("weight").alias("weight"))
        one = by_value.join(asked, "value", "full").select(
            F.lit(margin).alias("margin"), "value", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("weight", F.lit(0.0)).alias("weight"), "target"
        )
        out = one if out is None else out.unionByName(one)
    return out.withColumn("got", F.when(total > 0, F.col("weight") / total))


def missed(fitted: DataFrame, targets: dict[str, dict[str, float]], keep_share: float) -> dict[tuple[str, str], tuple[float, float]]:
    """(margin, value) to the parts of the kept tokens got and asked for,
    for what the weights of ``fitted`` cells miss by more than TOLERANCE."""
    rows = fitted.collect()
    return _Cells(rows, targets).misses(np.array([r["weight"] for r in rows], float), keep_share)


def mix(
    docs: DataFrame,
    source_targets: dict[str, float],
    lang_targets: dict[str, float],
    topic_targets: dict[str, float],
    keep_share: float | None = None,
    sweeps: int = SWEEPS,
    seed: str = "mix",
    budget: float | None = None,
) -> DataFrame:
    """``docs`` with ``mix_source``, ``mix_lang``, ``mix_topic``,
    ``mix_tokens``, ``keep_p`` and ``kept``. Input columns of these names
    are replaced. Warns of targets that are missed."""
    ensure_checkpoint_dir(docs.sparkSession)
    text = text_or_empty()
    tagged = docs.withColumns(
        {
            "mix_source": F.coalesce(_named(F.col("source"), source_targets), F.lit(OTHER)),
            "mix_lang": F.coalesce(_named(F.col("lang"), lang_targets), F.lit(OTHER)),
            "mix_topic": _named(topic_of(text), topic_targets),
            "mix_tokens": token_count(text),
        }
    )
    cells = tagged.groupBy(*MARGINS).agg(F.sum("mix_tokens").alias("tokens")).coalesce(1).checkpoint()
    targets = dict(zip(MARGINS, (source_targets, lang_targets, topic_targets)))
    if budget is not None:
        fitted, keep_share = rake_budget(cells, targets, budget), budget
    elif keep_share is None:
        fitted, keep_share = rake_within(cells, targets)
    else:
        fitted = rake(cells, targets, keep_share, sweeps).checkpoint()
    off = missed(fitted, targets, keep_share)
    if off:
        named = ", ".join(f"{m}={v} {got:.4f} of {goal:.4f}" for (m, v), (got, goal) in off.items())
        warnings.warn(f"mixing targets missed at a keep share of {keep_share:.4f}: {named}", stacklevel=2)
    rate = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(F.lit(keep_share))
    rates = fitted.select(*MARGINS, rate.alias("keep_p")).checkpoint()
    base = tagged.select(*[F.col(f"`{c}`") for c in tagged.columns if c not in ("keep_p", "kept")])
    # One row for each cell: bounded by the targets, whatever the corpus.
    joined = base.join(F.broadcast(rates), list(MARGINS), "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in base.columns], "keep_p", (draw(seed) < F.col("keep_p")).alias("kept")
    )


def draw(seed: str) -> Column:
    """A number in [0, 1) from the document's id and text: 52 bits of MD5."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text_or_empty()))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)
