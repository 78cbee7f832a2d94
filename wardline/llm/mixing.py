"""Sources mixed to target weights: temperature weights, realised as block permutations within token budgets."""

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.catalog import bounded_rows
from wardline.session import cut_lineage

MAX_SOURCES = 10_000
#: Uses of documents that are put in order in one task.
ORDERED = 100_000


def powered(shares: dict[str, float], exponent: float, targets: dict[str, float] | None = None) -> dict[str, float]:
    """Normalised shares^exponent; with targets, shares * (targets / shares)^exponent: 0 gives the shares, 1 the targets."""
    if targets is None:
        w = {s: p**exponent for s, p in shares.items() if p > 0}
    else:
        w = {s: shares[s] * (targets[s] / shares[s]) ** exponent for s in targets if shares.get(s, 0) > 0 and targets[s] > 0}
    all_ = sum(w.values())
    return {s: x / all_ for s, x in w.items()}


def entropy(w: dict[str, float]) -> float:
    return -sum(x * math.log(x) for x in w.values() if x > 0)


def bisect(good, low: float, high: float, steps: int = 80) -> float:
    """The end of the stretch from low where good holds; good(low) is taken to hold."""
    if good(high):
        return high
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if good(mid) else (low, mid)
    return low


@dataclass(frozen=True)
class Plan:
    """What every source contributes: its weight, the exponent that it was given, budget in tokens, and tokens at hand."""

    total: int
    exponents: dict[str, float]
    weights: dict[str, float]
    tokens: dict[str, int]

    @property
    def exponent(self) -> float:
        """The lowest exponent of all sources."""
        return min(self.exponents.values(), default=1.0)

    def budget(self, source: str) -> int:
        return round(self.total * self.weights[source])


def plan(tokens: dict[str, int], targets: dict[str, float] | None = None, repeats: dict[str, int] | None = None, total: int | None = None, target_entropy: float | None = None) -> Plan:
    """Weights for the sources that have tokens.

    With targets, the exponent that leads from the token shares to the targets is bisected against the caps (tempered);
    without total, the total is the largest at which the targets can be had. Without targets, shares are exponentiated
    and the exponent bisected between 1 (in proportion) and 0 (evenly) to the target entropy and the caps. A cap that is
    missing is 1. Targets of sources without tokens are spread over the others in proportion.
    """
    have = {s: n for s, n in tokens.items() if n > 0 and (targets is None or targets.get(s, 0) > 0)}
    cap = {s: n * max(0, (repeats or {}).get(s, 1)) for s, n in have.items()}
    have = {s: n for s, n in have.items() if cap[s] > 0}
    if not have:
        return Plan(0, {}, {}, {})
    shares = {s: n / sum(have.values()) for s, n in have.items()}
    if total is None:
        ideal = powered(shares, 1.0, targets)
        total = math.floor(min(cap[s] / w for s, w in ideal.items()))
    total = min(total, sum(cap[s] for s in have))
    if targets is not None:
        w, e = tempered(shares, targets, {s: cap[s] / total for s in have})
        return Plan(total, e, w, have)
    fits = lambda w: all(total * x <= cap[s] * (1 + 1e-9) for s, x in w.items())
    want = entropy(shares) if target_entropy is None else min(target_entropy, math.log(len(shares)))
    e = 1 - bisect(lambda x: entropy(powered(shares, 1 - x)) <= want and fits(powered(shares, 1 - x)), 0.0, 1.0)
    w = powered(shares, e)
    if not fits(w):  # beyond what the exponent can give: what a full source can't take goes to the others
        w = poured(w, {s: cap[s] / total for s in w})
    return Plan(total, dict.fromkeys(w, e), w, have)


def tempered(shares: dict[str, float], targets: dict[str, float], most: dict[str, float]) -> tuple[dict[str, float], dict[str, float]]:
    """Weights and exponents of the sources, no weight above its ``most`` (which sum to 1 or more).

    Weights in proportion to share^(1 - e) * target^e lead from the token shares to the targets. e is bisected to the
    largest at which no source is above its limit. The sources that reach their limit there keep it, and the others
    go on with what is left of the total, until they have their targets in proportion (e = 1). So one small source
    holds nobody else back.
    """
    free, left = set(shares), 1.0
    w: dict[str, float] = {}
    exponents: dict[str, float] = {}
    while free:
        own = {s: shares[s] for s in free}
        path = lambda e: {s: left * x for s, x in powered(own, e, {s: targets[s] for s in own}).items()}  # noqa: B023, E731
        over = lambda e, room: {s for s, x in path(e).items() if x >= most[s] * room}  # noqa: B023, E731
        fits = lambda e: not over(e, 1 + 1e-9)  # noqa: B023, E731
        # where neither end of the path fits, what is above its limit at the targets is cut down to it
        e = bisect(fits, 0.0, 1.0) if fits(0.0) else 1.0
        full = set(free) if fits(1.0) else over(e, 1 - 1e-6) or set(free)
        for s, x in path(e).items():
            if s in full:
                w[s], exponents[s] = min(x, most[s]), e
        left -= sum(w[s] for s in full)
        free -= full
    return w, exponents


def poured(w: dict[str, float], most: dict[str, float]) -> dict[str, float]:
    """Weights with upper bounds; what is over is shared by the others in proportion."""
    full: set[str] = set()
    while True:
        free = 1 - sum(most[s] for s in full)
        rest = sum(x for s, x in w.items() if s not in full)
        new = {s: most[s] if s in full else x * free / rest for s, x in w.items()}
        over = {s for s in new if s not in full and new[s] > most[s]}
        if not over or len(full | over) == len(w):
            return {s: min(x, most[s]) for s, x in new.items()}
        full |= over


def tokens_of(counts: DataFrame) -> dict[str, tuple[int, int]]:
    """Tokens and documents of every source that is not null."""
    g = counts.filter("source is not null").groupBy("source").agg(F.sum("n_tokens").cast("bigint").alias("t"), F.count(F.lit(1)).alias("n"))
    return {r.source: (r.t or 0, r.n) for r in bounded_rows(g, MAX_SOURCES, "the list of sources")}


def select(counts: DataFrame, p: Plan, documents: dict[str, int], block_tokens: int = 100_000, seed: int = 7, key: str = "doc_id") -> DataFrame:
    """Uses of documents: key, source, pass, block, position, n_tokens.

    A source is used in whole passes and a part of one more. Each pass is a permutation by hash of its own; of the last
    one the documents up to the budget are taken, and the one on its edge if the greater part of it lies within. block
    is the place of the use in the mixture: every block holds all sources by their weights, and within a block the uses
    stand in the order of position. Sums run along buckets of the hash of about ORDERED uses each, so no source,
    however large, is put in order by one task.
    """
    spark = counts.sparkSession
    blocks = max(1, round(p.total / block_tokens))
    rows = []
    for s in p.weights:
        budget, own = p.budget(s), p.tokens[s]
        passes = budget // own
        rows.append((s, budget, own, passes, budget - passes * own, max(1, -(-documents[s] // ORDERED))))
    side = F.broadcast(spark.createDataFrame(rows, "source string, _budget bigint, _own bigint, _passes bigint, _rest bigint, _buckets bigint"))  # at most MAX_SOURCES rows
    n = F.col("_passes") + F.when(F.col("_rest") > 0, 1).otherwise(0)
    uses = counts.join(side, "source").filter(n > 0).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))).withColumn("pass", F.col("_k").cast("int"))
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key, "pass"), 11)
    uses = uses.withColumn("position", h / F.lit(float(2**53))).withColumn("_bucket", F.floor(F.col("position") * F.col("_buckets")).cast("int"))
    sums = uses.groupBy("source", "pass", "_bucket").agg(F.sum("n_tokens").alias("_t"))
    sums = sums.select("source", "pass", "_bucket", (F.sum("_t").over(Window.partitionBy("source", "pass").orderBy("_bucket")) - F.col("_t")).alias("_before"))
    w = Window.partitionBy("source", "pass", "_bucket").orderBy("position", key).rowsBetween(Window.unboundedPreceding, 0)
    at = uses.withColumn("_within", F.sum("n_tokens").over(w)).join(sums, ["source", "pass", "_bucket"]).withColumn("_end", F.col("_before") + F.col("_within"))
    kept = at.filter((F.col("pass") < F.col("_passes")) | (F.col("_end") - F.col("n_tokens") / 2 <= F.col("_rest")))
    begin = F.col("pass") * F.col("_own") + F.col("_end") - F.col("n_tokens")
    block = F.least(F.floor(begin * blocks / F.greatest("_budget", F.lit(1))), F.lit(blocks - 1)).cast("int")
    return kept.select(key, "source", "pass", block.alias("block"), "position", "n_tokens")


def mix(counts: DataFrame, targets: DataFrame, total: float | None = None, block_tokens: int = 100_000, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The uses, and a row for each source of targets: target_share, share, tokens, documents, most_uses, cap, at_hand, weight, exponent, total.

    ``total`` is a number of tokens, or, below 1, a share of all tokens of the sources that targets names.

    counts holds doc_id, source and n_tokens; documents of a null source or one without a target are not used. Of a
    source that targets names twice the last row in order holds. A target without documents gets the share 0.
    """
    goal = {r.source: r for r in sorted(bounded_rows(targets.filter("source is not null").select("source", "target_share", "max_repeats"), MAX_SOURCES, "mix_targets"), key=lambda r: (r.source, r.target_share or 0))}
    counts = cut_lineage(counts.select("doc_id", "source", "n_tokens").filter("n_tokens is not null"))
    have = tokens_of(counts)
    if total is not None and total < 1:
        total = round(total * sum(t for s, (t, _) in have.items() if s in goal))
    p = plan({s: t for s, (t, _) in have.items()}, {s: r.target_share or 0.0 for s, r in goal.items()}, {s: 1 if r.max_repeats is None else r.max_repeats for s, r in goal.items()}, total)
    uses = select(counts, p, {s: n for s, (_, n) in have.items()}, block_tokens, seed)
    per = uses.groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("k"))
    per = per.groupBy("source").agg(F.sum("t").cast("bigint").alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("k").cast("int").alias("most_uses"))
    rows = [(s, r.target_share, r.max_repeats, have.get(s, (0, 0))[0], p.weights.get(s, 0.0), p.exponents.get(s), p.total) for s, r in goal.items()]
    side = counts.sparkSession.createDataFrame(rows, "source string, target_share double, cap int, at_hand bigint, weight double, exponent double, total bigint")
    n = F.coalesce("tokens", F.lit(0).cast("bigint"))
    report = F.broadcast(side).join(per, "source", "left")
    report = report.select("source", "target_share", F.coalesce(n / F.nullif(F.sum(n).over(Window.partitionBy()), F.lit(0)), F.lit(0.0)).alias("share"), n.alias("tokens"), F.coalesce("documents", F.lit(0).cast("bigint")).alias("documents"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), "cap", "at_hand", "weight", "exponent", "total")
    return uses, report


def evened(counts: DataFrame, repeats: DataFrame, evenness: float, total: float, block_tokens: int = 100_000, seed: int = 7) -> DataFrame:
    """source, at_hand, natural, weight, exponent, tokens, most_uses of a mixture without targets.

    Token shares are exponentiated; the exponent is the one at which the entropy of the weights is ``evenness`` of the
    greatest (that of even shares), or the least below it that the repeats (source, max_repeats) allow. ``total`` is a
    number of tokens, or below 1 a share of all.
    """
    most = {r.source: r.max_repeats for r in bounded_rows(repeats.filter("source is not null").select("source", "max_repeats"), MAX_SOURCES, "the list of sources")}
    counts = cut_lineage(counts.select("doc_id", "source", "n_tokens").filter("n_tokens is not null"))
    have = tokens_of(counts)
    all_ = sum(t for t, _ in have.values())
    p = plan({s: t for s, (t, _) in have.items()}, None, {s: 1 if most.get(s) is None else most[s] for s in have}, round(total * all_) if total < 1 else round(total), evenness * math.log(max(1, sum(t > 0 for t, _ in have.values()))))
    per = select(counts, p, {s: n for s, (_, n) in have.items()}, block_tokens, seed).groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("k"))
    per = per.groupBy("source").agg(F.sum("t").cast("bigint").alias("tokens"), F.max("k").cast("int").alias("most_uses"))
    rows = [(s, t, t / max(all_, 1), p.weights.get(s, 0.0), p.exponents.get(s)) for s, (t, _) in have.items()]
    side = counts.sparkSession.createDataFrame(rows, "source string, at_hand bigint, natural double, weight double, exponent double")
    return F.broadcast(side).join(per, "source", "left").select("source", "at_hand", "natural", "weight", "exponent", F.coalesce("tokens", F.lit(0).cast("bigint")).alias("tokens"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"))
