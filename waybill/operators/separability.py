"""Separability of two treatments from matched seeds: exact deltas first, then a paired energy randomisation test.

With pairs kept together, swapping a pair flips a sign s: the energy statistic is E(s) = -(1/n**2) s'Ms with
M = Dxx + Dyy - Dxy - Dyx over RMS distances. M is a small table (pairs by pairs); a permutation is a sign vector,
so all permutations are one aggregation. Signs come from every bit mask (exact) or from an MD5 coin (Monte Carlo),
both the same in any engine; or from given masks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats

#: Pairs an exact test takes at most; energies (on 0..255) that count as equal.
EXACT_PAIRS, TIE = 16, 1e-9


def _scaled(arm: DataFrame, name: str) -> DataFrame:
    """seed and its tensor, brought to 0..255 by its own range."""
    return arm.select("seed", stats.to_255(F.col("px")).alias(name))


def matched_deltas(a: DataFrame, b: DataFrame) -> DataFrame:
    """Arms (seed, px) by seed: max_abs, mae, whether values are finite and sizes equal, both sizes, whether both arms
    have the seed. Arms are compared on 0..255; null values count as not finite."""
    both = _scaled(a, "x").join(_scaled(b, "y"), "seed", "full")
    bad = lambda c: F.coalesce(F.exists(c, lambda v: v.isNull() | stats.non_finite(v)), F.lit(True))
    delta = stats.deltas(F.col("x"), F.col("y"))
    same = F.size("x") == F.size("y")
    return both.select("seed", (F.col("x").isNotNull() & F.col("y").isNotNull()).alias("matched"), F.size("x").alias("nx"), (~bad("x") & ~bad("y")).alias("finite"), same.alias("same_size"), F.when(same, F.array_max(delta)).alias("max_abs"), F.when(same, F.aggregate(delta, F.lit(0.0), lambda s, v: s + v) / F.size("x")).alias("mae"))


def pair_matrix(a: DataFrame, b: DataFrame, block: int = 4096) -> DataFrame:
    """i, j, m of M over pairs in order of seed (numbered from 0), i <= j: M is symmetric.

    Tensors are cut into blocks of ``block`` values: a block's squared differences are summed beside each other and
    only sums are shuffled, so no task holds more than the pairs' values of a few blocks however large tensors are.
    """
    pairs = _scaled(a, "x").join(_scaled(b, "y"), "seed")
    numbered = pairs.select("seed").distinct().withColumn("i", (F.row_number().over(Window.orderBy("seed")) - 1).cast("int"))
    cut = pairs.join(numbered, "seed").select("i", F.size("x").alias("n"), "x", "y", F.explode(F.sequence(F.lit(0), F.floor((F.size("x") - 1) / block).cast("int"))).alias("k"))
    cut = cut.select("i", "n", "k", *(F.slice(c, F.col("k") * block + 1, F.lit(block)).alias(c) for c in ("x", "y")))
    two = cut.select("k", F.col("i").alias("j"), F.col("x").alias("u"), F.col("y").alias("v"))
    squares = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: (s - t) * (s - t)), F.lit(0.0), lambda acc, d: acc + d)
    sides = {"xx": ("x", "u"), "yy": ("y", "v"), "xy": ("x", "v"), "yx": ("y", "u")}
    sums = cut.join(two, "k").where("i <= j").select("i", "j", "n", *(squares(p, q).alias(k) for k, (p, q) in sides.items())).groupBy("i", "j").agg(F.max("n").alias("n"), *(F.sum(k).alias(k) for k in sides))
    d = lambda k: F.sqrt(F.col(k) / F.col("n"))
    return sums.select("i", "j", (d("xx") + d("yy") - d("xy") - d("yx")).alias("m"))


def _coin(seed: int, draw: Column, pair: Column) -> Column:
    text = F.concat_ws("|", F.lit(str(seed)), draw.cast("string"), pair.cast("string"))
    return F.when(F.substring(F.md5(text), 1, 1) < "8", -1).otherwise(1)


def energy_test(matrix: DataFrame, n: int, permutations: int | None = None, seed: int = 0) -> DataFrame:
    """n_pairs, effect, exceed, n_draws, p_value for M of ``n`` pairs. ``permutations`` None: all 2**n masks.

    M has n**2 entries however large the tensors are (n is the number of seeds, some tens). It becomes a literal beside
    which draws are independent rows.
    """
    if permutations is None and n > EXACT_PAIRS:
        raise ValueError(f"exact tests take up to {EXACT_PAIRS} pairs")
    total = 2**n if permutations is None else permutations
    entries = sorted((r.i, r.j, r.m * (1 if r.i == r.j else 2)) for r in matrix.collect())
    ms = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(m).alias("m")) for i, j, m in entries))
    draws = matrix.sparkSession.range(total).withColumnRenamed("id", "k")
    pair = F.sequence(F.lit(0), F.lit(n - 1))
    if permutations is None:
        signs = F.transform(pair, lambda i: F.when(F.col("k").bitwiseAND(F.pow(F.lit(2), i).cast("long")) != 0, -1).otherwise(1))
    else:
        signs = F.transform(pair, lambda i: _coin(seed, F.col("k"), i))
    effect = -sum(m for *_, m in entries) / (n * n)
    energy = -F.aggregate(ms, F.lit(0.0), lambda acc, e: acc + e["m"] * (F.get("s", e["i"]) * F.get("s", e["j"])).cast("double")) / (n * n)
    got = draws.select(signs.alias("s")).select(energy.alias("e")).agg(F.count_if(F.col("e") >= effect - TIE).alias("exceed")).withColumn("effect", F.lit(effect))
    p = F.col("exceed") / total if permutations is None else (F.col("exceed") + 1) / (permutations + 1)
    return got.select(F.lit(n).cast("long").alias("n_pairs"), "effect", "exceed", F.lit(total).cast("long").alias("n_draws"), p.alias("p_value"))


def separability(a: DataFrame, b: DataFrame, declared: str = "distinct", tol: float = 1e-6, distributional: bool = False, alpha: float = 0.05, min_effect: float = 0.0, permutations: int | None = 4095, permutation_seed: int = 0, subject: str = "") -> DataFrame:
    """Gate over two arms (seed, px), one row: status, message, max_abs, mae, n_over, p_value, effect.

    Arms are brought to 0..255 first, each tensor by its own range. A seed that one arm alone has is an error.
    In this order: non-finite FAIL; shapes differ PASS if declared distinct, else FAIL; declared identical: any delta over
    ``tol`` FAIL, else PASS; all deltas within ``tol`` FAIL (unexpected equality, no p-value); not distributional
    PASS; sizes vary with the seed FAIL; PASS if p <= alpha and effect > min_effect, else FAIL, which does not show
    that the arms are equal.
    """
    if declared not in ("distinct", "identical"):
        raise ValueError("declared is distinct or identical")
    if not 0 < alpha < 1 or (permutations is not None and permutations < 99):
        raise ValueError("alpha lies within 0 and 1, and permutations are 99 or more")
    seen = matched_deltas(a, b).agg(
        F.count(F.lit(1)).alias("n_seeds"), F.count_if(~F.col("matched")).alias("n_lone"), F.bool_and("finite").alias("finite"), F.bool_and("same_size").alias("same_size"), F.max("max_abs").alias("max_abs"), F.avg("mae").alias("mae"), F.count_if(F.col("max_abs") > tol).alias("n_over"), F.count_distinct("nx").alias("sizes"),
    )
    first = seen.first()
    n = int(first["n_seeds"])
    if n == 0:
        raise ValueError("no seed is in both arms")
    if first["n_lone"]:
        raise ValueError(f"{first['n_lone']} seeds are in one arm only")
    if distributional and n < 4:
        raise ValueError("a distributional test needs four seeds")
    wanted = distributional and declared == "distinct" and first["finite"] and first["same_size"] and first["n_over"] > 0 and first["sizes"] == 1
    if wanted:  # the distances are worth their cost only now
        test = energy_test(pair_matrix(a, b), n, permutations, permutation_seed).first()
        seen = seen.withColumns({k: F.lit(test[k]).cast(t) for k, t in (("effect", "double"), ("exceed", "long"), ("n_draws", "long"), ("p_value", "double"))})
    else:
        seen = seen.withColumns({"effect": F.lit(None).cast("double"), "exceed": F.lit(None).cast("long"), "n_draws": F.lit(None).cast("long"), "p_value": F.lit(None).cast("double")})
    same = F.lit(declared == "identical")
    status = (
        F.when(~F.col("finite"), "FAIL").when(~F.col("same_size"), "FAIL" if declared == "identical" else "PASS").when(same, F.when(F.col("n_over") > 0, "FAIL").otherwise("PASS"))
        .when(F.col("n_over") == 0, "FAIL").when(F.lit(not distributional), "PASS").when(F.col("sizes") > 1, "FAIL").when((F.col("p_value") <= alpha) & (F.col("effect") > min_effect), "PASS").otherwise("FAIL")
    )
    message = (
        F.when(~F.col("finite"), "non-finite values").when(~F.col("same_size"), "shapes differ").when(same, F.when(F.col("n_over") > 0, "arms differ").otherwise("arms are identical"))
        .when(F.col("n_over") == 0, "unexpected equality").when(F.lit(not distributional), "arms differ").when(F.col("sizes") > 1, "shapes vary with the seed").when(status == "PASS", "distributions differ").otherwise("no difference shown; not proof of equality")
    )
    return seen.select(F.lit(subject).alias("subject"), status.alias("status"), message.alias("message"), "n_seeds", F.round("max_abs", 6).alias("max_abs"), F.round("mae", 6).alias("mae"), "n_over", F.round("effect", 6).alias("effect"), "exceed", "n_draws", F.round("p_value", 6).alias("p_value"))
