"""Temperature mixing of sources, in DataFrame operations only.

Source token shares p are raised to an exponent t in [0, 1] and normalised: w = p**t / sum p**t. The exponent is
found by repeated sectioning (each round narrows the bracket sixteen-fold with one small aggregation): the largest
t whose weights reach a target entropy, and not under the smallest t that repeats no source more often than a
limit. A source's repeats are then realised as blocks: whole passes over its documents, and one last pass that is
cut, in the order of a keyed permutation, where its token budget ends.

The cut is one threshold a source. It is found from sums over permutation buckets (aggregated before the shuffle),
prefix sums over groups of buckets, then over the buckets of the one group in which the budget ends, and a running sum
within its one bucket, so no task sees more of a source than a bucket or the square root of their number.
Documents themselves are never shuffled: the final pass is a scan and a filter. It counts words anew, as keeping the
counts beside the documents would mean writing the corpus once more.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import quoted, stage_table

#: Weights tables of up to so many sources are broadcast (under 10 MB); larger ones are joined by salted keys.
BROADCAST_SOURCES, SALTS = 50_000, 64
SECTIONS, ROUNDS, BUCKET_ROWS = 16, 9, 4096
ADDED = ("mix_block", "mix_place", "mix_tokens")
_KEY_BITS = 60
_BLANKS = " \t\n\x0b\x0c\r"


def count_words(text: Column) -> Column:
    """Runs of anything but ASCII white space; null has none."""
    bare = F.btrim(text, F.lit(_BLANKS))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def _source_key() -> Column:
    return F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))


def _order_key(seed: int, source: Column, block: Column, doc_id: Column) -> Column:
    """The place of a document in a block's permutation: 60 bits of an MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), source, block.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def find_exponent(sources: DataFrame, target_entropy: float | None, max_repeats: float | None, budget_tokens: float | None) -> float:
    """The exponent for ``sources`` (tokens over 0). ``target_entropy``: a share of the largest entropy possible."""
    total, most, least, n = sources.agg(F.sum("tokens"), F.max("tokens"), F.min("tokens"), F.count(F.lit(1))).first()
    if not n or n == 1 or most == least:
        return 1.0
    p = F.col("tokens") / F.lit(float(total))

    def meets(ts: list[float]) -> list[tuple[float, float]]:
        """For each exponent: the entropy of the weights, and the most repeats of a source."""
        row = sources.agg(*(x for t in ts for x in (F.sum(F.pow(p, F.lit(t))), F.sum(F.pow(p, F.lit(t)) * F.lit(t) * F.log(p)), F.sum(F.col("tokens") * F.pow(F.lit(float(most)) / F.col("tokens"), F.lit(1 - t)))))).first()
        out = []
        for i, t in enumerate(ts):
            z, s, spread = row[3 * i : 3 * i + 3]
            scale = budget_tokens / spread if budget_tokens else 1.0
            out.append((math.log(z) - s / z, scale * (most / least) ** (1 - t)))
        return out

    def section(good) -> tuple[float, float]:
        """Bracket of the exponent where ``good`` (true at small exponents) turns false."""
        lo, hi = 0.0, 1.0
        for _ in range(ROUNDS):
            ts = [lo + (hi - lo) * k / SECTIONS for k in range(1, SECTIONS)]
            told = [good(x) for x in meets(ts)]
            at = next((k for k, ok in enumerate(told) if not ok), len(ts))
            lo, hi = (ts[at - 1] if at else lo), (ts[at] if at < len(ts) else hi)
        return lo, hi

    t = 1.0
    if target_entropy is not None:
        ends = meets([1.0])[0][0]
        if ends < target_entropy * math.log(n):
            t = section(lambda x: x[0] >= target_entropy * math.log(n))[0]
    elif max_repeats is not None:
        t = 0.0
    if max_repeats is not None and meets([t])[0][1] > max_repeats:
        t = max(t, section(lambda x: x[1] > max_repeats)[1])
    return t


def plan(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = 2.0, budget_tokens: int | None = None, seed: int = 7) -> tuple[DataFrame, int]:
    """(a row a source: key, tokens, n_docs, weight, repeats, whole, cut_key, cut_doc; the number of sources).

    ``budget_tokens``: tokens of the mixture; by default the least that shows every document at least once.
    """
    rows = stage_table(docs.select(_source_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), count_words(F.col("text")).alias("tokens")), "tokens")
    sources = stage_table(rows.groupBy("key").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs")), "sources")
    spoken = sources.where("tokens > 0")
    t = find_exponent(spoken, target_entropy, max_repeats, budget_tokens)
    n_sources, n_docs, most = sources.agg(F.count(F.lit(1)), F.sum("n_docs"), F.max("tokens")).first()
    raw = F.pow(F.lit(float(most or 0)) / F.col("tokens"), F.lit(1 - t))
    spread = spoken.agg(F.sum(F.col("tokens") * raw)).first()[0] or 1.0
    scale = budget_tokens / spread if budget_tokens else 1.0
    weighed = sources.select(
        "key", "tokens", "n_docs",
        F.when(F.col("tokens") > 0, F.col("tokens") * raw / F.lit(spread)).otherwise(F.lit(0.0)).alias("weight"),
        F.when(F.col("tokens") > 0, raw * F.lit(scale)).otherwise(F.lit(1.0)).alias("repeats"),
    ).withColumn("whole", F.floor("repeats").cast("int")).withColumn("part", F.when(F.col("tokens") > 0, (F.col("repeats") - F.col("whole")) * F.col("tokens")).otherwise(F.lit(0.0)))
    bits = max(0, math.ceil(math.log2(max(1, (n_docs or 0) / BUCKET_ROWS))))
    cut = _join(rows, weighed.where("part > 0").select("key", "whole", "part"), n_sources, "inner", "tokens")
    cut = cut.withColumn("place", _order_key(seed, F.col("key"), F.col("whole"), F.col("doc_id"))).withColumn("bucket", F.shiftright("place", _KEY_BITS - bits))
    sums = stage_table(cut.groupBy("key", "bucket").agg(F.sum("tokens").alias("sum"), F.first("part").alias("part")), "buckets")
    group = F.shiftright("bucket", bits // 2)
    groups = sums.groupBy("key", group.alias("group")).agg(F.sum("sum").alias("sum"), F.first("part").alias("part"))

    def ending_in(rows: DataFrame, name: str, before: Column | None = None) -> DataFrame:
        """The row of each source in which its budget ends, and the tokens before it."""
        upto = F.sum("sum").over(Window.partitionBy("key").orderBy(name)) + (before if before is not None else F.lit(0))
        found = rows.withColumn("upto", upto).where("upto > part and upto - sum <= part")
        return found.select("key", name, (F.col("upto") - F.col("sum")).alias("before"))

    outer = ending_in(groups, "group")
    inner = sums.withColumn("group", group).join(outer, ["key", "group"])
    ends = ending_in(inner, "bucket", F.col("before"))
    ending = cut.join(ends, ["key", "bucket"])
    running = ending.withColumn("upto", F.col("before") + F.sum("tokens").over(Window.partitionBy("key", "bucket").orderBy("place", F.coalesce("doc_id", F.lit((1 << 63) - 1)))))
    inside = running.where("upto <= part").groupBy("key").agg(F.max(F.struct("place", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"))).alias("top"))
    found = ends.join(inside, "key", "left").select("key", F.coalesce("top.place", F.shiftleft(F.col("bucket"), _KEY_BITS - bits) - 1).alias("cut_key"), F.coalesce("top.doc", F.lit((1 << 63) - 1)).alias("cut_doc"))
    return stage_table(weighed.join(found, "key", "left"), "mixture"), n_sources


def _join(rows: DataFrame, small: DataFrame, n_sources: int, how: str, spread_by: str) -> DataFrame:
    """Join by source. A small side of checked size is broadcast; beyond it both sides are salted, so that the
    rows of a source that holds a third of the table go to many tasks."""
    if n_sources <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(small), "key", how)
    salted = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", spread_by), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"], how).drop("salt")


def mix(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = 2.0, budget_tokens: int | None = None, seed: int = 7) -> DataFrame:
    """The columns of ``docs`` (doc_id, text, source and any others), a row a realised copy, and mix_block (the pass,
    from 0), mix_place (its place in the pass's permutation), mix_tokens. Columns of these three names in ``docs`` (a
    mixture mixed again) are replaced.

    A last pass holds the longest run of its permutation whose tokens don't exceed what is left of the source's
    budget. Null is a source of its own. Null, empty and blank texts have no tokens and come along where their
    place falls; a source without tokens comes once. Rows that share source and doc_id share their place and are
    in or out together. Sources of equal share get equal weights. An empty table gives an empty result.
    """
    sources, n = plan(docs, target_entropy, max_repeats, budget_tokens, seed)
    names = [c for c in docs.columns if c not in ADDED]
    rows = docs.select(F.struct(*(F.col(q).alias(c) for c, q in zip(names, quoted(names), strict=True))).alias("row"), _source_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), count_words(F.col("text")).alias("mix_tokens"))
    joined = _join(rows, sources.select("key", "whole", "cut_key", "cut_doc"), n, "inner", "mix_tokens")
    last = _order_key(seed, F.col("key"), F.col("whole"), F.col("doc_id"))
    doc = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    inside = F.col("cut_key").isNotNull() & ((last < F.col("cut_key")) | ((last == F.col("cut_key")) & (doc <= F.col("cut_doc"))))
    passes = F.col("whole") + F.when(inside, 1).otherwise(0)
    blocks = joined.where(passes > 0).withColumn("mix_block", F.explode(F.sequence(F.lit(0), passes - 1)))
    return blocks.select(*(F.col("row")[c].alias(c) for c in names), "mix_block", _order_key(seed, F.col("key"), F.col("mix_block"), F.col("doc_id")).alias("mix_place"), "mix_tokens")
