"""Secret scans with multipart credential linking, in DataFrame operations only.

Base kinds stand alone: ``assign`` (a keyword with a value of 12 characters or more), ``access`` (AKIA
identifiers of 18 or more) and ``hex`` (16 or more hex digits). Weak kinds are candidates that mean nothing by
themselves: ``weak_access`` (short AKIA and other identifier prefixes), ``weak_secret`` (a run of 40 base64
characters exactly, whatever else stands beside it) and ``endpoint`` (a URL or an API host name). A credential has complementary parts, so a weak
candidate is reported only where they co-occur within its scope, the ``reach`` code points on either side:

* a weak access identifier beside a secret part (assign or weak_secret),
* a weak secret beside an access part (access or weak_access),
* an endpoint beside both an access part and a secret part.

The co-occurrence is an interval join: parts are bucketed by place, candidates look into their own bucket and the
neighbours, and gaps are compared. Parts have a least length and don't overlap within a kind, so a bucket holds a
bounded number of them however long or dense a text is. Texts are scanned once and never shuffled; only
parts of texts that hold weak candidates are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, stage_table

REACH = 400

_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind, pattern, whether the length of group 2 decides, cheap test before it.
_BASE = (("assign", _ASSIGN, 12, None), ("access", "AKIA[A-Z0-9]{14,}", 0, "AKIA"), ("hex", "[0-9a-f]{16,}", 0, None))
_WEAK = (
    ("weak_access", "AKIA[A-Z0-9]{8,13}(?![A-Z0-9])|(?:ASIA|AROA|AIDA|AGPA|ANPA)[A-Z0-9]{12,}", 0, None),
    ("weak_secret", "(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])", 0, None),
    # A host name begins where its letters do: else a long unbroken text would be read from each of its places.
    ("endpoint", r"""https?://[^\x20\x09-\x0D"'<>]{4,}|(?<![A-Za-z0-9.-])[A-Za-z0-9.-]{3,}\.(?:amazonaws\.com|googleapis\.com|windows\.net)""", 0, None),
)
#: The order of kinds that start at the same place.
KINDS = [k for k, *_ in (*_BASE, *_WEAK)]
_SPAN = "array<struct<start:int,ord:int,end:int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scan(items: Column, total: Callable[[Column], Column], carry: Callable[[Column, Column], Column], begin: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """A running computation along an array, in about n ** 1.5 moves instead of n ** 2: the array is cut into chunks
    of the square root of its length, a chunk's ``total`` is carried on over the chunks before it, and ``step``
    appends within a chunk to what begins with the value carried there (a struct of ``at`` and ``out``)."""

    def of(items: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(items))).cast("int"))
        starts = F.sequence(F.lit(0), F.size(items) - 1, width)
        return _let(F.transform(starts, lambda at: F.slice(items, at + 1, width)), chunks)

    def chunks(parts: Column) -> Column:
        totals = F.transform(parts, total)
        bases = F.aggregate(totals, F.array(begin), lambda acc, t: F.concat(acc, F.array(carry(F.element_at(acc, -1), t))))
        return _let(bases, lambda base: F.flatten(F.transform(parts, lambda part, c: F.aggregate(part, F.struct(F.get(base, c).alias("at"), F.array().cast(kind).alias("out")), step, lambda acc: acc["out"]))))

    return F.when(F.size(items) > 0, _let(items, of)).otherwise(F.array().cast(kind))


def _spans(text: Column, kind: str, pattern: str, least: int, contains: str | None) -> Column:
    """Spans of the leftmost non-overlapping matches, code points, end exclusive: the lengths of matches and of
    the pieces between them, summed up. Failing matches count as read, then drop."""
    ord_ = F.lit(KINDS.index(kind))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + x["size"]
        span = F.array(F.struct(begin.alias("start"), ord_.alias("ord"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["value"] >= least, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def moves(found: Column) -> Column:
        pieces = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if least else found
        zipped = F.arrays_zip(F.transform(found, F.length).alias("size"), F.transform(pieces, F.length).alias("gap"), F.transform(value, F.length).alias("value"))
        along = lambda part: F.aggregate(part, F.lit(0), lambda n, x: n + x["gap"] + x["size"])
        return _scan(zipped, along, lambda a, b: a + b, F.lit(0), step, _SPAN)

    test = F.contains(text, F.lit(contains)) if contains else text.rlike(pattern)
    return F.when(test, _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), moves)).otherwise(F.array().cast(_SPAN))


def _parts(docs: DataFrame, *keep: Column) -> DataFrame:
    """keep, row, base (three arrays), weak: one scan of the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*keep, F.monotonically_increasing_id().alias("row"), *(_spans(text, *k).alias(k[0]) for k in _BASE), F.concat(*(_spans(text, *k) for k in _WEAK)).alias("weak"))


def _linked(parts: DataFrame, reach: int) -> DataFrame:
    """row, linked: the weak candidates of a row that complementary parts confirm."""
    some = parts.where(F.size("weak") > 0)
    bucket = lambda c: F.floor(F.col(c) / reach).cast("long")
    weak = some.select("row", F.inline("weak"))
    asked = weak.select("row", "start", "ord", "end", F.explode(F.sequence(bucket("start") - 1, F.floor((F.col("end") + reach) / reach).cast("long"))).alias("bucket"))
    # A part is found in each bucket it lies in, so that a long one is near both of its ends.
    role = F.when(F.col("ord").isin(KINDS.index("assign"), KINDS.index("weak_secret")), "secret").when(F.col("ord").isin(KINDS.index("access"), KINDS.index("weak_access")), "access")
    there = some.select("row", F.inline(F.concat("assign", "access", "weak"))).select("row", role.alias("role"), F.col("start").alias("a"), F.col("end").alias("b"), F.explode(F.sequence(bucket("start"), bucket("end"))).alias("bucket")).where("role is not null")
    near = asked.join(there, ["row", "bucket"]).where((F.col("a") < F.col("end") + reach) & (F.col("b") > F.col("start") - reach) & ((F.col("a") != F.col("start")) | (F.col("b") != F.col("end"))))
    seen = near.groupBy("row", "start", "ord", "end").agg(F.bool_or(F.col("role") == "access").alias("access"), F.bool_or(F.col("role") == "secret").alias("secret"))
    kind = lambda k: F.col("ord") == KINDS.index(k)
    told = (kind("weak_access") & F.col("secret")) | (kind("weak_secret") & F.col("access")) | (kind("endpoint") & F.col("access") & F.col("secret"))
    return seen.where(told).groupBy("row").agg(F.collect_list(F.struct("start", "ord", "end")).alias("linked"))


def _joined(spans: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["ord"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """One row a row of ``docs`` (doc_id, text; other columns are ignored): doc_id, base (base spans), found (all
    spans, with start, ord and end in order of place, then of KINDS).

    Null and empty texts have no spans. Rows that share a doc_id are apart. Spans of different kinds may overlap;
    a candidate that coincides with a part of another kind does not confirm itself. An empty table gives an
    empty result.
    """
    parts = stage_table(_parts(docs, F.col("doc_id").cast("long").alias("doc_id")), "secrets")
    base = F.concat("assign", "access", "hex")
    told = parts.join(_linked(parts, reach), "row", "left")
    return told.select("doc_id", F.array_sort(base).alias("base"), F.array_sort(F.concat(base, F.coalesce("linked", F.array().cast(_SPAN)))).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of a :func:`find_secrets` result."""
    count = lambda k: F.size(F.filter("base", lambda s: s["ord"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def redact(docs: DataFrame, reach: int = REACH, mask: str = "[REDACTED]") -> DataFrame:
    """``docs`` (text, n_chars if there, and any others) with each run of overlapping or touching spans replaced by
    ``mask``. Rows without a span are unchanged, null texts included. An empty table gives an empty result with the
    columns of ``docs``, types included."""
    names = docs.columns
    parts = stage_table(_parts(docs, F.struct(*(F.col(q).alias(c) for c, q in zip(names, quoted(names), strict=True))).alias("doc")), "redact")
    linked = _linked(parts.drop("doc"), reach)
    base = F.concat("assign", "access", "hex")
    alone = parts.where(F.size("weak") == 0).select("doc", F.array_sort(base).alias("found"))
    beside = parts.where(F.size("weak") > 0).join(linked, "row", "left").select("doc", F.array_sort(F.concat(base, F.coalesce("linked", F.array().cast(_SPAN)))).alias("found"))
    # Each span with the furthest end of those before it: a run begins where that lies before the span.
    far = lambda part: F.array_max(F.transform(part, lambda x: x["end"]))
    seen = lambda acc, x: F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], F.array(F.struct(x["start"].alias("s"), acc["at"].alias("far")))).alias("out"))
    heads = F.filter(_scan(F.col("found"), far, lambda a, b: F.greatest(a, b), F.lit(-1), seen, "array<struct<s:int,far:int>>"), lambda x: x["s"] > x["far"])
    told = alone.union(beside).select("doc", "found", heads.alias("heads"))
    last = F.array_max(F.transform("found", lambda x: x["end"]))
    # The text left before each run, from the end of the run before: (from, length). The text is cut in two steps, so
    # that finding a place never walks the whole text for each run.
    gaps = F.transform("heads", lambda h, i: F.struct(F.when(i == 0, F.lit(0)).otherwise(h["far"]).alias("b"), h["s"].alias("e")))
    told = told.select("doc", gaps.alias("gaps"), last.alias("last"))
    text = F.col("doc")["text"]

    def cut(gaps: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(gaps))).cast("int"))
        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(gaps) - 1, width), lambda at: _let(F.slice(gaps, at + 1, width), stretch)), "")

    def stretch(some: Column) -> Column:
        begin = F.get(some, F.lit(0))["b"]
        own = F.substring(text, begin + 1, F.element_at(some, -1)["e"] - begin)
        return _let(own, lambda t: F.array_join(F.transform(some, lambda g: F.concat(F.substring(t, g["b"] - begin + 1, g["e"] - g["b"]), F.lit(mask))), ""))

    none = F.size("gaps") == 0
    clean = F.when(none, text).otherwise(F.concat(_let(F.col("gaps"), cut), F.substring(text, F.col("last") + 1, F.length(text))))
    done = told.select("doc", clean.alias("clean"), none.alias("none"))
    new = {"text": F.col("clean")}
    if "n_chars" in names:
        new["n_chars"] = F.when(F.col("none"), F.col("doc")["n_chars"]).otherwise(F.length("clean")).cast(docs.schema["n_chars"].dataType)
    return done.select(*(new.get(c, F.col("doc")[c]).alias(c) for c in names))
