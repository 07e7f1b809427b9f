"""SimHash near-dedup by anchor-point covering.

Two fingerprints that differ in at most ``threshold`` = 3 of 64 bits differ in at most one bit of one half
(pigeonhole), so each 32-bit half is covered on its own with threshold 1. The covering code of a half is the
perfect [31, 26] Hamming code beside one free bit: 2**27 anchors, covering radius 1. A fingerprint's home is its
anchor within radius 1; it is replicated to every anchor within covering radius plus threshold = 2 (17 anchors,
or 2 for a codeword). If x and y are within 1 in a half, y reaches x's home: comparing homes with visitors per
anchor loses no link. The copies a fingerprint makes are 34 at most, whatever the table's size.

Equal fingerprints are one node, so a group of exact copies costs one comparison. Per anchor the pairs aren't
listed: a union-find over the anchor's own fingerprints sends on at most one link a fingerprint. An anchor with
more than ``hot`` fingerprints is not compared in its task: its members pass to a second covering of the other
half (quarters, [15, 11] Hamming code beside one bit, same argument, as a pair there is within 3 of 32 bits)
and from there, should one still be hot, to blocks of it that are compared block against block. Anchors that are
very hot are known beforehand from the anchors of ``SAMPLE`` fingerprints, and their members take that way without
meeting in a task first. Which way an anchor goes never changes a link: the sample spares time only, and an anchor
that it misses is passed on by its task while it is read, ``hot`` rows held at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, drop_staged, quoted, stage_table, staged
from .components import components

THRESHOLD, SHINGLE, SEED = 3, 3, 42
#: An anchor with more fingerprints than this goes to the second covering, and in blocks of this beyond it.
HOT = 8192
#: Fingerprints whose anchors are counted beforehand, how many of them make an anchor suspect, and suspects at most.
SAMPLE, SUSPECT, SUSPECTS = 100_000, 30, 10_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a whole text: a bit is 1 if it is set in over half of the shingles' XXH64 hashes."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = (starts + lengths)[shingle - 1 :].tolist()
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends, strict=False)]), np.uint8).reshape(-1, 8)
    n = len(hashes)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        counts += np.unpackbits(hashes[at : at + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return run


def _hamming(n: int) -> tuple[np.ndarray, np.ndarray]:
    """For the perfect Hamming code of length n = 2**r - 1 over positions 1..n: the position's bit for each
    syndrome (0 for none), and, for a point at distance 1, the pairs of positions whose flips lead from syndrome s
    to a codeword."""
    flip = np.zeros(n + 1, np.uint32)
    flip[1:] = np.uint32(1) << np.arange(n, dtype=np.uint32)
    pairs = np.zeros((n + 1, n // 2), np.uint32)
    for s in range(1, n + 1):
        pairs[s] = [flip[a] | flip[a ^ s] for a in range(1, n + 1) if a < a ^ s]
    return flip, pairs


def _syndrome(x: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(x), np.uint32)
    for j in range(n):
        out ^= ((x >> np.uint32(j)) & np.uint32(1)) * np.uint32(j + 1)
    return out


_CODES = {n: _hamming(n) for n in (31, 15)}


def anchors(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of points of n + 1 bits: (point, anchor, home) for every anchor within 2 of the point, home set for
    its nearest one within the free bit's half."""
    flip, pairs = _CODES[n]
    x = x.astype(np.uint32)
    s = _syndrome(x & np.uint32((1 << n) - 1), n)
    near = x ^ flip[s]  # the code's word at distance 0 or 1; the free bit stays
    at = np.arange(len(x))
    off = np.flatnonzero(s)
    far = (x[off, None] ^ pairs[s[off]]).reshape(-1)
    points = np.concatenate([at, at, np.repeat(off, n // 2)])
    return points, np.concatenate([near, near ^ np.uint32(1 << n), far]), np.concatenate([np.ones(len(x), bool), np.zeros(len(x) + len(far), bool)])


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, doc) -> (anchor, fp, doc, home): anchor is the half and its codeword."""
    for batch in batches:
        for part in pa.Table.from_batches([batch]).to_batches(max_chunksize=4096):
            fps, docs = (c.to_numpy(zero_copy_only=False) for c in part.columns)
            for half in (0, 1):
                points, words, home = anchors((fps.view(np.uint64) >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF), 31)
                key = words.astype(np.int64) * 2 + half
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[points]), pa.array(docs[points]), pa.array(home)], names=["anchor", "fp", "doc", "home"])


def _spread_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A hot anchor's members, covered once more by the quarters of the half that their anchor leaves open. The
    home of the first covering stays a condition: only its homes are homes here."""
    for batch in batches:
        for part in pa.Table.from_batches([batch]).to_batches(max_chunksize=4096):
            keys, fps, docs, was = (c.to_numpy(zero_copy_only=False) for c in part.columns)
            for quarter in (0, 1):
                shift = (np.uint64(32) * (np.uint64(1) - (keys & 1).astype(np.uint64))) + np.uint64(16 * quarter)
                points, words, home = anchors((fps.view(np.uint64) >> shift) & np.uint64(0xFFFF), 15)
                second = (words.astype(np.int64) * 2 + quarter)
                yield pa.RecordBatch.from_arrays([pa.array(keys[points]), pa.array(second), pa.array(fps[points]), pa.array(docs[points]), pa.array(home & was[points])], names=["anchor", "second", "fp", "doc", "home"])


def _forest(fps: np.ndarray, docs: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what homes and visitors within the threshold connect: each document to the smallest."""
    order = np.argsort(docs, kind="stable")
    fps, docs, home = fps[order].view(np.uint64), docs[order], home[order]
    keep = np.r_[True, docs[1:] != docs[:-1]]
    if not keep.all():  # a document that came as a home and as a visitor is both
        group = np.cumsum(keep) - 1
        home = np.bincount(group, home) > 0
        fps, docs = fps[keep], docs[keep]
    root = np.arange(len(docs))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in np.flatnonzero(home).tolist():
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= threshold)
        near = near[root[near] != root[i]]
        for j in near.tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
    tops = np.array([find(i) for i in range(len(root))], np.int64) if len(root) else root
    linked = tops != np.arange(len(root))
    return docs[linked], docs[tops[linked]]


_LINKS = "anchor long, fp long, doc long, home boolean, a long, b long"


def _compare(threshold: int, hot: int | None, by: tuple[str, ...]):
    """Rows sorted by anchor -> links, and the members of anchors over ``hot`` as they came."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        key = None

        def settle() -> pd.DataFrame | None:
            group = held[0] if len(held) == 1 else pd.concat(held)
            if len(group) < 2:
                return None
            if hot is not None and len(group) > hot:
                return group.assign(a=None, b=None)[["anchor", "fp", "doc", "home", "a", "b"]]
            if not group["home"].to_numpy().any():
                return None
            a, b = _forest(group["fp"].to_numpy(), group["doc"].to_numpy(), group["home"].to_numpy(), threshold)
            return pd.DataFrame({"anchor": None, "fp": None, "doc": None, "home": None, "a": a, "b": b}) if len(a) else None

        for frame in frames:
            values = [frame[c].to_numpy() for c in by]
            change = np.zeros(len(frame), bool)
            for v in values:
                change[1:] |= v[1:] != v[:-1]
            cut = np.r_[0, np.flatnonzero(change), len(frame)]
            found = []
            for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if s == e:
                    continue
                here = tuple(int(v[s]) for v in values)
                if here != key:
                    if held and (out := settle()) is not None:
                        found.append(out)
                    key, held = here, []
                held.append(frame.iloc[s:e])
            if found:
                yield pd.concat(found)
        if held and (out := settle()) is not None:
            yield out

    return run


def _compare_numbers(threshold: int, hot: int):
    """As :func:`_compare` for the first covering, without a frame for each of its many small anchors. Of the anchor
    that the end of a batch cuts, rows are held until there are over ``hot``; then they go on as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[tuple] = []  # of one anchor
        passing: int | None = None  # the anchor whose rows go on

        def members(keys, fps, docs, home) -> pa.RecordBatch:
            none = pa.nulls(len(keys), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps), pa.array(docs), pa.array(home), none, none], names=["anchor", "fp", "doc", "home", "a", "b"])

        def groups(keys, fps, docs, home) -> Iterator[pa.RecordBatch]:
            cut = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
            sizes = np.diff(cut)
            a: list[np.ndarray] = []
            b: list[np.ndarray] = []
            pair = cut[:-1][sizes == 2]  # most anchors with company: two fingerprints
            near = (np.bitwise_count(fps[pair].view(np.uint64) ^ fps[pair + 1].view(np.uint64)) <= threshold) & (home[pair] | home[pair + 1])
            a.append(docs[pair[near]])
            b.append(docs[pair[near] + 1])
            for k in np.flatnonzero(sizes > 2).tolist():
                s, e = cut[k], cut[k + 1]
                if e - s > hot:
                    yield members(keys[s:e], fps[s:e], docs[s:e], home[s:e])
                elif home[s:e].any():
                    x, y = _forest(fps[s:e], docs[s:e], home[s:e], threshold)
                    a.append(x)
                    b.append(y)
            a, b = np.concatenate(a), np.concatenate(b)
            if n := len(a):
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.array(a), pa.array(b)], names=["anchor", "fp", "doc", "home", "a", "b"])

        for batch in batches:
            new = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(new[0]):
                continue
            if passing is not None:
                end = int(np.searchsorted(new[0], passing, side="right"))
                if end:
                    yield members(*(x[:end] for x in new))
                if end == len(new[0]):
                    continue
                passing, new = None, tuple(x[end:] for x in new)
            if rest and rest[0][0][0] == new[0][-1]:  # the batch is all of the anchor that is held
                rest.append(new)
            else:
                last = int(np.searchsorted(new[0], new[0][-1], side="left"))
                whole = [tuple(x[:last] for x in new)] if last else []
                if rest or whole:
                    yield from groups(*(np.concatenate(x) for x in zip(*rest, *whole, strict=True)))
                rest = [tuple(x[last:] for x in new)]
            if sum(len(x[0]) for x in rest) > hot:
                passing = int(rest[0][0][0])
                for held in rest:
                    yield members(*held)
                rest = []
        if rest:
            yield from groups(*(np.concatenate(x) for x in zip(*rest, strict=True)))

    return run


def _blocks(members: DataFrame, block: int) -> DataFrame:
    """Anchors of the second covering: those of at most ``block`` members as they are; larger ones as pairs of
    blocks, each compared with each, so that no task holds more than two blocks of one anchor."""
    sizes = members.groupBy("anchor", "second").agg(F.count(F.lit(1)).alias("n"))
    parts = members.join(sizes, ["anchor", "second"]).withColumn("parts", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("doc"), F.col("parts").cast("long")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least("own", o).alias("p"), F.greatest("own", o).alias("q")))
    return parts.select("anchor", "second", "fp", "doc", "home", F.explode(pairs).alias("pair")).select("anchor", "second", "pair.p", "pair.q", "fp", "doc", "home")


def link_fingerprints(nodes: DataFrame, threshold: int = THRESHOLD, hot: int = HOT) -> DataFrame:
    """Links (a, b) that connect the documents of ``nodes`` (fp long distinct, doc long distinct) exactly as all
    pairs of fingerprints within ``threshold`` (3 or fewer) bits connect them."""
    return _links_and_paths(nodes, threshold, hot)[0]


def _links_and_paths(nodes: DataFrame, threshold: int, hot: int) -> tuple[DataFrame, list[str]]:
    """The links, and the staged tables that they are read from."""
    if threshold > THRESHOLD:
        raise ValueError("the two halves cover thresholds up to 3")
    kinds = "anchor long, fp long, doc long, home boolean"
    spread = nodes.select("fp", "doc").mapInArrow(_spread, kinds)
    suspects = _suspects(nodes, hot)
    far = None
    if suspects:
        marked = spread.withColumn("suspect", F.col("anchor").isin(suspects))
        spread, far = marked.where("not suspect").drop("suspect"), marked.where("suspect").drop("suspect")
    first, first_path = staged(spread.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare_numbers(threshold, hot), _LINKS), "anchors")
    links = first.where("a is not null").select("a", "b")
    members = first.where("a is null").select("anchor", "fp", "doc", "home")
    if far is not None:
        members = members.union(far)
    paths = [first_path]
    if not members.isEmpty():
        keys = ("anchor", "second", "p", "q")
        again = _blocks(members.mapInArrow(_spread_again, "anchor long, second long, fp long, doc long, home boolean"), hot)
        second, second_path = staged(again.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(_compare(threshold, None, keys), _LINKS), "blocks")
        links = links.union(second.select("a", "b"))
        paths.append(second_path)
    return links, paths


def _suspects(nodes: DataFrame, hot: int) -> list[int]:
    """Anchors that hold so many of SAMPLE fingerprints that all of them would be over ``hot``: SUSPECTS at most, a
    bound on what is sent to the tasks. None in small tables."""
    n = nodes.count()
    if n <= hot:
        return []
    share = min(1.0, SAMPLE / n)
    some = nodes.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 40)) < int(share * (1 << 40))).select("fp", "doc")
    counts = some.mapInArrow(_spread, "anchor long, fp long, doc long, home boolean").groupBy("anchor").count()
    found = counts.where(F.col("count") > max(SUSPECT, hot * share)).orderBy(F.desc("count"), "anchor").limit(SUSPECTS)
    return sorted(r.anchor for r in found.collect())


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """One row a row of ``docs`` (doc_id, text; other columns are ignored): doc_id, fingerprint (16 lowercase hex
    digits), component_id (the smallest doc_id that links reach, its own included).

    Words are runs of anything but ASCII white space, A-Z in lower case; with fewer than ``shingle`` words the
    whole sequence is the one shingle. Null and empty texts have fingerprint zero and link like any other. A
    null doc_id sorts after all others; its component is null only where no row of the component has an id.
    Repeated rows each get their row. An empty table gives an empty result.
    """
    prints = stage_table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints(shingle), "doc_id long, fp long"), "prints")
    key = F.coalesce("doc_id", F.lit(NO_ID))
    nodes = stage_table(prints.groupBy("fp").agg(F.min(key).alias("first")).withColumn("doc", F.col("fp")), "nodes")
    links, paths = _links_and_paths(nodes.select("fp", "doc"), threshold, hot)
    found = components(links)  # has read all links into a table of its own
    for path in paths:
        drop_staged(docs.sparkSession, path)
    roots = found.select(F.col("node").alias("fp"), "root")
    tops = nodes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = tops.groupBy("root").agg(F.min("first").alias("least"))
    of = tops.join(least, "root").select("fp", F.when(F.col("least") != NO_ID, F.col("least")).alias("component_id"))
    return prints.join(of, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows whose doc_id is their component's smallest: one document of each group, with all its columns.
    Rows without an id are kept. Of repeated rows with the kept id all stay. An empty table gives an empty result."""
    found = near_duplicates(docs, **options)
    gone = found.where("doc_id is not null and component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*quoted(docs.columns))
