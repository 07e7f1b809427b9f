"""Substring dedup: repeated fixed-length word windows, found by Rabin-Karp hashes.

Plan, for documents of any number:

1. Each map task hashes its windows in numpy. A word's symbol is its XXH64; a window's hash is the Rabin-Karp
   polynomial of its symbols in two bases, 64 bits of the one and ``EXTRA`` bytes of the other. Within the task a
   window that also starts in a smaller document of the same task is settled at once; of every distinct window
   only one (hash, smallest document) is sent on. A window in a third of all documents therefore costs
   one entry a task, not one a document.
2. The entries are sent as blocks, one row a (task, hash bucket): while blocks are large, sorted hash deltas and
   documents in byte planes, compressed; where a table is so large that a task has few windows a bucket, plain
   records cut out of one buffer without a call a block. The number of buckets follows the table's size, and the
   number of shuffle partitions that of buckets.
3. Each bucket counts its hashes, finds the smallest document of each and returns (document, first hash) for the
   entries that a smaller document beats; within one document the first hash tells its windows apart.
4. Documents meet their settled hashes in one join; marked windows merge into maximal intervals.

Two different windows share all 64 + 8 bits with probability n**2 / 2**73 over a corpus of n windows (1e-4 for 1e9
windows, the words of 5 GB). Each byte more of ``extra`` costs a byte a window in the shuffle and makes that 65,536
times less: 4 bytes give n**2 / 2**97, next to nothing at 100 TB.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 13
#: Bytes of the second hash that are kept beside the first.
EXTRA = 1
#: Distinct windows that a bucket holds on average, buckets at most, windows a map task gathers before it sends them,
#: bytes of text hashed at once, buckets a shuffle partition holds, and windows from which on a block is compressed.
BUCKET_WINDOWS, MAX_BITS, FLUSH_WINDOWS, CHUNK_BYTES, PART_BUCKETS, PACK_FROM = 500_000, 22, 2_000_000, 2_000_000, 4, 64
#: Words whose symbols a Python worker keeps.
CACHE_WORDS = 200_000
#: Documents without an id come behind all others, each distinct text at a place of its own.
NULL_IDS, NULL_BITS = (1 << 63) - (1 << 60), 60

_U = np.uint64
_BASES = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)


class _Symbols(dict):
    """XXH64 of words, computed once while they are kept."""

    def __missing__(self, word: bytes) -> int:
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


_symbols = _Symbols()


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def window_hashes(texts: list[bytes], window: int = WINDOW, extra: int = EXTRA) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second hash of each window of ``window`` consecutive words, and the index of its text, in order of
    place. A window never reaches over two texts."""
    if len(_symbols) > CACHE_WORDS:
        _symbols.clear()
    words = [t.split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    symbols = np.fromiter(map(_symbols.__getitem__, chain.from_iterable(words)), _U, int(sizes.sum()))
    n = len(symbols) - window + 1
    if n <= 0:
        return np.empty(0, _U), np.empty(0, _U), np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    whole = owner[:n] == owner[window - 1 :]
    found = []
    for base in _BASES[: 1 + (extra > 0)]:
        total = np.zeros(n, _U)
        for k in range(window):
            total *= base
            total += symbols[k : k + n]
        found.append(_mix(total[whole]))
    return found[0], found[1] >> _U(64 - 8 * extra) if extra else np.zeros_like(found[0]), owner[:n][whole]


def _order(hashes: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """The order by first, then second hash. Equal first hashes with different second ones are next to none."""
    order = np.argsort(hashes, kind="stable")
    h, x = hashes[order], extra[order]
    return np.lexsort((extra, hashes)) if ((h[1:] == h[:-1]) & (x[1:] != x[:-1])).any() else order


def _smallest(hashes: np.ndarray, extra: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hashes sorted, their documents, starts of the equal runs, and each run's smallest document."""
    order = _order(hashes, extra)
    hashes, extra, docs = hashes[order], extra[order], docs[order]
    first = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (extra[1:] != extra[:-1])]) if len(hashes) else np.empty(0, np.int64)
    least = np.minimum.reduceat(docs, first) if len(hashes) else docs
    return hashes, extra, docs, first, least


def _records(hashes: np.ndarray, extra: np.ndarray, width: int, docs: np.ndarray) -> np.ndarray:
    """Rows of bytes: hash, second hash, document."""
    bytes_of = lambda a: np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8)
    return np.concatenate([bytes_of(hashes.astype("<u8")), bytes_of(extra.astype("<u8"))[:, :width], bytes_of(docs.astype("<i8"))], axis=1)


def _read(raw: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = np.frombuffer(raw, np.uint8).reshape(-1, 16 + width)
    whole = np.zeros((len(rows), 8), np.uint8)
    whole[:, :width] = rows[:, 8 : 8 + width]
    number = lambda a, kind: np.ascontiguousarray(a).view(kind).reshape(-1)
    return number(rows[:, :8], "<u8"), number(whole, "<u8"), number(rows[:, 8 + width :], "<i8")


def _pack(hashes: np.ndarray, extra: np.ndarray, width: int, docs: np.ndarray) -> bytes:
    """Records in byte planes, compressed, hashes as differences."""
    return zstandard.ZstdCompressor(level=1).compress(_records(np.diff(hashes, prepend=_U(0)), extra, width, docs).T.tobytes())


def _unpack(blob: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(16 + width, -1)
    deltas, extra, docs = _read(np.ascontiguousarray(planes.T).tobytes(), width)
    return np.cumsum(deltas, dtype=_U), extra, docs


def _cut(rows: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Rows of bytes as binary values, one from each start to the next, all in one buffer."""
    width = rows.shape[1]
    offsets = (np.r_[starts, len(rows)] * width).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _runs(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, np.int64)


#: Rows between the steps. bucket: where a block is counted. key: the document whose windows are settled; or null, and
#: the block holds windows to count. packed: the block is compressed.
_SENT = ["bucket", "key", "packed", "block"]
_SENT_DDL = "bucket long, key long, packed boolean, block binary"


def _sent(bucket: np.ndarray, key: np.ndarray | None, packed: bool, block: pa.Array) -> Iterator[pa.RecordBatch]:
    n = len(block)
    keys = pa.nulls(n, pa.int64()) if key is None else pa.array(key, pa.int64())
    yield from pa.Table.from_arrays([pa.array(bucket, pa.int64()), keys, pa.array(np.full(n, packed)), block], names=_SENT).to_batches(max_chunksize=256 if packed else 20_000)


def _sender(window: int, bits: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            h, x, d, first, least = _smallest(*(np.concatenate(c) for c in zip(*found, strict=True)))
            found.clear()
            beaten = np.flatnonzero(d > np.repeat(least, np.diff(np.r_[first, len(h)])))
            if len(beaten):
                beaten = beaten[np.argsort(d[beaten], kind="stable")]
                bh, bd = h[beaten], d[beaten]
                keep = np.r_[True, (bh[1:] != bh[:-1]) | (bd[1:] != bd[:-1])]
                bh, bd = bh[keep], bd[keep]
                starts = _runs(bd)
                yield from _sent(bd[starts] & ((1 << bits) - 1), bd[starts], False, _cut(bh.astype("<u8").view(np.uint8).reshape(-1, 8), starts))
            h, x = h[first], x[first]
            buckets = (h >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
            starts = _runs(buckets)
            if len(h) < PACK_FROM * len(starts):
                yield from _sent(buckets[starts], None, False, _cut(_records(h, x, width, least), starts))
            else:
                blocks = [_pack(h[s:e], x[s:e], width, least[s:e]) for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(h)], strict=True)]
                yield from _sent(buckets[starts], None, True, pa.array(blocks, pa.binary()))

        def take(texts: list[bytes], keys: list[int]) -> int:
            h, x, owner = window_hashes(texts, window, width)
            found.append((h, x, np.array(keys, np.int64)[owner]))
            return len(h)

        for batch in batches:
            texts: list[bytes] = []
            keys: list[int] = []
            size = 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                texts.append((text.as_py() or "").encode())
                keys.append(key)
                size += len(texts[-1])
                if size >= CHUNK_BYTES:
                    held += take(texts, keys)
                    texts, keys, size = [], [], 0
                    if held >= FLUSH_WINDOWS:
                        yield from flush()
                        held = 0
            if texts:
                held += take(texts, keys)
        if held:
            yield from flush()

    return run


def _counter(width: int):
    """Blocks sorted by bucket -> a document and the hash of a settled window, or the block of several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found = None, []

        def settle() -> Iterator[pa.RecordBatch]:
            if len(found) > 1:  # within one block nothing repeats
                h, x, d, first, least = _smallest(*(np.concatenate(c) for c in zip(*found, strict=True)))
                beaten = np.flatnonzero(d > np.repeat(least, np.diff(np.r_[first, len(h)])))
                if n := len(beaten):
                    yield from pa.Table.from_arrays([pa.array(d[beaten], pa.int64()), pa.array(h[beaten].view(np.int64)), pa.nulls(n, pa.binary())], names=["key", "hash", "block"]).to_batches(max_chunksize=20_000)

        for batch in batches:
            key = batch.column(1)
            own = key.is_valid()
            if own.true_count:
                yield pa.RecordBatch.from_arrays([key.filter(own), pa.nulls(own.true_count, pa.int64()), batch.column(3).filter(own)], names=["key", "hash", "block"])
            rest = batch.filter(key.is_null())
            for bucket, packed, block in zip(rest.column(0).to_pylist(), rest.column(2).to_pylist(), rest.column(3).to_pylist(), strict=True):
                if bucket != now:
                    yield from settle()
                    now, found = bucket, []
                found.append(_unpack(block, width) if packed else _read(block, width))
        yield from settle()

    return run


def cut_words(text: str | None, marked: np.ndarray, window: int) -> tuple[list[bytes], np.ndarray]:
    """The words of a text and a flag for each: whether a window whose first hash is in ``marked`` covers it."""
    raw = (text or "").encode()
    words = raw.split()
    gone = np.zeros(len(words), bool)
    if len(marked) and len(words) >= window:
        hit = np.flatnonzero(np.isin(window_hashes([raw], window, 0)[0], marked))
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
    return words, gone


def _spans(gone: np.ndarray) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
    return [{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2], strict=True)]


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept", pa.string())])


def _applier(window: int, with_text: bool):
    schema = _RESULT if with_text else pa.schema(list(_RESULT)[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                out: dict[str, list] = {f.name: [] for f in schema}
                for doc_id, text, single, blocks in zip(*(c.to_pylist() for c in whole.slice(at, 512).columns), strict=True):
                    marked = np.frombuffer(np.array(single or (), "<i8").tobytes() + b"".join(blocks or ()), "<u8")
                    words, gone = cut_words(text, marked, window)
                    kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words)
                    row = {"doc_id": doc_id, "n_words": len(words), "n_removed": int(gone.sum()), "kept_sha256": hashlib.sha256(kept).hexdigest(), "removed": _spans(gone)}
                    if with_text:
                        row["kept"] = kept.decode()
                    for k, v in row.items():
                        out[k].append(v)
                yield pa.RecordBatch.from_pydict(out, schema)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = True, extra: int = EXTRA) -> DataFrame:
    """Drop the words that a window covers whose word sequence also starts in a smaller document.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored, whatever their names. Result, one row a
    row: doc_id, n_words, n_removed, kept_sha256, removed (maximal intervals of word positions, end exclusive)
    and, unless ``with_text`` is false, kept (the words left, joined by one space).

    Null and empty texts: no words, nothing removed. A null doc_id is taken as 2**63 - 2**60 and 60 bits of the text's
    XXH64 (seed 42): such rows sort after all usual ids, equal ones are one document, and no key gathers them.
    Rows that share a doc_id are one document's parts: they never remove each other's words, and a window settled for
    the id goes from each of them. Texts of under ``window`` words keep all. An empty table gives an empty result.
    ``extra``: bytes of the second hash.
    """
    named = F.lit(NULL_IDS) + F.xxhash64("text").bitwiseAND(F.lit((1 << NULL_BITS) - 1))
    key = F.coalesce(F.col("doc_id").cast("long"), named)
    keyed = docs.select(key.alias("key"), "text")
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MAX_BITS, max(6, int(np.ceil(np.log2(max(1, size / 6 / BUCKET_WINDOWS))))))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (1 << bits) // PART_BUCKETS)
    sent = keyed.mapInArrow(_sender(window, bits, extra), _SENT_DDL)
    settled = sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_counter(extra), "key long, hash long, block binary")
    settled = settled.groupBy("key").agg(F.collect_list("hash").alias("single"), F.collect_list("block").alias("blocks"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", key.alias("key"))
    joined = rows.join(settled, "key", "left").select("doc_id", "text", "single", "blocks")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:int,end:int>>" + ", kept string" * with_text
    return joined.mapInArrow(_applier(window, with_text), schema)
