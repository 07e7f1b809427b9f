"""Best-fit packing with certified repacking.

Each partition packs its pieces best-fit decreasing and bounds its bin count from below by dual feasible
functions. A partition that meets its bound is done. One with a gap keeps its tight bins and releases its loosest
ones; the released pieces of all partitions are dealt anew over as few partitions as hold them, until one
partition remains, which keeps its bins. A partition releases at most half of its pieces, so each round has at most
half the pieces of the one before, and rounds are as many as the logarithm of the table's size. A partition holds
``PART_PIECES`` pieces or so, whatever that size is.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

CAPACITY, END_ID, PART_PIECES = 1024, 2, 25_000
#: Words whose ids a Python worker keeps, in two generations of this many. Ids are kept as the machine's unsigned
#: 32-bit integers, little-endian on all that Spark runs on here.
CACHE_WORDS = 500_000


class _Encoder:
    """Ids of whole texts. A pre-token never reaches over a single space between two other characters, so a text is
    cut there, and the ids of its words are kept: words repeat much more than texts. Plain words are pre-tokenized
    here and go to the library's merges; all else goes to its full encoder."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.merge = self.model.model.tokenize
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.byte_level = str(self.model.pre_tokenizer) == "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)" and self.model.normalizer is None
        #: The pattern of byte-level pre-tokenizers (a fixed value), and their letters for bytes: the printable ones stand for themselves.
        self.pre = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = iter(range(256, 512))
        self.letters = {b: b if b in plain else next(other) for b in range(256)}
        self.safe_cut = regex.compile(r"(?<=\S)(?= \S)").split
        #: Ids of a word behind a space, by word, None where it can't be cut off there; of whole pieces; of pre-tokens.
        self.new: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}
        self.pieces: dict[str, bytes] = {}
        self.tokens: dict[str, bytes] = {}

    def _token(self, piece: str) -> bytes:
        got = self.tokens.get(piece)
        if got is None:
            got = array("I", [t.id for t in self.merge(piece.encode().decode("latin-1").translate(self.letters))]).tobytes()
            if len(self.tokens) > CACHE_WORDS:
                self.tokens.clear()
            self.tokens[piece] = got
        return got

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece of text that starts or ends at safe places."""
        if self.byte_level and piece and max(piece) < "\u0530":
            if piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha()):
                return self._token(piece)
            if piece.replace("\n", "").isprintable() and not any(map(piece.__contains__, self.added)):
                return b"".join(map(self._token, self.pre(piece)))
        return array("I", self.model.encode(piece, add_special_tokens=False).ids).tobytes()

    def _start(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            got = self._piece(piece)
            if len(piece) < 64:
                if len(self.pieces) > CACHE_WORDS // 8:
                    self.pieces.clear()
                self.pieces[piece] = got
        return got

    def learn(self, words: set[str]) -> None:
        if len(self.new) > CACHE_WORDS:
            self.old, self.new = self.new, {}
        for w in words.difference(self.new):
            self.new[w] = self.old[w] if w in self.old else self._piece(" " + w) if w and not w[0].isspace() and not w[-1].isspace() else None

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [t.split(" ") for t in texts]
        starts = [words.pop(0) for words in split]
        self.learn(set().union(*split))
        get = self.new.__getitem__
        out = []
        for text, first, words in zip(texts, starts, split, strict=True):
            try:
                if words and (not first or first[-1].isspace()):
                    raise TypeError
                out.append(self._start(first) + b"".join(map(get, words)))
            except TypeError:  # a word that can't be cut off
                out.append(b"".join(map(self._start, self.safe_cut(text))))
        return out


_encoders: dict[str, _Encoder] = {}


def pieces_of(ids: bytes, capacity: int = CAPACITY, end_id: int = END_ID) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids with the end id; only the first of several may be short."""
    ids += end_id.to_bytes(4, "little")
    n = len(ids) // 4
    first = n if n <= capacity else n % capacity or capacity
    cuts = [0, *range(first, n + 1, capacity)]
    return [(k, s, e - s, zlib.crc32(ids[4 * s : 4 * e])) for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]


def _cutter(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(path) or _encoders.setdefault(path, _Encoder(path))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    rows += [(doc_id, *p) for p in pieces_of(ids, capacity, end_id)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that the lengths need at least: the best of three families of dual feasible functions, which are the
    sum, u_k (over capacity - k counts whole, under k nothing) and the rounding functions of Fekete and Schepers."""
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1)[: capacity + 1].astype(np.int64), capacity)


def bound_of_counts(count: np.ndarray, capacity: int = CAPACITY) -> int:
    """:func:`lower_bound` of ``count[n]`` pieces of each length n."""
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    many, total = np.cumsum(count), np.cumsum(count * size)
    for k in range(1, capacity // 2 + 1):
        whole = int(many[capacity] - many[capacity - k])
        middle = int(total[capacity - k] - total[k - 1])
        best = max(best, whole - (-middle // capacity))
    for k in range(1, 64):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, scaled * k, (scaled // capacity) * capacity * (k + 1))  # in units of capacity * k * (k + 1)
        best = max(best, -(-int((count * value).sum()) // (capacity * k * (k + 1))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each of the lengths, which come in falling order, and the room left in each bin."""
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    room: list[int] = []
    mask = 0  # bit r: a bin with room r is open
    for i, n in enumerate(lengths.tolist()):
        fits = mask >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = with_room[r].pop()
            if not with_room[r]:
                mask ^= 1 << r
        else:
            b, r = len(room), capacity
            room.append(capacity)
        bins[i], offsets[i] = b, capacity - r
        left = r - n
        room[b] = left
        if left:
            with_room[left].append(b)
            mask |= 1 << left
    return bins, offsets, np.array(room, np.int64)


def loose_bins(bins: np.ndarray, room: np.ndarray, wanted: int) -> np.ndarray:
    """The ``wanted`` loosest bins, fewer where they would hold over half of all pieces; full bins never."""
    order = np.argsort(-room, kind="stable")[:wanted]
    order = order[room[order] > 0]
    held = np.cumsum(np.bincount(bins, minlength=len(room))[order])
    return order[: np.searchsorted(held, len(bins) // 2, side="right")]


def _packer(round_no: int, capacity: int, last: bool):
    """Rows sorted by falling length -> the same rows with their place and the partition's certificate; released
    ones without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        lengths = table.column("length").to_numpy()
        bins, offsets, room = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        gap = len(room) - bound
        part = (np.int64(round_no) << 56) + (np.int64(TaskContext.get().partitionId()) << 32)
        kept = np.ones(len(bins), bool)
        if gap and not last:
            kept = ~np.isin(bins, loose_bins(bins, room, max(8, 6 * gap)))
        n = len(bins)
        for name, values in (("sequence_id", part + bins), ("offset", offsets), ("part", np.full(n, part)), ("part_bins", np.full(n, len(room))), ("part_bound", np.full(n, bound))):
            table = table.append_column(name, pa.array(values, pa.int64(), mask=~kept))
        yield from table.to_batches(max_chunksize=20_000)

    return run


_PIECE = "uid long, doc_id long, piece long, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of ``docs`` (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cutter(tokenizer, capacity, end_id), "doc_id long, piece long, start long, length long, ids_crc32 long")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, part_pieces: int = PART_PIECES) -> DataFrame:
    """``pieces`` (uid, doc_id, piece, start, length, ids_crc32) with sequence_id, offset, and the certificate of the
    partition that packed them: its number, the bins it used and the bins that its pieces need at least. Pieces
    that fill a sequence alone have no partition."""
    columns = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "part", "part_bins", "part_bound")
    none = F.lit(None).cast("long")
    full = pieces.where(F.col("length") >= capacity).withColumns({"sequence_id": F.lit(1 << 62) + F.col("uid"), "offset": F.lit(0).cast("long"), "part": none, "part_bins": none, "part_bound": none})
    done = [full.select(*columns)]
    rest = pieces.where(F.col("length") < capacity)
    round_no = 0
    while True:
        parts = max(1, math.ceil(rest.count() / part_pieces))
        last = parts == 1
        dealt = (rest.repartition(1) if last else rest.repartition(parts, "uid")).sortWithinPartitions(F.desc("length"), "uid")
        packed, _ = staged(dealt.mapInArrow(_packer(round_no, capacity, last), _PIECE + ", sequence_id long, offset long, part long, part_bins long, part_bound long"), "packed")
        done.append(packed.where("sequence_id is not null").select(*columns))
        if last:
            break
        rest, round_no = packed.where("sequence_id is null").select(*(c.split()[0] for c in _PIECE.split(", "))), round_no + 1
        if rest.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: pieces, tokens, sequences used, and the least number that any packing of all the pieces needs. The
    lengths are counted in Spark; at most ``capacity`` counts come to the driver."""
    counts = packed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    every = np.zeros(capacity + 1, np.int64)
    for r in counts:
        every[r.length] = r.n
    told = packed.agg(F.count(F.lit(1)).alias("pieces"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"), F.count_distinct("sequence_id").alias("sequences"))
    return told.withColumn("bound", F.lit(bound_of_counts(every, capacity)).cast("long"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, part_pieces: int = PART_PIECES) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the certificate columns of
    :func:`pack_pieces`.

    Needs ``doc_id`` and ``text``; other columns are ignored. Null and empty texts are the end id alone. Repeated
    rows and ids are packed once each row. Special strings in a text are read as the tokenizer's file reads them.
    An empty table gives an empty result. ``tokenizer``: path of a tokenizer file of the ``tokenizers`` library.
    """
    pieces, _ = staged(cut_pieces(docs, tokenizer, capacity, end_id).select(F.monotonically_increasing_id().alias("uid"), "*"), "pieces")
    return pack_pieces(pieces, capacity, part_pieces)
