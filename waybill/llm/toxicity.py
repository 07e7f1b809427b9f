"""Toxicity by a gap-weighted subsequence kernel, Nystroem landmarks and a linear support vector machine.

Kernel: a unit (a word without its punctuation, or a run of single letters) and a landmark (a short string) are as
alike as the best window of the unit: the normalised subsequence kernel of order 3 counts their common
subsequences, each weighted by ``DECAY`` to the length it spans, so inserted, dropped and spaced-out characters
lower the value and don't end it. A sentence has, for each landmark, the largest value of its units.

Landmarks are learned: substrings of words that are significantly more frequent in toxic training documents, chosen
greedily so that each covers toxic documents that the ones before don't. Words of three letters are landmarks as
they are, alike to a whole unit only; of units over ``UNIT_LETTERS`` (scripts without spaces) all substrings of 3 to 10
letters are counted. Insults of one or two letters are under the kernel's order and can't be learned. Sentences are mapped by Nystroem
(K_mm**-1/2) and separated by a squared-hinge SVM. Only documents are labelled, so the sentence labels of a toxic
document are settled in turns (multiple-instance learning): its highest-scoring sentence is positive, all sentences
of clean documents are negative. A document's score is the calibrated (Platt) value of its best sentence.

Fitting uses at most ``MAX_TRAIN_DOCS`` labelled documents, chosen by a hash of their ids; scoring reads all texts.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage_table

ORDER, DECAY = 3, 0.7
MAX_TRAIN_DOCS, MAX_WORDS, MAX_LANDMARKS = 30_000, 3_000, 48
#: Kernel values under this count as 0; letters that a window may have beyond the landmark's; units longer than this many letters are read in overlapping windows.
FLOOR, GAP, UNIT_LETTERS = 0.5, 3, 24
CLEAN_COST, CACHE_WORDS = 5, 250_000
#: Letters of a landmark at most; marks before a substring counted in a long unit, and before a landmark that is a whole unit.
LONGEST, PIECE, WHOLE = 10, "+", "="
_LEET = str.maketrans("013457@", "oieasta")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_LETTERS = re.compile(r"[\W_]+").sub
_MARKS = ".,;:!?%*&#$|()[]{}<>\"'`~^_-+=/\\@"


def unit(token: str) -> str:
    """Letters of a token in lower case; digits within it that stand for letters count as those."""
    bare = token.lower().strip(_MARKS)
    if not bare.isalpha():
        bare = _LETTERS("", bare.translate(_LEET) if sum(map(str.isdigit, bare)) <= 2 else bare)
    return bare


def spaced(tokens: list[str]) -> list[str]:
    """Runs of three or more tokens of one letter, joined: words that were spaced out."""
    if sum(map((1).__eq__, map(len, tokens))) < 3:
        return []
    out, run = [], []
    for t in [*tokens, ""]:
        bare = unit(t)
        if len(bare) == 1:
            run.append(bare)
        else:
            if len(run) >= 3:
                out.append("".join(run))
            run = []
    return out


def _codes(words: list[str], width: int) -> np.ndarray:
    """Letters as their code points, 0 past the end."""
    return np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), width)


def subsequence_kernel(a: np.ndarray, b: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Gap-weighted subsequence kernel of each row of ``a`` with the row of ``b`` (letters, 0 past the end)."""
    n, la, lb = len(a), a.shape[1], b.shape[1]
    same = (a[:, :, None] == b[:, None, :]) & (a != 0)[:, :, None]
    inner = np.ones((n, la + 1, lb + 1))
    for _ in range(order - 1):
        new = np.zeros((n, la + 1, lb + 1))
        for i in range(la):
            row = np.zeros(n)
            for j in range(lb):
                row = decay * row + decay * decay * np.where(same[:, i, j], inner[:, i, j], 0.0)
                new[:, i + 1, j + 1] = decay * new[:, i, j + 1] + row
        inner = new
    return decay * decay * np.where(same, inner[:, :la, :lb], 0.0).sum(axis=(1, 2))


def _common(codes: np.ndarray, landmark: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each row with a landmark, bit-parallel."""
    m = len(landmark)
    masks = np.zeros(sys.maxunicode + 1, np.uint32)
    for j, c in enumerate(landmark):
        masks[c] |= np.uint32(1 << j)
    v = np.full(len(codes), (1 << m) - 1, np.uint32)
    for i in range(codes.shape[1]):
        u = v & masks[codes[:, i]]
        v = (v + u) | (v - u)
    return m - np.bitwise_count(v & np.uint32((1 << m) - 1))


def _span(word: str, letters: str) -> tuple[int, int]:
    """The shortest stretch of ``word`` that holds ``letters`` in order; (0, 0) without any."""
    best = (0, 0)
    at = word.find(letters[0])
    while at >= 0:
        end = at
        for c in letters[1:]:
            end = word.find(c, end + 1)
            if end < 0:
                return best
        if not best[1] or end + 1 - at < best[1] - best[0]:
            best = (at, end + 1)
        at = word.find(letters[0], at + 1)
    return best


def _windows(word: str, landmark: str) -> set[str]:
    """Stretches of a word that may be alike: they hold the landmark, or from six letters on all but one of its
    letters, over at most GAP more letters than it has."""
    forms = [landmark] + [landmark[:i] + landmark[i + 1 :] for i in range(len(landmark))] * (len(landmark) >= 6)
    spans = (_span(word, f) for f in forms)
    return {word[s:e] for s, e in spans if ORDER <= e - s <= len(landmark) + GAP}


def kernel_values(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Words (rows) by landmarks: the best window's normalised kernel, 0 under FLOOR."""
    out = np.zeros((len(words), len(landmarks)), np.float32)
    if whole := {x[1:]: j for j, x in enumerate(landmarks) if x[0] == WHOLE}:
        for i, w in enumerate(words):
            if (j := whole.get(w)) is not None:
                out[i, j] = 1.0
    step = UNIT_LETTERS // 2
    parts = [(w[at : at + UNIT_LETTERS], i) for i, w in enumerate(words) for at in range(0, max(1, len(w) - step), step)]
    parts.sort(key=lambda p: len(p[0]))
    pairs: list[tuple[str, int, int]] = []
    for at in range(0, len(parts), 8192):
        some = parts[at : at + 8192]
        codes = _codes([p for p, _ in some], max(1, len(some[-1][0])))
        for j, landmark in enumerate(landmarks):
            if landmark[0] == WHOLE:
                continue
            need = len(landmark) - (len(landmark) >= 6)
            for k in np.flatnonzero(_common(codes, _codes([landmark], len(landmark))[0]) >= need).tolist():
                part, i = some[k]
                if landmark in part:
                    out[i, j] = 1.0
                elif out[i, j] < 1:
                    pairs += [(w, i, j) for w in _windows(part, landmark)]
    for at in range(0, len(pairs), 8192):
        windows, rows, columns = zip(*pairs[at : at + 8192], strict=True)
        a = _codes(list(windows), max(map(len, windows)))
        b = _codes([landmarks[j] for j in columns], max(map(len, landmarks)))
        alike = subsequence_kernel(a, b) / np.sqrt(subsequence_kernel(a, a) * subsequence_kernel(b, b))
        alike[alike < FLOOR] = 0
        np.maximum.at(out, (list(rows), list(columns)), alike.astype(np.float32))
    return out


@dataclass
class Model:
    """landmarks; beta: the SVM's weights on kernel values; bias; Platt's slope and shift."""

    landmarks: list[str]
    beta: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, decision: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * decision + self.shift, -500, 500))))


class _Reader:
    """Kernel values of tokens, kept in two generations: 0 for the many without any."""

    def __init__(self, landmarks: list[str]) -> None:
        self.landmarks = landmarks
        self.new: dict[str, np.ndarray | int] = {}
        self.old: dict[str, np.ndarray | int] = {}

    def turn(self) -> None:
        """Between blocks of texts only: the tokens of a block stay known while it is read."""
        if len(self.new) > CACHE_WORDS:
            self.old, self.new = self.new, {}

    def learn(self, tokens: set[str]) -> None:
        unknown = []
        for t in tokens.difference(self.new):
            if (known := self.old.get(t)) is None:
                unknown.append(t)
            else:
                self.new[t] = known
        if not unknown:
            return
        units = [unit(t) for t in unknown]
        words = sorted({u for u in units if len(u) >= ORDER})
        values = kernel_values(words, self.landmarks) if words else np.zeros((0, len(self.landmarks)), np.float32)
        some = values.any(axis=1)
        known = {w: values[i] for i, w in enumerate(words) if some[i]}
        for t, u in zip(unknown, units, strict=True):
            self.new[t] = known.get(u, 0)

    def sentences(self, text: str, tokens: list[str]) -> list[np.ndarray]:
        """Kernel values of the sentences that have any. ``tokens`` of the text are learned already."""
        new = self.new
        apart = spaced(tokens)
        if apart:
            self.learn(set(apart))
        if not any(type(new[t]) is not int for t in set(tokens)) and not any(type(new[t]) is not int for t in apart):
            return []
        found = []
        for sentence in _SENTENCE.split(text):
            own = sentence.split()
            hits = [new[t] for t in {*own, *(spaced(own) if apart else ())} if type(new.get(t, 0)) is not int]
            if hits:
                found.append(np.max(hits, axis=0))
        if not found:
            found = [np.max([new[t] for t in apart if type(new[t]) is not int], axis=0)]
        return found


def _texts(batches: Iterator[pa.RecordBatch], reader: _Reader, rows: int = 256) -> Iterator[tuple[list, list[str], list[list[str]]]]:
    """Other columns, texts and tokens by the block, tokens learned."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            *rest, texts = (c.to_pylist() for c in part.columns)
            texts = [t or "" for t in texts]
            tokens = [t.split() for t in texts]
            reader.turn()
            reader.learn(set().union(*tokens))
            yield rest, texts, tokens


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) -> (unit, documents of either label), added up in the task. Of long units the substrings."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def out() -> pa.RecordBatch:
        names = list(counts[0].keys() | counts[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][w] for w in names], pa.int64()), pa.array([counts[0][w] for w in names], pa.int64())], names=["unit", "pos", "neg"])

    for batch in batches:
        for toxic, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            units = {unit(t) for t in set((text or "").split())}
            long = [u for u in units if len(u) > UNIT_LETTERS]
            counts[toxic].update(u for u in units if ORDER <= len(u) <= UNIT_LETTERS)
            for k in range(ORDER, LONGEST + 1) if long else (0,):
                if k:
                    counts[toxic].update({PIECE + u[s : s + k] for u in long for s in range(len(u) - k + 1)})
                if sum(map(len, counts)) > 400_000:
                    yield out()
                    counts = (Counter(), Counter())
    yield out()


def _automaton(subs: list[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, s in enumerate(subs):
        found.add_word(s, i)
    found.make_automaton()
    return found


def _holder(subs: list[str]):
    """unit -> the substrings that it holds, or that it is as a whole."""
    machine = _automaton(subs)
    whole = {x[1:]: i for i, x in enumerate(subs) if x[0] == WHOLE}

    def held(word: str) -> set[int]:
        found = {i for _, i in machine.iter(word)}
        return found | {whole[word]} if word in whole else found

    return held


def _held(subs: list[str]):
    """(unit, pos, neg) -> sums of the units that hold each substring; those of long units are told one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _holder(subs)
        index = {x: i for i, x in enumerate(subs)}
        sums = np.zeros((2, len(subs)), np.int64)
        for batch in batches:
            for word, pos, neg in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for i in held(word) if word[0] != PIECE else {index[word[1:]]} if word[1:] in index else ():
                    sums[0, i] += pos
                    sums[1, i] += neg
        some = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(sums[0, some]), pa.array(sums[1, some])], names=["sub", "pos", "neg"])

    return run


def _covered(subs: list[str]):
    """(text) -> the substrings that each text holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _holder(subs)
        for batch in batches:
            rows = [sorted({i for w in {unit(t) for t in (text or "").split()} for i in held(w)}) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32()))], names=["subs"])

    return run


def _choose(rows: list[list[int]], subs: list[str], clean: list[float], most: int, cover: int = 3) -> list[str]:
    """Greedy cover: each toxic document up to ``cover`` times. A substring gains the documents that it covers anew
    less CLEAN_COST for each clean document that holds it; of equal gains the longer, then the first by
    name. A substring that lies in a chosen one, or holds one, adds nothing and goes."""
    holds: dict[int, set[int]] = {}
    for d, row in enumerate(rows):
        for i in row:
            holds.setdefault(i, set()).add(d)
    need = [cover] * len(rows)
    chosen: list[str] = []
    while holds and len(chosen) < most:
        gain, _, _, i = max((sum(need[d] > 0 for d in h) - CLEAN_COST * clean[i], len(subs[i]), [-ord(c) for c in subs[i]], i) for i, h in holds.items())
        if gain < 2:
            break
        chosen.append(subs[i])
        for d in holds[i]:
            need[d] -= 1
        holds = {k: h for k, h in holds.items() if subs[k] not in subs[i] and subs[i] not in subs[k] and len(h & holds[i]) < 0.95 * len(h)}
    return chosen


def _sentence_rows(landmarks: list[str], most: int = 4):
    """(doc, toxic, text) -> kernel values of sentences: of a toxic document all, of a clean one the heaviest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(landmarks)
        for (docs, toxic), texts, tokens in _texts(batches, reader):
            ids, labels, rows = [], [], []
            for d, y, text, own in zip(docs, toxic, texts, tokens, strict=True):
                found = reader.sentences(text, own) or [np.zeros(len(landmarks), np.float32)]
                found.sort(key=lambda x: -float(x.sum()))
                for x in found[: most * (1 + 4 * y)]:
                    ids.append(d)
                    labels.append(y)
                    rows.append(x.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int32()), pa.array(rows, pa.list_(pa.float32()))], names=["doc", "toxic", "x"])

    return run


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (bias last) of the squared-hinge SVM, by Newton steps in the primal."""
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    keep = np.eye(len(w)) * ridge
    keep[-1, -1] = 1e-6
    for _ in range(30):
        live = y * (a @ w) < 1
        al, c = a[live], weight[live][:, None]
        new = np.linalg.solve(keep + al.T @ (al * c), al.T @ (c[:, 0] * y[live]))
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    return w


def _platt(d: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic regression of labels on decisions, with Platt's softened targets."""
    pos, neg = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, w = np.c_[d, np.ones(len(d))], np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.eye(2) * 1e-3, a.T @ (target - p) - 1e-3 * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-7:
            break
    return float(w[0]), float(w[1])


def train_fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> Model:
    """The model of the labelled documents whose crc32(doc_id as text) mod 4 is not 2. Without documents of both
    labels it scores every text the share of toxic ones."""
    known = labels.where("doc_id is not null and toxic is not null").where(train_fold(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    bounded = known.orderBy(F.xxhash64("doc"), "doc").limit(max_docs)
    train = stage_table(docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(F.broadcast(bounded), "doc"), "labelled")
    n, n_pos = train.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n_pos or n_pos == n:
        p = (n_pos + 1) / (n + 2)
        return Model([], np.zeros(0), 0.0, 0.0, float(np.log(p / (1 - p))))
    vocabulary = stage_table(train.select("toxic", "text").mapInArrow(_counted, "unit string, pos long, neg long").groupBy("unit").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "vocabulary")
    df = F.col("pos") + F.col("neg")
    lift = F.col("pos") * (n - n_pos) - F.col("neg") * n_pos
    chi = F.lit(float(n)) * F.pow(lift.cast("double"), 2) / (df * (n - df) * F.lit(float(n_pos) * (n - n_pos)))
    words = [r.unit for r in vocabulary.where((df < n) & (lift > 0) & (F.col("pos") >= 3)).withColumn("chi", chi).where("chi > 20").orderBy(F.desc("chi"), "unit").limit(MAX_WORDS).collect()]
    subs = {w[1:] for w in words if w[0] == PIECE} | {WHOLE + w for w in words if len(w) == ORDER}
    subs = sorted(subs | {w[s : s + k] for w in words if w[0] != PIECE for k in range(ORDER + 1, LONGEST + 1) for s in range(len(w) - k + 1)})
    chosen: list[str] = []
    if subs:
        sums = vocabulary.mapInArrow(_held(subs), "sub long, pos long, neg long").groupBy("sub").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect()
        some = sorted((subs[r["sub"]], float(r["neg"])) for r in sums if r["pos"] >= 3 and r["pos"] * (n - n_pos) >= 9 * r["neg"] * n_pos)
        if some:
            names = [x for x, _ in some]
            rows = [r.subs for r in train.where("toxic = 1").select("text").mapInArrow(_covered(names), "subs array<int>").collect()]
            chosen = _choose(rows, names, [c for _, c in some], MAX_LANDMARKS)
    if not chosen:
        p = (n_pos + 1) / (n + 2)
        return Model([], np.zeros(0), 0.0, 0.0, float(np.log(p / (1 - p))))
    rows = train.select("doc", "toxic", "text").mapInArrow(_sentence_rows(chosen), "doc long, toxic int, x array<float>").toPandas()
    return _fit(chosen, np.stack(rows["x"].to_numpy()).astype(float), rows["toxic"].to_numpy(), rows["doc"].to_numpy())


def _fit(landmarks: list[str], x: np.ndarray, toxic: np.ndarray, doc: np.ndarray) -> Model:
    gram = np.eye(len(landmarks))
    plain = [x.removeprefix(WHOLE) for x in landmarks]
    for j, b in enumerate(landmarks):
        for i, a in enumerate(landmarks):
            gram[i, j] = max(kernel_values([plain[i]], [b])[0, 0], kernel_values([plain[j]], [a])[0, 0])
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T
    z = x @ root
    _, group = np.unique(doc, return_inverse=True)
    label = np.zeros(group.max() + 1)
    label[group] = toxic
    score = x.sum(axis=1)
    positive = (toxic > 0) & (score > 0)
    w = np.zeros(len(landmarks) + 1)
    for _ in range(8):
        order = np.lexsort((-score, group))
        best = order[np.r_[True, group[order][1:] != group[order][:-1]]]  # each document's best sentence
        positive[best] |= toxic[best] > 0
        use = np.flatnonzero((toxic == 0) | positive)
        y = np.where(positive[use], 1.0, -1.0)
        share = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
        new = _svm(z[use], y, np.minimum(share, 4.0))
        if np.abs(new - w).max() < 1e-6:
            break
        w, score = new, z @ new[:-1] + new[-1]
        positive = (toxic > 0) & (score > 0)
    top = np.full(len(label), -np.inf)
    np.maximum.at(top, group, z @ w[:-1] + w[-1])
    slope, shift = _platt(top, label)
    return Model(landmarks, root @ w[:-1], float(w[-1]), slope, shift)


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(model.landmarks)
        plain = model.score(model.bias)
        for (ids,), texts, tokens in _texts(batches, reader):
            scores = []
            for text, own in zip(texts, tokens, strict=True):
                found = reader.sentences(text, own) if model.landmarks else []
                scores.append(max(plain, model.score(float((np.stack(found) @ model.beta).max()) + model.bias)) if found else plain)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], names=["id", "score"])

    return run


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """One row a row of ``docs`` (doc_id, text; others are ignored): doc_id, held_out, score, predicted. Null and
    empty texts score as texts without any landmark. A null doc_id is not held out."""
    scored = docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(_scorer(model), "id long, score double")
    return scored.select(F.col("id").alias("doc_id"), F.coalesce(~train_fold(F.col("id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _clean(model: Model, threshold: float, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _scorer(model)
        for batch in batches:
            slim = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(text)], names=["id", "text"])
            keep = np.concatenate([b.column(1).to_numpy() for b in judge(iter([slim]))] or [np.empty(0)]) < threshold
            yield batch.filter(pa.array(keep))

    return run


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is under the threshold. An empty table gives an empty result."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names with dots don't pass mapInArrow
    return plain.mapInArrow(_clean(model, threshold, docs.columns.index("text")), plain.schema).toDF(*docs.columns)
