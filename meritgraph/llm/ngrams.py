"""Language-model scoring: an interpolated modified Kneser-Ney bigram model.

Words and bigrams are counted by Spark: tasks count what they read, shuffle sorted runs of (key, count) by key range,
and each range is merged on its own and written as arrays sorted by key: hashes of words for the vocabulary, pairs of
word numbers for the bigrams. The files lie in a new folder under the shared checkpoint folder, which has to be a
mounted path, and workers map them into memory, MAPS of them at a time, so that a model of any size costs no heap, its
pages are shared, and no worker runs out of open files.
Contexts that are too frequent for one range are dealt by their second word, and there are as many ranges as the texts
need at RANGE_CHARS characters each. Counts have 64 bits; two word numbers share a key of 64, so a vocabulary of 2^32
words is an error.

    p(w | v) = (c(v w) - D(c)) / c(v) + g(v) p1(w)
    p1(w)    = (N(. w) - D1(N)) / N(. .) + g1 / (V + 1)

with modified discounts (one, two, three and more) of their own at either level; contexts that were never seen leave
p1, and words that were never seen share g1 / (V + 1). A text begins after a start context and ends with one end
token. Words are told apart by 64-bit hashes of their bytes; A-Z count as a-z.

Null and empty texts are one end token. Very long texts are scored whole. Repeated rows count and are scored each time. With nothing to learn from,
every token has the probability 1 / (V + 1) with V = 0. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import os
import uuid
from collections import Counter, OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meritgraph.llm.common import checkpointed, shuffle_partitions, table
from meritgraph.llm.language import remainder

#: Tokens that no word can be, for a word has no white space.
END, START = b" ", b"  "
FLUSH_WORDS = 1 << 20
FLUSH_TOKENS = 1 << 22
CACHE = 1 << 19
BLOCK_TOKENS = 1 << 18
COUNTS = "p int, keys binary, counts binary"
RANGE_CHARS = 1 << 26
#: Files that a worker keeps mapped at a time.
MAPS = 64


def _shared_folder(spark: SparkSession) -> str:
    checkpointed(spark.range(1))  # names a folder where none is named yet
    where = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    parts = urlparse(where)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"the checkpoint folder has to be a mounted path for memory mapping: {where}")
    path = os.path.join(unquote(parts.path), f"ngrams-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


def _put(path: str, array: np.ndarray) -> None:
    """Whole or not at all, however often a task is tried."""
    own = f"{path}.{uuid.uuid4().hex}"
    array.tofile(own)
    os.replace(own, path)


def _map(path: str, kind: str) -> np.ndarray:
    return np.memmap(path, dtype=kind, mode="r") if os.path.exists(path) and os.path.getsize(path) else np.empty(0, dtype=kind)


def _run(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """A sorted run, by differences and byte planes, which the shuffle's compression halves."""
    planes = lambda x: np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()
    return planes(np.diff(keys, prepend=np.uint64(0))), planes(counts.astype("<u8"))


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for k, c in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist(), strict=True):
        n = len(k) // 8
        keys.append(np.cumsum(np.ascontiguousarray(np.frombuffer(k, np.uint8).reshape(8, n).T).view("<u8").ravel(), dtype=np.uint64))
        counts.append(np.ascontiguousarray(np.frombuffer(c, np.uint8).reshape(8, n).T).view("<u8").ravel().astype(np.int64))
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] + np.uint64(1) if len(keys) else None)) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _dealt(p: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Sorted keys with their ranges as one run a range."""
    order = np.argsort(p, kind="stable")
    p, keys, counts = p[order], keys[order], counts[order]
    parts, at = np.unique(p, return_index=True)
    runs = [_run(keys[a:b], counts[a:b]) for a, b in zip(at, np.append(at, len(p))[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), pa.array([r[0] for r in runs], pa.binary()), pa.array([r[1] for r in runs], pa.binary())], names=["p", "keys", "counts"])


def tokens(text: bytes | None) -> list[bytes]:
    found = (text or b"").lower().split()
    found.append(END)
    return found


class Maps:
    """A model's files, mapped when they are asked for; those that were not for the longest time are closed."""

    def __init__(self, folder: str) -> None:
        self.folder = folder
        self.held: OrderedDict[str, np.ndarray] = OrderedDict()

    def get(self, name: str, kind: str) -> np.ndarray:
        if name in self.held:
            self.held.move_to_end(name)
        else:
            if len(self.held) >= MAPS:
                self.held.popitem(last=False)
            self.held[name] = _map(f"{self.folder}/{name}", kind)
        return self.held[name]


@dataclass(frozen=True)
class Files:
    """The files of one array, by range."""

    maps: Maps
    name: str
    kind: str

    def __getitem__(self, p: int) -> np.ndarray:
        return self.maps.get(f"{self.name}-{p}", self.kind)


@dataclass(frozen=True)
class Model:
    folder: str
    bits: int  # the vocabulary has 2^bits files, by the hash's first bits
    starts: tuple[int, ...]  # the first word number of each
    ranges: int  # of bigrams
    hot: tuple[int, ...]  # contexts that are dealt by the second word
    size: int  # V
    total: int  # N
    texts: int
    discounts: tuple[float, ...] = ()
    lower: tuple[float, ...] = ()  # discounts, sum and g1 of the lower level

    @property
    def start(self) -> int:
        return self.size

    def range_of(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        p = first * self.ranges // (self.size + 1)
        if self.hot:
            hot = np.isin(first, np.array(self.hot))
            p[hot] = (second[hot] * 0x9E3779B1 & 0xFFFFFFFF) % self.ranges
        return p


class Reader:
    """A model's files, mapped into this worker as they are needed, and the words met so far (at most CACHE)."""

    def __init__(self, m: Model) -> None:
        self.m, maps = m, Maps(m.folder)
        at = lambda name, kind: Files(maps, name, kind)
        self.words, self.counts = at("word", "<u8"), at("wordcount", "<u8")
        self.pairs, self.paircounts = at("pair", "<u8"), at("paircount", "<u8")
        self.follow, self.gamma = at("follow", "<u8"), at("gamma", "<f4")
        self.cache: dict[bytes, int] = {START: m.start}

    def numbers(self, found: list[bytes]) -> np.ndarray:
        """Word numbers; -1 for words that were never seen."""
        if new := list(set(found).difference(self.cache)):
            if len(self.cache) > CACHE:
                self.cache = {START: self.m.start}
                new = list(set(found).difference(self.cache))
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, new), dtype=np.uint64, count=len(new))
            self.cache |= zip(new, self._words(hashes).tolist(), strict=True)
        return np.fromiter(map(self.cache.__getitem__, found), dtype=np.int64, count=len(found))

    def _words(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, dtype=np.int64)
        for p, own in _by(_file(hashes, self.m.bits)):
            words = self.words[p]
            at = np.searchsorted(words, hashes[own])
            hit = at < len(words)
            hit[hit] = words[at[hit]] == hashes[own][hit]
            out[own[hit]] = at[hit] + self.m.starts[p]
        return out

    def _dense(self, arrays: Files, p: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), dtype=np.float64)
        for k, own in _by(p):
            out[own] = arrays[k][at[own]]
        return out

    def word_counts(self, n: np.ndarray) -> np.ndarray:
        """Of word numbers: counts in training; 0 for -1."""
        p = np.searchsorted(np.array(self.m.starts), n, side="right") - 1
        out, known = np.zeros(len(n)), n >= 0
        out[known] = self._dense(self.counts, p[known], n[known] - np.array(self.m.starts)[p[known]])
        return out

    def by_range(self, arrays: Files, n: np.ndarray) -> np.ndarray:
        p = n * self.m.ranges // (self.m.size + 1)
        return self._dense(arrays, p, n - _low(p, self.m))

    def pair_counts(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        keys = (first.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        out = np.zeros(len(keys))
        for p, own in _by(self.m.range_of(first, second)):
            pairs = self.pairs[p]
            at = np.searchsorted(pairs, keys[own])
            hit = at < len(pairs)
            hit[hit] = pairs[at[hit]] == keys[own][hit]
            out[own[hit]] = self.paircounts[p][at[hit]]
        return out

    def log10(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Logarithms of p(second | first), for word numbers."""
        m, unique = self.m, (first + 1) << 32 | (second + 1)
        unique, back = np.unique(unique, return_inverse=True)
        first, second = (unique >> 32) - 1, (unique & 0xFFFFFFFF) - 1
        p = np.full(len(unique), m.lower[4] / (m.size + 1))
        seen = second >= 0
        if m.size:
            n = self.by_range(self.follow, second[seen])
            p[seen] += np.maximum(n - np.array((0.0, *m.lower[:3]))[np.minimum(n, 3).astype(int)], 0) / m.lower[3]
            known = first >= 0
            c = np.zeros(len(unique))
            both = known & seen
            c[both] = self.pair_counts(first[both], second[both])
            total = np.where(first[known] == m.start, m.texts, self.word_counts(np.where(first[known] == m.start, -1, first[known])))
            p[known] *= self.by_range(self.gamma, first[known])
            p[known] += np.maximum(c[known] - np.array((0.0, *m.discounts))[np.minimum(c[known], 3).astype(int)], 0) / total
        return np.log10(p)[back]


def _low(p: np.ndarray, m: Model) -> np.ndarray:
    """The first word number of a range."""
    return -(-p * (m.size + 1) // m.ranges)


def _file(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), dtype=np.int64)


def _by(p: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each value."""
    order = np.argsort(p, kind="stable")
    values, at = np.unique(p[order], return_index=True)
    for k, a, b in zip(values.tolist(), at, np.append(at, len(p))[1:], strict=True):
        yield k, order[a:b]


@lru_cache(maxsize=1)
def _reader(m: Model) -> Reader:
    return Reader(m)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from how many keys have the counts one to four; a half, one and one and a half
    where a class is empty."""
    if min(n[:4]) <= 0:
        return 0.5, 1.0, 1.5
    d = n[0] / (n[0] + 2 * n[1])
    found = (1 - 2 * d * n[1] / n[0], 2 - 3 * d * n[2] / n[1], 3 - 4 * d * n[3] / n[2])
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in enumerate(found, 1))


def _classes(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def train(texts: DataFrame) -> Model:
    """A model of the column text of all rows."""
    spark = texts.sparkSession
    texts = texts.select("text")
    chars = texts.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    folder, ranges = _shared_folder(spark), max(1, shuffle_partitions(spark), -(-chars // RANGE_CHARS))
    bits = max(0, (ranges - 1).bit_length())

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))
            order = np.argsort(hashes)
            return _dealt(_file(hashes[order], bits), hashes[order], np.fromiter(found.values(), dtype=np.int64, count=len(found))[order])

        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                found.update(tokens(text))
                if len(found) > FLUSH_WORDS:
                    yield flush()
                    found.clear()
        if found:
            yield flush()

    def put_words(key: tuple, runs: pa.Table) -> pa.Table:
        keys, counts = _merged(runs)
        p = key[0].as_py()
        _put(f"{folder}/word-{p}", keys)
        _put(f"{folder}/wordcount-{p}", counts.astype("<u8"))
        top = np.argsort(-counts, kind="stable")[:ranges]
        return pa.table({"p": pa.array([p], pa.int32()), "n": [len(keys)], "total": [int(counts.sum())], "at": [top.tolist()], "often": [counts[top].tolist()]})

    made = texts.mapInArrow(words, COUNTS).groupBy("p").applyInArrow(put_words, "p int, n long, total long, at array<bigint>, often array<bigint>")
    made = checkpointed(made.withColumn("at", F.slice("at", 1, 64)).withColumn("often", F.slice("often", 1, 64)))
    held = {r.p: r for r in made.select("p", "n", "total").collect()}  # three numbers a range
    sizes = [held[p].n if p in held else 0 for p in range(1 << bits)]
    starts = tuple(int(x) for x in np.concatenate([[0], np.cumsum(sizes)])[:-1])
    total = sum(r.total for r in held.values())
    often = made.select("p", F.inline(F.arrays_zip("at", "often"))).where(4 * F.col("often") * ranges > total)  # four a range at most
    hot = tuple(sorted(starts[r.p] + r.at for r in often.collect()))
    if sum(sizes) >= 2**32 - 1:
        raise ValueError(f"{sum(sizes)} words are more than a key of word numbers can tell apart")
    n_texts = texts.count()
    m = Model(folder, bits, starts, ranges, hot, sum(sizes), total, n_texts)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            return _dealt(m.range_of((keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)), keys, counts)

        reader, held, size = _reader(m), [], 0
        for batch in batches:
            for found in _runs(batch.column(0)):
                n = reader.numbers(found).astype(np.uint64)
                keys = (n[:-1] << np.uint64(32)) | n[1:]
                held.append(keys[n[1:] != m.start])
                size += len(n)
                if size > FLUSH_TOKENS:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def put_pairs(key: tuple, runs: pa.Table) -> pa.Table:
        keys, counts = _merged(runs)
        p = key[0].as_py()
        _put(f"{folder}/pair-{p}", keys)
        _put(f"{folder}/paircount-{p}", counts.astype("<u8"))
        first, second = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # for each second word, in how many pairs it is; for each context, how many pairs have the counts 1, 2 and more
        seconds, n = np.unique(second, return_counts=True)
        contexts, at = np.unique(first, return_index=True)
        out = [_dealt(seconds * ranges // (m.size + 1), seconds.astype(np.uint64), n)]
        for k, mask in enumerate((counts == 1, counts == 2, counts > 2)):
            own = np.add.reduceat(mask.astype(np.int64), at)
            has = own > 0
            out.append(_dealt(contexts[has] * ranges // (m.size + 1), contexts[has].astype(np.uint64), own[has]))
            out[-1] = out[-1].append_column("kind", pa.array([k + 1] * out[-1].num_rows, pa.int32()))
        out[0] = out[0].append_column("kind", pa.array([0] * out[0].num_rows, pa.int32()))
        rows = pa.Table.from_batches(out)
        classes = pa.table({"p": pa.array([-1], pa.int32()), "keys": pa.array([b""], pa.binary()), "counts": pa.array([np.array(_classes(counts), "<i8").tobytes()], pa.binary()), "kind": pa.array([-1], pa.int32())})
        return pa.concat_tables([rows, classes])

    found = checkpointed(texts.mapInArrow(pairs, COUNTS).groupBy("p").applyInArrow(put_pairs, f"{COUNTS}, kind int"))
    add = lambda rows: np.sum([np.frombuffer(r.counts, "<i8") for r in rows] or [np.zeros(4, "<i8")], axis=0).tolist()
    own = discounts(add(found.where("kind = -1").select("counts").collect()))  # four numbers a range

    def put_levels(key: tuple, runs: pa.Table) -> pa.Table:
        p = key[0].as_py()
        low, high = (int(_low(np.array([x]), m)[0]) for x in (p, p + 1))
        dense = np.zeros((4, high - low), dtype=np.int64)
        for k in range(4):
            keys, counts = _merged(runs.filter(pa.compute.equal(runs.column("kind"), k)))
            dense[k, keys.astype(np.int64) - low] = counts
        numbers = np.arange(low, high)
        total = np.where(numbers == m.start, m.texts, _reader(m).word_counts(np.where(numbers == m.start, -1, numbers)))
        gamma = (own[0] * dense[1] + own[1] * dense[2] + own[2] * dense[3]) / np.maximum(total, 1)
        _put(f"{folder}/follow-{p}", dense[0].astype("<u8"))
        _put(f"{folder}/gamma-{p}", np.where(dense[1:].sum(axis=0) > 0, gamma, 1.0).astype("<f4"))
        seen = dense[0][dense[0] > 0]
        return pa.table({"classes": [[*_classes(seen), int((seen > 2).sum()), int(seen.sum())]]})

    levels = found.where("kind >= 0").groupBy("p").applyInArrow(put_levels, "classes array<bigint>")
    n = np.sum([r.classes for r in checkpointed(levels).collect()] or [[0] * 6], axis=0).tolist()
    lower = discounts(n[:4])
    g = (lower[0] * n[0] + lower[1] * n[1] + lower[2] * n[4]) / n[5] if n[5] else 1.0
    return Model(folder, bits, starts, ranges, hot, m.size, total, n_texts, own, (*lower, float(max(n[5], 1)), g))


def _runs(column: pa.Array) -> Iterator[list[bytes]]:
    """Tokens of several texts in one list, each text behind a START; very long texts are lists of their own."""
    out: list[bytes] = []
    for text in column.cast(pa.binary()).to_pylist():
        out.append(START)
        out.extend(tokens(text))
        if len(out) > BLOCK_TOKENS:
            yield out
            out = []
    if out:
        yield out


def score(docs: DataFrame, m: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score (sums of log10 probabilities) for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(m)
        for batch in batches:
            sizes, known, base, own = [], [], [], []
            for found in _runs(batch.column(1)):
                n = reader.numbers(found)
                begins = np.flatnonzero(n == m.start)
                first, second = n[:-1], n[1:]
                keep = second != m.start
                at = begins - np.arange(len(begins))  # each text's first pair among those kept
                first, second = first[keep], second[keep]
                c = reader.word_counts(second)
                sizes.append(np.diff(at, append=len(second)))
                known.append(np.add.reduceat((c > 0).astype(np.int64), at))
                base.append(np.add.reduceat(np.log10((c + 0.5) / (m.total + 0.5 * (m.size + 1))), at))
                own.append(np.add.reduceat(reader.log10(first, second), at))
            columns = [batch.column(0), *(pa.array(np.concatenate(x)) for x in (sizes, known, base, own))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 5) == 1
    m = train(docs.where(~held_out))
    return score(docs, m).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(m.total).cast("long").alias("train_tokens"), "base_score", "score")
