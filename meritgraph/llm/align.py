"""Two tokenizers' tokens over the same bytes: a byte-level BPE (A) and a sentencepiece model (B).

A text is encoded by both with one space before it, which B adds by itself. Each tokenizer's token ends are bits of a
packed bitset over the bytes; the AND of both has the shared cuts. Selecting its bits gives the cuts' byte offsets, and
the rank of a cut in either bitset (running popcounts) the number of tokens that end there or before, so the cuts map to
token ranges: the group of a cut has A's and B's tokens since the cut before. The two tokens that end at a cut are linked.
Links are counted by id pair over all texts, and each text is told how its links stand among them.

Every token has bytes, so no two tokens of one tokenizer end together and a cut has one link. Null and empty texts have no
tokens, and neither have texts that B normalises (their joined bytes are not those of the text); their counts are zero
and their digest is empty. Very long texts are encoded and aligned in parts, cut only before a space between two ASCII
letters, where A's pattern ends a match and B has no token that goes on (checked when it is loaded), so the result is
that of the whole text. Repeated rows are aligned alike and all count. An empty table gives no
rows. ``align`` keeps all other columns of its input and refuses a frame that has one of its own names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField

from meritgraph.llm.bpe import PIECE, byte_table, pieces
from meritgraph.llm.common import appended, checkpointed, join_counted, quoted, table, written

#: Fixed value: the pattern of byte-level BPE, whose matches are merged each by itself.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Id pairs are broadcast with their counts up to this many rows (under 16 MB); beyond it they are joined by shuffle.
BROADCAST_PAIRS = 500_000
ACROSS = re.compile(rb"[^ ] ")


class Aligned(NamedTuple):
    """Ids, and for each group the number of tokens up to its end and the byte offset of its end."""

    a: np.ndarray
    b: np.ndarray
    a_to: np.ndarray
    b_to: np.ndarray
    cuts: np.ndarray


def bitset(ends: np.ndarray, n: int) -> np.ndarray:
    """The offsets ``ends`` (0 to n) as bits of 64-bit words."""
    marks = np.zeros((n // 64 + 1) * 64, dtype=bool)
    marks[ends] = True
    return np.packbits(marks, bitorder="little").view("<u8")


def select(words: np.ndarray) -> np.ndarray:
    """The places of the set bits."""
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def rank(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bits are set up to each place, itself included."""
    counts = np.bitwise_count(words).astype(np.int64)
    word, bit = at >> 6, (at & 63).astype(np.uint64)
    upto = words[word] & (np.uint64(2**64 - 1) >> (np.uint64(63) - bit))
    return (np.cumsum(counts) - counts)[word] + np.bitwise_count(upto)


def _old(c: str) -> bool:
    """Whether a character has been of its class since Unicode 3.2, which any library's tables know."""
    return unicodedata.ucd_3_2_0.category(c)[0] == unicodedata.category(c)[0] != "C" or c < "\x80"


class Tokenizers:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(a_path, encoding="utf-8") as f:
            own = json.load(f)
        before, vocabulary = own["pre_tokenizer"] or {}, own["model"]["vocab"]
        if own["normalizer"] or before.get("type") != "ByteLevel" or not before.get("use_regex") or before.get("add_prefix_space"):
            raise ValueError(f"not a plain byte-level BPE: {a_path}")
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        byte_of = {c: i for i, c in enumerate(byte_table())}
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(map(byte_of.__getitem__, token))
        special = {x["content"] for x in own["added_tokens"]}
        merges = [m.split(" ") if isinstance(m, str) else m for m in own["model"]["merges"]]
        made = [vocabulary[x + y] for x, y in merges]
        if made != list(range(256, 256 + len(made))):  # after the bytes
            raise ValueError(f"ids are not the ranks of the merges: {a_path}")
        ranks = {self.a_bytes[i]: i for token, i in vocabulary.items() if token not in special}
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.old: set[str] = set()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        self.b_bytes = [b"" if self.b.is_control(i) else piece(i) for i in range(self.b.get_piece_size())]
        if any(ACROSS.search(x) for x in self.b_bytes):
            raise ValueError(f"tokens go on into the next word: {b_path}")
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t]) for t in (self.a_bytes, self.b_bytes))
        # an id in a group's text with what follows it: inside the group, and at the end of its side
        self.a_text, self.b_text = (np.array([f"{i}{x}" for x in (",", end) for i in range(n)], dtype=object) for n, end in ((len(self.a_sizes), "|"), (len(self.b_sizes), ";")))

    def a_ids(self, text: str) -> list[int]:
        """By the faster library, which merges by the same ranks, unless a character is so new that the two may take it
        for different classes, or the text is so long that it has hardly a place to cut."""
        if new := set(text) - self.old:
            self.old |= set(filter(_old, new))
            if not new <= self.old:
                return self.a.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text) if len(text) <= 2 * PIECE else self.a.encode(text, add_special_tokens=False).ids

    def aligned(self, texts: list[str | None]) -> Iterator[list[Aligned]]:
        """The parts of each text; none for texts without tokens."""
        for text in texts:
            parts = []
            for part in pieces(" " + text) if text else ():
                data, a, b = part.encode(), self.a_ids(part), self.b.encode(part[1:])
                if not b"".join(map(self.a_bytes.__getitem__, a)) == data == b"".join(map(self.b_bytes.__getitem__, b)):
                    parts = []
                    break
                parts.append(self._part(np.array(a), np.array(b), len(data)))
            yield parts

    def _part(self, a: np.ndarray, b: np.ndarray, n: int) -> Aligned:
        own, other = bitset(np.cumsum(self.a_sizes[a]), n), bitset(np.cumsum(self.b_sizes[b]), n)
        cuts = select(own & other)
        return Aligned(a, b, rank(own, cuts), rank(other, cuts), cuts)

    def group_text(self, x: Aligned) -> str:
        """`a1,a2|b1;a3|b2,b3;`: the ids of each group, in order."""
        a_sizes, b_sizes = np.diff(x.a_to, prepend=0), np.diff(x.b_to, prepend=0)
        a_last, b_last = np.zeros(len(x.a), dtype=np.int64), np.zeros(len(x.b), dtype=np.int64)
        a_last[x.a_to - 1] = len(self.a_sizes)
        b_last[x.b_to - 1] = len(self.b_sizes)
        out = np.empty(len(x.a) + len(x.b), dtype=object)
        out[np.arange(len(x.a)) + np.repeat(x.b_to - b_sizes, a_sizes)] = self.a_text[x.a + a_last]
        out[np.arange(len(x.b)) + np.repeat(x.a_to, b_sizes)] = self.b_text[x.b + b_last]
        return "".join(out.tolist())


@lru_cache(maxsize=2)
def load(a_path: str, b_path: str) -> Tokenizers:
    """Once a worker."""
    return Tokenizers(a_path, b_path)


def _joined(parts: list[Aligned]) -> Aligned:
    """The parts of a text as one."""
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return Aligned(*(np.empty(0, dtype=np.int64) for _ in range(5)))
    before = lambda sizes: np.cumsum([0, *sizes])[:-1]
    moved = lambda of, sizes: np.concatenate([of(x) + k for x, k in zip(parts, before(sizes), strict=True)])
    a, b, n = ([f(x) for x in parts] for f in (lambda x: len(x.a), lambda x: len(x.b), lambda x: x.cuts[-1]))
    return Aligned(np.concatenate([x.a for x in parts]), np.concatenate([x.b for x in parts]), moved(lambda x: x.a_to, a), moved(lambda x: x.b_to, b), moved(lambda x: x.cuts, n))


def align(df: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """``df`` with arrays of int: a_ids, b_ids, and for each group a_to, b_to (the number of tokens up to its end) and
    cuts (its end in bytes of the text after a space)."""
    names = ["a_ids", "b_ids", "a_to", "b_to", "cuts"]
    if clash := set(names) & {c.lower() for c in df.columns}:
        raise ValueError(f"columns exist already: {sorted(clash)}")

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        found = [_joined(parts) for parts in load(a_path, b_path).aligned(batch.column(batch.num_columns - 1).to_pylist())]
        return [pa.array([x[j] for x in found], pa.list_(pa.int32())) for j in range(len(names))]

    read = df.select(*quoted(df.columns), F.col(text).alias("_"))
    return appended(read, len(df.columns), [StructField(x, ArrayType(IntegerType())) for x in names], make)


def summaries(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the text's links as distinct id pairs (b * 2^32 + a) with
    the number of times each occurs. Ids themselves never leave the worker."""
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<bigint>, times array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(a_path, b_path)
        for batch in batches:
            counts, digests, pairs, times = [], [], [], []
            for parts in own.aligned(batch.column(1).to_pylist()):
                digest, links = hashlib.sha256(), [np.empty(0, dtype=np.int64)]
                for k, x in enumerate(parts):
                    digest.update((";" * (k > 0) + own.group_text(x)[:-1]).encode())
                    links.append(x.b[x.b_to - 1].astype(np.int64) << 32 | x.a[x.a_to - 1])
                found, n = np.unique(np.concatenate(links), return_counts=True)
                groups = sum(len(x.cuts) for x in parts)
                counts.append((sum(len(x.a) for x in parts), sum(len(x.b) for x in parts), groups, int(n.sum())))
                digests.append(digest.hexdigest() if parts else "")
                pairs.append(found)
                times.append(n.astype(np.int32))
            columns = [pa.array([c[j] for c in counts], pa.int64()) for j in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(digests, pa.string()), pa.array(pairs, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32()))], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, count, best, n): over all summaries, how many links hold an id pair linked, whether no pair of its B id has
    more, and in how many texts it is."""
    each = found.select(F.inline(F.arrays_zip("pairs", "times"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("count"), F.count(F.lit(1)).alias("n"))
    # the pairs of one B id are as many as A has ids, at most
    return each.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy(F.shiftright("pair", 32))))


def standing(found: DataFrame, counts: DataFrame) -> DataFrame:
    """The summaries ``found`` (with ``row``, materialised) with n_best and count_sum."""
    each = found.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    if counts.count() <= BROADCAST_PAIRS:
        met = each.join(F.broadcast(counts.drop("n")), "pair")
    else:
        met = join_counted(each, counts, ["pair"], counts.agg(F.sum("n")).first()[0])
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return found.join(sums, "row", "left").withColumns({c: F.coalesce(c, zero) for c in ("n_best", "count_sum")})


def alignment(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; a row for each row of ``docs``."""
    found = written(summaries(docs, a_path, b_path).withColumn("row", F.monotonically_increasing_id()))
    return standing(found, checkpointed(pair_counts(found))).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
