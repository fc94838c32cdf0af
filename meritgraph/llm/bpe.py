"""Byte-level BPE encoding and decoding over Arrow batches, with the tokenizers library.

The vocabulary is a rank file: base64 of a token's bytes and its rank, which is its id. Bytes become characters by
the byte table of byte-level BPE (printable bytes stand for themselves, the others for code points from 256 on), and
every split of a token into two tokens becomes a merge of the token's rank, which is how ranks alone merge. Each match
of the pattern is merged on its own, once for all its occurrences that a worker meets within its cache. Decoding reverses the byte table: an id's
characters become bytes again, and the bytes of a character that tokens split meet when they are joined. Ids of a part
of a text decode to bytes that may begin or end within a character; ``decode_parts`` gives such a character to the part
that completes it.

Null texts count as empty: no ids. An empty table gives no rows. Very long texts are encoded in pieces, cut only before a space between two ASCII
letters, where a match of the pattern ends in any case, so the ids are those of the whole text. Repeated rows are
encoded alike. ``encode`` keeps all other columns of its input and refuses a frame that has one of its own names.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField

from meritgraph.llm.common import appended, quoted, table

PIECE = 1 << 16
CACHE = 200_000
CUT = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")


def byte_table() -> list[str]:
    """The character for each byte."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    chars = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}
    return [chars[b] for b in range(256)]


class Codec:
    """A rank file's vocabulary in the tokenizers library, with the ids of the matches met so far (at most CACHE)."""

    def __init__(self, path: str, pattern: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        chars = byte_table()
        written = {token: "".join([chars[b] for b in token]) for token in ranks}
        merges = [(written[t[:i]], written[t[i:]]) for t, _ in sorted(ranks.items(), key=lambda x: x[1]) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.tokenizer = Tokenizer(models.BPE(vocab={written[t]: r for t, r in ranks.items()}, merges=merges, cache_capacity=0))
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.findall = regex.compile(pattern).findall
        self.split = pre_tokenizers.Split(Regex(pattern), "isolated")
        self.assigned: set[str] = set()
        bytes_of = {c: b for b, c in enumerate(chars)}
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.tokens[rank] = bytes(map(bytes_of.__getitem__, token))
        self.cache: dict[str, list[int]] = {}

    def matches(self, text: str) -> list[str]:
        """The pattern's matches. The regex module is the faster, but knows younger characters than the tokenizers
        library, which a text of characters that Python doesn't know is left to."""
        if new := set(text) - self.assigned:
            new = {c for c in new if unicodedata.category(c) != "Cn"}
            self.assigned |= new
            if set(text) - self.assigned:
                return [part for part, _ in self.split.pre_tokenize_str(text)]
        return self.findall(text)

    def encode(self, text: str) -> tuple[list[str], np.ndarray]:
        """The pattern's matches and the text's ids."""
        found = self.matches(text)
        if new := list(set(found).difference(self.cache)):
            if len(self.cache) > CACHE:
                self.cache.clear()
                new = list(set(found))
            self.cache |= zip(new, (e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)), strict=True)
        return found, np.fromiter(chain.from_iterable(map(self.cache.__getitem__, found)), dtype="<u4")

    def offsets(self, found: list[str], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """In code points, the place of the character in which each id's bytes begin, and the place after the one in
        which they end."""
        data = np.frombuffer("".join(found).encode(), dtype=np.uint8)
        of_byte = np.cumsum((data & 0xC0) != 0x80) - 1
        ends = np.cumsum(np.fromiter((len(self.tokens[i]) for i in ids.tolist()), dtype=np.int64, count=len(ids)))
        return of_byte[np.append(0, ends[:-1])[: len(ids)]].astype("<u4"), (of_byte[ends - 1] + 1).astype("<u4")


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> Codec:
    """Once a worker."""
    return Codec(path, pattern)


def pieces(text: str) -> Iterator[str]:
    """A long text in parts of about PIECE characters."""
    at = 0
    while len(text) - at > PIECE and (cut := CUT.search(text, at + PIECE)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode_text(text: str | None, path: str, pattern: str, offsets: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of a text and, if asked for, where each id's token begins and ends, in code points (a character that
    tokens split belongs to each of them)."""
    codec, at = load(path, pattern), 0
    ids, starts, ends = ([np.empty(0, dtype="<u4")] for _ in range(3))
    for part in pieces(text or ""):
        found, own = codec.encode(part)
        ids.append(own)
        if offsets:
            first, last = codec.offsets(found, own)
            starts.append(first + np.uint32(at))
            ends.append(last + np.uint32(at))
            at += len(part)
    return np.concatenate(ids), np.concatenate(starts), np.concatenate(ends)


def decode_ids(ids, path: str, pattern: str) -> bytes:
    """The bytes of a row of ids; decode them as UTF-8, with ``errors="replace"`` where the ids may cut a character."""
    return b"".join(map(load(path, pattern).tokens.__getitem__, ids))


def decode_parts(parts, path: str, pattern: str) -> list[str]:
    """The texts of consecutive rows of ids of one text; a character that two parts share goes to the later one."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    out = [decoder.decode(decode_ids(ids, path, pattern)) for ids in parts]
    if out:
        out[-1] += decoder.decode(b"", final=True)
    return out


def encode(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with ids, starts and ends (arrays of int)."""
    if clash := {"ids", "starts", "ends"} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns exist already: {sorted(clash)}")

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        found = [encode_text(x, path, pattern) for x in batch.column(batch.num_columns - 1).to_pylist()]
        return [pa.array([x[j] for x in found], pa.list_(pa.int32())) for j in range(3)]

    read = df.select(*quoted(df.columns), F.col(text).alias("_"))
    return appended(read, len(df.columns), [StructField(x, ArrayType(IntegerType())) for x in ("ids", "starts", "ends")], make)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``df`` with decoded (binary); null ids count as none."""
    if "decoded" in {c.lower() for c in df.columns}:
        raise ValueError("column exists already: decoded")

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = batch.column(batch.num_columns - 1).to_pylist()
        return [pa.array([decode_ids(x or [], path, pattern) for x in rows], pa.binary())]

    read = df.select(*quoted(df.columns), F.col(ids).alias("_"))
    return appended(read, len(df.columns), [StructField("decoded", BinaryType())], make)


def digests(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes and decodes within one batch, and returns only digests, so that ids never leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [encode_text(x, path, pattern, offsets=False)[0] for x in batch.column(1).to_pylist()]
            decoded = [hashlib.sha256(decode_ids(x.tolist(), path, pattern)).hexdigest() for x in ids]
            columns = [batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]), pa.array(decoded)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
