"""The alignment of two tokenizers against a slow one."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meritgraph.llm import align

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


class Slow:
    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [x for x in range(256) if x not in printable]
        self.chars = {chr(x): x for x in printable} | {chr(256 + k): x for k, x in enumerate(rest)}

    def tokens(self, text):
        """(id, bytes) of both, or none."""
        if not text:
            return [], []
        a = [(i, bytes(self.chars[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])

    def groups(self, text):
        a, b = self.tokens(text)
        ends = lambda t: [sum(len(x) for _, x in t[: k + 1]) for k in range(len(t))]
        ea, eb, out, at = ends(a), ends(b), [], 0
        for cut in sorted(set(ea) & set(eb)):
            out.append(([i for (i, _), e in zip(a, ea, strict=True) if at < e <= cut], [i for (i, _), e in zip(b, eb, strict=True) if at < e <= cut]))
            at = cut
        return len(a), len(b), out

    def table(self, texts):
        found = [self.groups(t) for t in texts]
        counts = Counter((g[0][-1], g[1][-1]) for *_, groups in found for g in groups)
        most = defaultdict(int)
        for (_, b), n in counts.items():
            most[b] = max(most[b], n)
        out = []
        for n_a, n_b, groups in found:
            links = [(g[0][-1], g[1][-1]) for g in groups]
            told = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
            out.append((n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(told.encode()).hexdigest() if told else ""))
        return out


@pytest.fixture(scope="module")
def slow():
    return Slow()


def texts():
    rng = random.Random(2)
    pool = ["the", "Token", "izers", "naïve", "漢字", "😀", "x1", "12345", "don't", "<s>", "<|endoftext|>", "<0x41>", "▁", "ﬁ", "\n", "\t", "  ", "-", "٣", "é", "\x00", "zzzzqqq"]
    return [None, "", " ", "▁", " a", "a ", "a  b", "<0x41>", "</s>", "ﬁ", "a"] + [" ".join(rng.choice(pool) for _ in range(rng.choice([1, 3, 12, 60]))) for _ in range(150)] + ["".join(rng.choice(pool[:9]) for _ in range(30)) for _ in range(30)]


def test_against_a_slow_one(spark, slow, monkeypatch):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit("x"), "pairs": F.lit(1), "n_a": F.lit(2)}).repartition(3)
    want = dict(enumerate(slow.table([t for _, t in rows])))
    assert sum(x[0] > 0 for x in want.values()) > 100 and sum(x[0] == 0 for x in want.values()) > 10
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in align.alignment(docs, A, B).collect()}
    assert got == want
    monkeypatch.setattr(align, "BROADCAST_PAIRS", 0)  # the join by shuffle
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in align.alignment(docs, A, B).collect()} == want


def test_long_texts_in_parts(slow, monkeypatch):
    from meritgraph.llm import bpe

    text = "Some words, and 12 more of them; naïve ones.\nThe Tokenizers don't agree 漢字 on everything " * 6
    own = align.Tokenizers(A, B)
    (whole,) = own.aligned([text])
    monkeypatch.setattr(bpe, "PIECE", 40)
    (parts,) = own.aligned([text])
    assert len(whole) == 1 and len(parts) > 5
    for x, y in zip(align._joined(parts), whole[0], strict=True):
        assert x.tolist() == y.tolist()
    assert "".join(map(own.group_text, parts)) == own.group_text(whole[0])
    assert (len(whole[0].a), len(whole[0].b)) == slow.groups(text)[:2]


def test_very_long_texts(spark):
    rows = [(1, "many plain words of a text " * 40_000), (2, "漢字かな交じり文。" * 20_000), (3, "ab" * 60_000)]
    for r in align.alignment(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect():
        assert r.n_groups == r.n_links > 0 and r.n_a >= r.n_groups <= r.n_b


def test_ids_are_those_of_the_tokenizer_file(slow):
    """Characters of all kinds, old and new, spaces of all kinds, and texts that are too long for the fast way."""
    rng, own = random.Random(8), align.Tokenizers(A, B)
    pool = [*"ab zé漢😀\u0085\u00a0\u2003\u200b\u3000\n\t'0189-_.", "\u058b", "\u1c89", "\U00010d4e", "\U0001faea", "\u0378", "'s", "'S", "<|endoftext|>", "   ", "the ", "\ud55c", "\u0e33", "\u00b2", "\u2167", "\u0301"]
    for n in (1, 2, 5, 40, 300):
        for _ in range(60):
            text = " " + "".join(rng.choice(pool) for _ in range(n))
            assert list(own.a_ids(text)) == slow.a.encode(text, add_special_tokens=False).ids
    text = "x" * 200_000
    assert list(own.a_ids(text)) == slow.a.encode(text, add_special_tokens=False).ids


def test_ranks_and_selections():
    rng = random.Random(4)
    for n in (0, 1, 63, 64, 65, 500):
        places = sorted({rng.randrange(n + 1) for _ in range(n // 3 + 1)})
        words = align.bitset(align.np.array(places), n)
        assert align.select(words).tolist() == places and align.rank(words, align.np.array(places)).tolist() == list(range(1, len(places) + 1))


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "some words"), (1, "some words"), (1, "some words"), (1, None)], "doc_id long, text string")
    got = sorted(tuple(str(r[c]) for c in ("doc_id", "n_links", "n_best", "count_sum")) for r in align.alignment(docs, A, B).collect())
    n = len(Slow().groups("some words")[2])
    assert got == sorted([("None", str(n), str(n), str(3 * n)), ("1", str(n), str(n), str(3 * n)), ("1", str(n), str(n), str(3 * n)), ("1", "0", "0", "0")])
    assert align.alignment(docs.limit(0), A, B).count() == 0
    with pytest.raises(ValueError):
        align.align(docs.withColumn("Cuts", F.lit(1)), A, B)
    kept = align.align(docs.withColumn("a.b", F.lit(7)), A, B)
    assert kept.columns == ["doc_id", "text", "a.b", "a_ids", "b_ids", "a_to", "b_to", "cuts"]
    for r in kept.collect():
        assert r.a_to == sorted(r.a_to) and (not r.text or (r.cuts[-1] == len(r.text) + 1 and r.a_to[-1] == len(r.a_ids) and r.b_to[-1] == len(r.b_ids)))
