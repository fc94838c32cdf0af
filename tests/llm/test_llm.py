import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers as P
from oracle import SF, same
from pyspark.sql import functions as F

import corpus_pipeline
from meritgraph.llm import boilerplate, bpe, fingerprints, language, lines, neardup, ngrams, packing, quality, registry, urls
from meritgraph.llm.components import components
from meritgraph.operators.frames import settings



@pytest.fixture(scope="module")
def docs(spark):
    """A table of documents from (doc_id, text) or (doc_id, text, lang, source)."""

    def make(rows):
        return spark.createDataFrame([(*r, "en", "s") if len(r) == 2 else r for r in rows], "doc_id long, text string, lang string, source string")

    return make


RANKS, PATTERN = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One"), (6, "a b c " * 40), (6, "a b c " * 40), (7, "é漢😀 " * 3), (None, "no id here")]


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, name):
    same(spark, registry.QUERIES[name], registry.SQL[name], SF)


# 1


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_ids_are_those_of_the_ranks(reference):
    rng = random.Random(1)
    pool = [*"ab zé漢😀\u0085 ​　\n\t'0189-_.", "֋", "'s", "<|endoftext|>", "aaaaaaa", "    ", "the "]
    texts = ["", "֋'d", "x" * 3000] + ["".join(rng.choice(pool) for _ in range(rng.choice([3, 30, 300]))) for _ in range(300)]
    for text in texts:
        ids, starts, ends = bpe.encode_text(text, RANKS, PATTERN)
        assert ids.tolist() == reference.encode_ordinary(text)
        assert bpe.decode_ids(ids.tolist(), RANKS, PATTERN) == text.encode()
        at, where = 0, []
        for i in ids.tolist():  # the characters that hold an id's first and last byte
            before, after = text.encode()[:at], text.encode()[: (at := at + len(bpe.decode_ids([i], RANKS, PATTERN)))]
            where.append((len(before.decode(errors="ignore")), len(after.decode(errors="replace"))))
        assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == where
        cut = [ids[k : k + 2].tolist() for k in range(0, len(ids), 2)]
        assert "".join(bpe.decode_parts(cut, RANKS, PATTERN)) == text


def test_bpe_long_texts_in_pieces(reference, monkeypatch):
    text = "Some words, and 12 more of them; naïve ones. " * 40
    want = bpe.encode_text(text, RANKS, PATTERN)
    monkeypatch.setattr(bpe, "PIECE", 50)
    got = bpe.encode_text(text, RANKS, PATTERN)
    assert got[0].tolist() == want[0].tolist() == reference.encode_ordinary(text) and all((a == b).all() for a, b in zip(got, want, strict=True))
    for uncut in ("漢字かな交じり文、" * 40, "x" * 500, "é " * 300, "1234 " * 100):  # hardly a place to cut
        assert bpe.encode_text(uncut, RANKS, PATTERN)[0].tolist() == reference.encode_ordinary(uncut)


def test_bpe_very_long_texts_without_a_cut(reference):
    for text in ("漢字かな交じり文。" * 20_000, "ab" * 60_000):
        ids, starts, ends = bpe.encode_text(text, RANKS, PATTERN)
        assert ids.tolist() == reference.encode_ordinary(text) and bpe.decode_ids(ids.tolist(), RANKS, PATTERN) == text.encode() and ends[-1] == len(text)
    assert bpe.decode_parts([], RANKS, PATTERN) == [] and "".join(bpe.decode_parts([bpe.encode_text("é", RANKS, PATTERN)[0].tolist()], RANKS, PATTERN)) == "é"


def test_bpe_in_spark(docs, reference):
    d = docs(ODD)
    for r in bpe.digests(d, RANKS, PATTERN).join(d.dropDuplicates(["doc_id"]), "doc_id").collect():
        ids = reference.encode_ordinary(r.text or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    both = bpe.decode(bpe.encode(d, RANKS, PATTERN), RANKS, PATTERN)
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in both.collect())
    with pytest.raises(ValueError):
        bpe.encode(d.withColumn("Ids", F.lit(1)), RANKS, PATTERN)
    extra = bpe.encode(d.withColumns({"a.b": F.lit(1), "text_hash": F.lit("x")}), RANKS, PATTERN)
    assert extra.columns == ["doc_id", "text", "lang", "source", "a.b", "text_hash", "ids", "starts", "ends"] and extra.count() == len(ODD)
    assert bpe.digests(docs([]), RANKS, PATTERN).count() == 0


# 2


def brute_components(rows, size):
    sets, parent = {}, {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        n = min(size, len(w))
        sets[i], parent[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set(), i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            k = len(sets[i] & sets[j])
            if i < j and k and 100 * k >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(docs, size):
    rng, rows = random.Random(size), [(i, t) for i, t in ODD if i and i < 6] + [(6, ODD[6][1])]
    for _ in range(3):  # families of near copies, larger than a short list
        base = [f"w{rng.randrange(900)}" for _ in range(110)]
        for _ in range(30):
            w = base[:]
            for _ in range(rng.choice([0, 0, 1, 2, 4, 6, 9])):
                w[rng.randrange(110)] = f"x{rng.randrange(40)}"
            rows.append((len(rows) + 10, " ".join(w)))
    rows += [(900, "same words HERE"), (901, "Same words here"), (902, "same words here")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs(rows).repartition(3), size).collect()}
    assert got == brute_components(rows, size)


def test_long_lists_in_small_blocks(docs, monkeypatch):
    """A family of near copies, of which some are linked only through others, cut into many blocks."""
    rng, rows = random.Random(9), []
    base = [f"w{k}" for k in range(80)]
    for i in range(60):
        w = base[:]
        for _ in range(rng.choice([1, 2, 3, 5])):
            w[rng.randrange(80)] = f"x{rng.randrange(30)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(neardup, "BLOCK", 7)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 300)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs(rows).repartition(3), 2).collect()}
    assert got == brute_components(rows, 2)


def test_near_duplicates_of_odd_rows(docs):
    got = neardup.near_duplicates(docs(ODD), 2).collect()
    assert len(got) == len(ODD)
    assert all(r.kept for r in got if r.doc_id in (None, 1, 2, 3, 4, 6, 7)) and [r.component_id for r in got if r.doc_id == 5] == [4]
    assert neardup.near_duplicates(docs([])).count() == 0


def test_ids_with_several_texts(docs):
    w = [f"w{k}" for k in range(40)]
    near = lambda k: " ".join([*w[:k], "other", *w[k + 1 :]])
    rows = [(5, " ".join(w)), (5, "a text of its own"), (3, near(7)), (9, near(20)), (5, " ".join(w)), (9, "a text of its own"), (-2, ""), (-2, "x y z")]
    d = docs(rows).withColumns({"digest": F.lit(1), "rep": F.lit("r"), "was": F.lit(0)})
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(d, 2).collect())
    assert got == sorted([(5, 39, 3, False), (5, 39, 3, False), (5, 4, 5, True), (3, 39, 3, True), (9, 39, 3, False), (9, 4, 5, False), (-2, 0, -2, True), (-2, 2, -2, True)])


def test_near_duplicates_of_very_long_texts(docs):
    rng = random.Random(2)
    w = [f"w{rng.randrange(50_000)}" for _ in range(120_000)]
    rows = [(1, " ".join(w)), (2, " ".join(w[:-1_000])), (3, " ".join(w[60_000:] + [f"x{k}" for k in range(60_000)]))]
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(rows), 2).collect()} == {1: 1, 2: 1, 3: 3}


def test_all_pairs_of_the_table_are_found(spark):
    """Recall against brute force over the whole table of 1,000 documents."""
    folder = SF.replace("0.001", "0.01")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    inverted, sets = {}, {i: set(neardup.shingles((t or "").encode(), 2).tolist()) for i, t in rows}
    met = Counter()
    for i, own in sets.items():
        for x in own:
            for j in inverted.setdefault(x, []):
                met[j, i] += 1
            inverted[x].append(i)
    want = spark.createDataFrame([(a, b) for (a, b), n in met.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)], "a long, b long")
    drawn = {r.node: r.component for r in components(want).collect()}
    got = {r.doc_id: r.component_id for r in registry.QUERIES["op2_minhash_neardup"](spark, folder).collect()}
    assert len(drawn) > 20 and got == {i: drawn.get(i, i) for i in got}


def test_components_of_a_long_path(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(200, 200), (None, 3), (301, 300)], "a long, b long")
    assert {r.node: r.component for r in components(edges).collect()} == {i: 0 for i in range(n + 1)} | {300: 300, 301: 300}


def test_components_of_a_few_links_do_not_fill_all_partitions(spark):
    with settings(spark, {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        drawn = components(spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a long, b long"))
        assert drawn.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        assert {r.node: r.component for r in drawn.collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5}


# 3


def generalised_jaccard(a, b):
    w = lambda t: Counter({x: n * len(x) for x, n in Counter(t.split()).items()})
    a, b = w(a), w(b)
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_fingerprints(docs):
    rng = random.Random(5)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6)) % 700}" for _ in range(400)) for _ in range(24)]
    texts[5] = texts[4]
    rows = list(enumerate(texts)) + [(24, ""), (25, None), (26, "x")]
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs(rows).repartition(3), 4).collect()}
    assert sorted(got) == list(range(27))
    errors = []
    for i, text in rows:
        text, after = text or "", (rows[(i + 1) % len(rows)][1] or "")
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        if i < 23:
            errors += [got[i].near_edited - generalised_jaccard(text, edited), got[i].near_next - generalised_jaccard(text, after)]
    assert abs(np.mean(errors)) < 0.03 and max(map(abs, errors)) < 0.25
    assert got[4].fingerprint == got[5].fingerprint and got[4].near_next == 1.0
    assert got[24].near_next == 1.0 and got[25].near_next == 0.0  # both empty; empty and not
    assert fingerprints.fingerprints(docs([]), 3).count() == 0
    assert fingerprints.fingerprints(docs(ODD), 3).count() == len(ODD)


def slow_fingerprint(text):
    """Ioffe's sampling term by term, with the hashes of the operator."""
    import xxhash

    h = lambda data, seed=42: xxhash.xxh64_intdigest(data, seed)
    signed = lambda x, size: int(x).to_bytes(size, "little", signed=True)
    wrap = lambda x: (x + 2**63) % 2**64 - 2**63
    weights = {w: n * len(w) for w, n in Counter(text.split()).items()}
    out = []
    for sample in range(fingerprints.SAMPLES):
        values = []
        for w, weight in weights.items():
            t = wrap((h(w.encode()) << 21) | (len(w) << 1)) >> 1
            first, second = (h(signed(k, 4), h(signed(t, 8))) for k in (sample, -1 - sample))
            u = [(x + 0.5) / 2**b for x, b in ((first >> 43, 21), (first >> 22 & (1 << 21) - 1, 21), (first & (1 << 22) - 1, 22), (second >> 32, 32), (second & 0xFFFFFFFF, 32))]
            r, beta, c = -math.log(u[0] * u[1]), u[2], -math.log(u[3] * u[4])
            y = math.exp(r * (math.floor(math.log(weight) / r + beta) - beta))
            values.append((c / (y * math.exp(r)), w, math.log(c) - r * (math.floor(math.log(weight) / r + beta) - beta) - r))
        import struct

        out.append(f"{h(struct.pack('<f', min(values)[2])) & 0xFFFFFFFF:08x}" if values else fingerprints.EMPTY)
    return out


def test_fingerprints_are_those_of_slow_sampling(docs):
    rng = random.Random(11)
    texts = [" ".join(f"w{int(rng.paretovariate(0.7)) % 90}é" for _ in range(rng.randrange(1, 60))) for _ in range(12)]
    d = docs(list(enumerate(texts))).withColumns({"terms": F.lit(1), "section": F.lit("s"), "fingerprint": F.lit("f"), "rn": F.lit(3)})
    got = sorted(fingerprints.fingerprints(d, 3).collect(), key=lambda r: r.doc_id)
    same = total = 0
    for r, text, after in zip(got, texts, texts[1:] + texts[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        for found, own in ((r.fingerprint, text), (r.edited_fingerprint, edited)):
            parts, want = [found[k : k + 8] for k in range(0, len(found), 8)], slow_fingerprint(own)
            same, total = same + sum(a == b for a, b in zip(parts, want, strict=True)), total + len(want)
    assert same > 0.99 * total  # logarithms may differ in the last bit


def test_fingerprints_of_very_long_texts_and_repeated_rows(docs):
    long = " ".join(f"w{k % 5_000}" for k in range(120_000))
    rows = [(1, long), (2, long + " w1"), (3, "z" * 2_000_000), (4, "same text"), (4, "same text"), (5, "other")]
    got = sorted(fingerprints.fingerprints(docs(rows), 2).collect(), key=lambda r: r.doc_id)
    assert got[0].near_next > 0.9 and got[2].n_chars == 2_000_000 and [r.near_next for r in got[3:5]] in ([1.0, 0.0], [0.0, 1.0]) and got[3].fingerprint == got[4].fingerprint


# 4


def test_quality_of_odd_rows(docs):
    d = docs(ODD + [(10 + i, " ".join(f"word{j}" for j in range(30 + i)), "en" if i % 2 else None, None) for i in range(40)] + [(60, "word " * 200_000, "en", "s")])
    got = {r.doc_id: r for r in quality.judge(d).select("doc_id", "stats", "quality").collect()}
    assert all(not got[i].quality.kept and got[i].quality.base_failed for i in (1, 2, 3, 4, 5, 7, 60, None))
    assert got[6].stats.n_repeat_words == got[6].stats.n_words == 120 and got[60].stats.n_repeat_words == 200_000
    assert all(got[i].quality.kept for i in range(10, 50))
    assert quality.judge(docs([])).count() == 0
    own = d.withColumns({"row": F.lit(1), "limit": F.lit(2), "s": F.lit("x"), "gl": F.lit(3), "a.b": F.lit(4)})
    found = quality.judge(own, stats="st", quality="q")
    assert found.columns == [*own.columns, "st", "q"] and found.count() == d.count() and found.select("`a.b`").first()[0] == 4
    with pytest.raises(ValueError):
        quality.judge(d.withColumn("Stats", F.lit(1)))
    assert quality.judge(d.select("doc_id", "text")).where("quality.kept").count() == 40  # no groups: all documents are one


def test_base_statistics_of_odd_rows(docs):
    rng, rows = random.Random(8), list(ODD)
    for i in range(10, 40):
        rows.append((i, "".join(rng.choice(["a", "bb", "# ", "<>", " ", " ", "\n", "\t", "é ", "a b c d e f g h "]) for _ in range(rng.randrange(200)))))
    for r in docs(rows).dropDuplicates(["doc_id"]).select("text", quality.base_statistics(F.col("text")).alias("s")).collect():
        text, w = r.text or "", (r.text or "").encode().split()
        keys = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        seen, again = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")], {x for k, c in zip(keys, map(Counter(keys).get, keys)) if c > 1 for x in [k]}
        covered = {k + j for k, x in enumerate(keys) if x in again for j in range(8)}
        want = (len(w), sum(len(x.decode()) for x in w), sum(x in "#*$%&|<>" for x in text), len(seen) - len(set(seen)), len(covered), sum(a == b for a, b in zip(w, w[1:])), len(seen))
        assert tuple(r.s) == want


def test_many_groups_are_joined_salted(docs, monkeypatch):
    d = docs([(i, " ".join(f"word{j}" for j in range(40)) + ("###" * 40 if i == 7 else ""), f"l{i % 3}", "s") for i in range(120)])
    want = sorted((r.doc_id, r.quality.kept) for r in quality.judge(d).select("doc_id", "quality").collect())
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 0)
    assert sorted((r.doc_id, r.quality.kept) for r in quality.judge(d).select("doc_id", "quality").collect()) == want
    assert [i for i, kept in want if not kept] == [7]


def test_the_same_value_is_inside_in_one_language_only(docs):
    """For each metric: texts of one language have none of it, texts of the other have it often; the odd one has it."""
    plain = lambda i, n=300: [f"w{1000 + i}x{j}" for j in range(n)]
    symbols = lambda i, k: " ".join(w + "#" * (j < k) for j, w in enumerate(plain(i)))
    lines = lambda i, k: "\n".join([f"line {1000 + i} {j} of some words" for j in range(60)] + [f"the same {1000 + i}"] * k)
    repeats = lambda i, k: " ".join(plain(i) + [f"r{i}x{j}" for j in range(8)] * k)
    echoes = lambda i, k: " ".join(plain(i) + ["again"] * k)
    length = lambda i, k: " ".join(w + "y" * k for w in plain(i))
    for make, spread, odd in ((symbols, 150, 150), (lines, 25, 25), (repeats, 8, 8), (echoes, 40, 40), (length, 3, 3)):
        rows = [(i, make(i, 0), "aa", "s") for i in range(60)] + [(100 + i, make(i, i * spread // 30), "bb", "s") for i in range(60)]
        rows += [(900, make(900, odd), "aa", "s"), (901, make(901, odd), "bb", "s")]
        got = {r.doc_id: r.quality.kept for r in quality.judge(docs(rows)).select("doc_id", "quality").collect()}
        assert not got[900] and got[901] and all(got[i] for i in range(60))


def test_small_groups_take_wider_fences(docs):
    text = lambda i, k: " ".join(f"w{1000 + i}x{j}" + "#" * (j < k) for j in range(300))
    rows = [(i, text(i, 0), "aa", "s") for i in range(60)] + [(100 + i, text(i, i * 5), "bb", "s") for i in range(60)]
    rows += [(900, text(900, 150), "aa", "rare"), (901, text(901, 150), "bb", "rare"), (902, text(902, 2), "cc", "rare")]
    got = {r.doc_id: r.quality.kept for r in quality.judge(docs(rows)).select("doc_id", "quality").collect()}
    assert not got[900] and got[901] and got[902]


# 5


def test_urls(spark, monkeypatch):
    seen = ["http://A.Example.ORG/es/x?q", "https://example.org/en/12", "https://x.example.org/en/2", "https://notexample.org/es/", "ftp://shop.com/de/", "https://a.com/fr", None, "nonsense", "https://example.org", "https://a.com/de/?u=http://b.org/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(seen)] + [(0, seen[0])], "page_id long, url string")
    want = ["example.org/es/", "example.org/en/1", "org/", "org/", "com/de/", None, None, None, None, "com/de/"]
    for limit in (urls.BROADCAST_RULES, 0):
        monkeypatch.setattr(urls, "BROADCAST_RULES", limit)
        got = urls.judge_urls(pages, urls.rule_table(spark, urls.RULES)).collect()
        assert sorted((r.page_id, r.rule or "") for r in got) == sorted([(i, w or "") for i, w in enumerate(want)] + [(0, want[0])])
    assert {r.verdict for r in urls.judge_urls(pages, urls.rule_table(spark, urls.RULES).limit(0), "block").collect()} == {"block"}


def test_urls_of_odd_rows(spark):
    schema = "page_id long, url string"
    rules = urls.rule_table(spark, [("allow", "a.com", "/x"), ("block", "com", "/x/y/z"), ("block", "a.com", "/x/y"), ("allow", "com", "/x/y"), ("allow", "b.com", "/same"), ("block", "b.com", "/same")])
    long = "http://a.com/x" + "/y" * 50_000
    rows = [(1, "http://a.com/x/y/z"), (2, "http://A.com/x/y"), (3, "http://b.com/same?x"), (4, long), (None, "http://c.com/"), (5, "://"), (6, "")]
    own = spark.createDataFrame(rows, schema).withColumns({"host": F.lit("no"), "rule": F.lit("no"), "digest": F.lit(1), "a.b": F.lit(2)})
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(own, rules).collect()}
    # of equal length the longer host, then block
    assert got[1] == ("a.com/x/y", "block") and got[2] == ("a.com/x/y", "block") and got[3] == ("b.com/same", "block") and got[4] == ("a.com/x/y", "block") and all(got[i] == (None, "allow") for i in (None, 5, 6))
    assert urls.judge_urls(spark.createDataFrame([], schema), rules).count() == 0


# 6


def brute_lines(rows, min_lines, min_chars):
    seqs = {i: [x for x in (t or "").split("\n") if x.split()] for i, t in rows}
    order = [(i, k) for i in sorted(seqs) for k in range(len(seqs[i]))]
    gone = {i: set() for i in seqs}
    for m in range(1, max(map(len, seqs.values())) + 1):
        seen = set()
        for i, k in order:
            run = tuple(seqs[i][k : k + m])
            if len(run) < m:
                continue
            if run in seen and (m >= min_lines or (m == 1 and len(run[0]) >= min_chars)):
                gone[i] |= set(range(k, k + m))
            seen.add(run)
    return {i: [x for k, x in enumerate(seqs[i]) if k not in gone[i]] for i in seqs}


@pytest.mark.parametrize("min_lines", [1, 2, 3, 4])
def test_line_runs(docs, min_lines):
    rng = random.Random(min_lines)
    words = ["a b", "c", "d d", "e", "x" * 60]
    rows = [(i, "\n".join(rng.choice([*words, "", f"own {i} {k}"]) for k in range(rng.randrange(1, 14)))) for i in range(25)]
    rows += [(50, None), (51, ""), (52, "a b\n" * 9)]
    got = {r.doc_id: r for r in lines.deduplicate(docs(rows).repartition(3), min_lines=min_lines).collect()}
    want = brute_lines(rows, min_lines, lines.MIN_CHARS)
    assert {i: [x for x in (r.text or "").split("\n") if x.split()] for i, r in got.items()} == want
    assert got[50].text is None and got[51].text == ""
    assert all(got[i].n_lines - got[i].n_removed == len(want[i]) for i in want)


def test_repeated_rows_are_no_copies(docs):
    rows = [(1, "first line\nsecond line")] * 2 + [(2, "first line\nsecond line\nthird")]
    got = sorted((r.doc_id, r.text) for r in lines.deduplicate(docs(rows)).collect())
    assert got == [(1, rows[0][1])] * 2 + [(2, "third")]
    assert lines.deduplicate(docs([])).count() == 0
    with pytest.raises(ValueError):
        lines.deduplicate(docs(rows).withColumn("N_Lines", F.lit(1)))
    own = docs(rows).withColumns({"d": F.lit(1), "th": F.lit(2), "row": F.lit(3), "runs": F.lit(4), "a.b": F.lit(5)})
    found = lines.deduplicate(own)
    assert found.columns == [*own.columns, "n_lines", "n_removed"] and sorted((r.doc_id, r.text) for r in found.collect()) == got


@pytest.mark.parametrize("bound", [0, 3])
def test_hot_lines(docs, monkeypatch, bound):
    """Lines and pairs of lines with more rows than the bound go the way of hot keys; long texts that repeat one line."""
    from meritgraph.llm import common

    monkeypatch.setattr(common, "LEAST_HOT", bound)
    monkeypatch.setattr(common, "MAX_HOT", 10)
    rows = [(i, "\n".join(["the hot line", "the next", f"own {i}"] if i % 2 else ["the hot line", f"own {i}", "the hot line", "the next", "more"])) for i in range(30)] + [(99, "the hot line\n" * 3_000)]
    got = {r.doc_id: [x for x in r.text.split("\n") if x.split()] for r in lines.deduplicate(docs(rows).repartition(3)).collect()}
    want = brute_lines(rows[:-1] + [(99, "the hot line\n" * 40)], lines.MIN_LINES, lines.MIN_CHARS)
    assert got == want


def test_copies_of_very_many_lines(docs):
    """Two texts of 100,000 lines that differ in their first and middle lines: the work grows with the lines."""
    text = lambda i: "\n".join(f"of {i} alone" if k in (0, 50_000) else f"line {k}" for k in range(100_000))
    got = {r.doc_id: r for r in lines.deduplicate(docs([(1, text(1)), (2, text(2))])).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == 99_998 and got[2].text == "of 2 alone\nof 2 alone"


# 7


def test_extraction_of_held_out_pages():
    net, rng = boilerplate.trained(), np.random.default_rng(123)
    right = total = 0
    for _ in range(120):
        page, labels = boilerplate.invented_page(rng)
        found = boilerplate.blocks(page)
        if len(found) == len(labels):
            p = net.run([boilerplate.features(found)])[0][0] >= 0.5
            right, total = right + int((p == np.array(labels, bool)).sum()), total + len(labels)
    assert right / total > 0.98


def test_extraction_of_the_tables_pages(spark):
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in registry.QUERIES["op7_html_extraction"](spark, SF).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        parts = (" ".join(html.unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n".join(x for x in parts if x) and r.n_chars == len(r.text)


def test_all_words_of_a_block_count():
    text = "aa " * 3_000 + "Cookies!"
    (places,), (weights,), rest = boilerplate.features([((boilerplate._place(0, "<p"),), text, 0.0)])
    got = dict(zip(places.tolist(), weights.tolist(), strict=True))
    assert got[boilerplate._place(1, "cookies")] == pytest.approx(1 / 3_001) and got[boilerplate._place(1, "aa")] == pytest.approx(3_000 / 3_001)
    assert rest[0, 2] == pytest.approx(1 / 3_001) and rest[0, 3] == pytest.approx(math.log1p(3_001) / 4)


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<script>x</script><!-- open <p>never"), (4, "u", "<p>" * 5000), (5, "u", "<"), (5, "u", "<")]
    got = boilerplate.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got) and got[2].text == ""
    found = boilerplate.blocks('<ul class="menu x"><li>a &amp; b<li>c</ul><p>d\n e<br>f<p><b>g</p>h')
    assert [t for _, t, _ in found] == ["a & b", "c", "d e f", "g", "h"] and {boilerplate._place(0, x) for x in ("<ul", "menu", "x", "<li")} == set(found[0][0])
    assert boilerplate.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    own = spark.createDataFrame([("keep", 1, "u", "<article><p>Some words of an article.</article>", "x")], "text string, page_id long, url string, html string, blocks string")
    assert boilerplate.extract(own).columns == ["page_id", "url", "text", "n_chars"] and boilerplate.extract(own).first().page_id == 1


@pytest.mark.parametrize("page, want", [
    ('<p><a title="a>b">two</a>', ["two"]), ("<p title='<p>no'>yes", ["yes"]), ('<p title="open>text<p>more', ["text", "more"]), ("<p data-x=it's>one</p><p>it's", ["one", "it's"]),
    ("1 < 2 &lt; 3", ["1 < 2 < 3"]), ("a<div class=x<p>b", ["a", "b"]), ("a<!-- <p>x --> b<!-->c", ["a bc"]), ("<SCRIPT>x</script foo><p>y", ["y"]), ("<title>t</titles></title>u", ["u"]), ("x<svg/>y<svg><p>z</svg>", ["xy"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]), ("a</b></p></nothing>b", ["a", "b"]), ("x<", ["x<"]), ("x</", ["x</"]), ("x<b", ["x"]), ("<p\n class = 'm'\n>n<br/>o", ["n o"]),
])
def test_broken_markup(page, want):
    assert [t for _, t, _ in boilerplate.blocks(page)] == want


@pytest.mark.parametrize("part", ["<ab", "<div>", "<div>x ", "</p>", "<p class='", '<p class="', "<b><h1></h1>", "<td><p><td><b>", "<!--", "<a =", "&", "< ", "<script>", "<x id=\" class='", "<p>x</p>", "<i class=kk>", "x<svg/>"])
def test_markup_is_read_in_linear_time(part):
    import time

    def cost(n):
        began = time.process_time()
        boilerplate.blocks(part * n)
        return time.process_time() - began

    cost(1_000)
    small, large = cost(20_000), cost(100_000)
    assert large < 2 or large < 12 * small


def test_deep_names_share_their_paths():
    rng = random.Random(1)
    page = "".join(f"<div class={''.join(rng.choice('abcdefghij') for _ in range(8))}>{i} " for i in range(30_000))
    found = boilerplate.blocks(page)
    assert len(found) == 30_000 and len(found[-1][0]) <= boilerplate.PATHS and len({id(p) for p, _, _ in found}) <= boilerplate.PATHS + 1


def test_labels_are_those_of_training(monkeypatch):
    net, rng = boilerplate.trained(), np.random.default_rng(5)
    pages = [boilerplate.features(boilerplate.blocks(boilerplate.invented_page(rng)[0])) for _ in range(9)] + [boilerplate.features([])]
    want = net.run(pages)[0]
    for bound in (boilerplate.FEATURES, 1, 40):
        monkeypatch.setattr(boilerplate, "FEATURES", bound)
        for a, b in zip(net.label(pages), want, strict=True):
            assert np.allclose(a, b, atol=1e-5)


def test_a_page_of_very_many_blocks():
    text = boilerplate.main_texts(["<nav>Home</nav><article>" + "<p>Some words make a sentence here.</p>" * 20_000 + "</article>"], boilerplate.trained())[0]
    assert text.count("\n") >= 19_900


# 8


def test_bucket_ends_are_optimal():
    from itertools import combinations

    rng = random.Random(2)
    for _ in range(30):
        sizes = sorted(rng.sample(range(1, 60), rng.randrange(1, 8)))
        histogram = [(s, n := rng.randrange(1, 9), s * n) for s in sizes]
        cost = lambda ends: sum(histogram[e][0] * sum(h[1] for h in histogram[a + 1 : e + 1]) - sum(h[2] for h in histogram[a + 1 : e + 1]) for a, e in zip([-1, *ends], ends))  # noqa: B023, E731
        k, last = rng.randrange(1, 5), len(histogram) - 1
        best = min(cost([*c, last]) for m in range(min(k, last + 1)) for c in combinations(range(last), m))
        ends = packing.bucket_ends(histogram, k)
        assert ends[-1] == last and len(ends) <= k and cost(ends) == best
    assert packing.bucket_ends([], 3) == []


def test_packing(docs, monkeypatch):
    monkeypatch.setattr(packing, "SECTION_ROWS", 20)
    rng = random.Random(3)
    rows = [(i, "w " * int(rng.paretovariate(0.7))) for i in range(150)] + [(900, None), (901, ""), (902, "w " * 5000), (902, "w " * 5000)]
    got = packing.pack(docs(rows), ["doc_id"], buckets=4, budget=200).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    batches = {}
    for r in got:
        batches.setdefault(r.batch, []).append(r)
        assert r.n_tokens <= r.padded_to
    for b in batches.values():
        assert len({r.padded_to for r in b}) == 1 and len({r.slot for r in b}) == len(b)
        assert len(b) == 1 or len(b) * b[0].padded_to <= 200
    assert packing.pack(docs([]), ["doc_id"]).count() == 0
    own = docs(rows).withColumns({"bucket": F.lit(1), "section": F.lit(2), "n_tokens": F.lit(3), "a.b": F.lit(4)})
    found = packing.pack(own, ["doc_id"], buckets=4, budget=200)
    assert found.columns == ["doc_id", "n_tokens", "bucket", "padded_to", "batch", "slot"] and sorted(map(repr, found.drop("batch", "slot").collect())) == sorted(map(repr, (r for r in packing.pack(docs(rows), ["doc_id"], buckets=4, budget=200).drop("batch", "slot").collect())))


# 9


def test_model_against_brute_force(docs):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("the The of cat dog ran x y z".split()) + str(rng.choice(["", "", rng.randrange(30)])) for _ in range(rng.randrange(40)))) for i in range(60)] + [(900, None), (901, "")]
    d = docs(rows)
    m = ngrams.train(d.where("doc_id < 40").repartition(3))
    tokens = {i: (t or "").encode().lower().split() + [b" "] for i, t in rows}
    seen = [tokens[i] for i in tokens if i < 40]
    c, pairs = Counter(x for t in seen for x in t), Counter(p for t in seen for p in zip([b"  ", *t], t))
    context, follow = c + Counter({b"  ": len(seen)}), Counter(b for _, b in pairs)
    classes = lambda x: [sum(v == k for v in x.values()) for k in (1, 2, 3, 4)]
    big, small = ngrams.discounts(classes(pairs)), ngrams.discounts(classes(follow))
    n, v, s = sum(c.values()), len(c), sum(follow.values())
    g1 = sum(small[min(x, 3) - 1] for x in follow.values()) / s
    gamma = Counter()
    for (a, _), x in pairs.items():
        gamma[a] += big[min(x, 3) - 1] / context[a]

    def p(a, b):
        q = g1 / (v + 1) + (max(follow[b] - small[min(follow[b], 3) - 1], 0) / s if follow[b] else 0)
        if a in context:
            x = pairs[(a, b)]
            q = q * gamma[a] + (max(x - big[min(x, 3) - 1], 0) / context[a] if x else 0)
        return q

    assert sum(p(b"the", b) for b in c) + p(b"the", b"never seen") == pytest.approx(1)
    got = ngrams.score(d, m).collect()
    assert len(got) == len(rows) and m.total == n and m.size == v
    for r in got:
        t = tokens[r.doc_id]
        assert r.n_tokens == len(t) and r.n_known == sum(x in c for x in t)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t))
        assert r.score == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip([b"  ", *t], t)), rel=1e-6)


def test_model_of_nothing_and_small_caches(docs, monkeypatch):
    empty = ngrams.train(docs([]))
    assert all(math.isfinite(r.score) for r in ngrams.score(docs(ODD), empty).collect())
    d = docs([(i, f"a b c{i} d{i % 3}") for i in range(30)])
    m = ngrams.train(d)
    want = [r.score for r in ngrams.score(d, m).orderBy("doc_id").collect()]
    monkeypatch.setattr(ngrams, "CACHE", 3)
    reader = ngrams.Reader(m)
    for _ in range(3):
        assert (reader.numbers([ngrams.START, b"a", b"b", b"c1", b"d1", b"c2", b"nope"]) >= 0).tolist() == [True] * 6 + [False]
    assert [r.score for r in ngrams.score(d, m).orderBy("doc_id").collect()] == want


def test_model_of_long_texts_repeated_rows_and_many_ranges(docs, monkeypatch):
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice(["the", "of", "a"] + [f"w{k}" for k in range(40)]) for _ in range(rng.randrange(1, 60)))) for i in range(40)]
    rows += [(90, "the of a " * 400), (91, "the of a"), (91, "the of a"), (92, "x" * 100_000)]
    d = docs(rows).withColumns({"n_tokens": F.lit(1), "score": F.lit("s"), "a.b": F.lit(2)})
    want = {(r.doc_id, r.n_tokens): (r.n_known, r.base_score, r.score) for r in ngrams.score(d, ngrams.train(d)).collect()}
    monkeypatch.setattr(ngrams, "RANGE_CHARS", 500)  # more ranges than partitions, and hot contexts
    monkeypatch.setattr(ngrams, "BLOCK_TOKENS", 37)
    m = ngrams.train(d)
    got = ngrams.score(d, m).collect()
    assert m.ranges > 100 and m.hot and len(got) == len(rows) and all(ngrams.Reader(m).paircounts[p].dtype == "<u8" for p in range(m.ranges))
    for r in got:
        assert (r.n_known, r.base_score, r.score) == pytest.approx(want[r.doc_id, r.n_tokens], rel=1e-6)
    assert [r.score for r in got if r.doc_id == 91][0] == [r.score for r in got if r.doc_id == 91][1]


def test_few_files_are_open_at_a_time(docs, monkeypatch):
    import os

    d = docs([(i, f"a b c{i} d{i % 3} e{i % 7}") for i in range(200)])
    monkeypatch.setattr(ngrams, "RANGE_CHARS", 20)
    m = ngrams.train(d)
    want = [r.score for r in ngrams.score(d, m).orderBy("doc_id").collect()]
    monkeypatch.setattr(ngrams, "MAPS", 6)
    reader, before = ngrams.Reader(m), len(os.listdir("/proc/self/fd"))
    assert m.ranges > 50
    for i in range(200):
        n = reader.numbers([ngrams.START, b"a", b"b", b"c%d" % i, b"d%d" % (i % 3), b"e%d" % (i % 7), ngrams.END])
        assert reader.log10(n[:-1], n[1:]).sum() == pytest.approx(want[i], rel=1e-9)
        assert len(os.listdir("/proc/self/fd")) <= before + 7


# 10


def test_language_held_out(spark):
    known = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = registry.QUERIES["op10_language_id"](spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(known[r.doc_id] == r.lang_pred for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(docs):
    d = docs([(i, t, "xx" if i else None, None) for i, t in ODD])
    found = language.learn(d)
    assert list(found) == ["xx"]
    got = {r.doc_id: r for r in language.classify(d, found, ["doc_id"]).collect()}
    assert all(got[i].lang_pred == "und" and got[i].lang_score == 0 for i in (1, 2, 3)) and got[6].lang_pred == "xx"
    assert {r.lang_pred for r in language.classify(d, {}, ["doc_id"]).collect()} == {"und"}
    keys, counts = language.trigrams("ab ab, ")
    assert len(keys) == 3 and sorted(counts) == [1, 2, 2] or counts.sum() == 5


def slow_language(text, prototypes):
    """Letters' vectors, bound and bundled one trigram after the other, and the cosine with each prototype."""
    letters = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    letters = " " + " ".join(letters.split()) + " "
    vector = lambda c: language.letter_vector(0 if c == " " else ord(c)).astype(int)
    total = np.zeros(language.DIMENSIONS, dtype=int)
    for k in range(len(letters) - 2):
        a, b, c = letters[k : k + 3]
        total += np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c)
    if prototypes is None:
        return total
    cosine = {l: total @ p / max(np.linalg.norm(total), 1e-9) / max(np.linalg.norm(p), 1) for l, p in prototypes.items()}
    best = max(sorted(cosine), key=cosine.get)
    return best, max(0.0, cosine[best])


def test_language_against_slow_vectors(docs, monkeypatch):
    rng = random.Random(6)
    pools = {"xx": "abcdefgé", "yy": "hijklmnabc", "zz": "αβγδab"}
    text = lambda l: " ".join("".join(rng.choice(pools[l]) for _ in range(rng.randrange(1, 6))) + rng.choice(["", ",", "7"]) for _ in range(rng.randrange(1, 25)))
    rows = [(i, text(l), l, "s") for i, l in enumerate(rng.choices(list(pools), k=60))]
    rows += [(100, rows[0][1], "xx", "s"), (100, rows[0][1], "xx", "s"), (101, text("xx") * 40, None, "s"), (102, "ab ab", None, "s")]
    want = {l: sum(slow_language(t, None) for _, t, own, _ in rows if own == l) for l in pools}
    for chars, size in ((language.BLOCK_CHARS, language.BLOCK_TRIGRAMS), (50, 7)):  # texts beyond both bounds
        monkeypatch.setattr(language, "BLOCK_CHARS", chars)
        monkeypatch.setattr(language, "BLOCK_TRIGRAMS", size)
        found = language.learn(docs(rows).repartition(3))
        assert {l: v.tolist() for l, v in found.items()} == {l: v.tolist() for l, v in want.items()}
        got = language.classify(docs(rows), found, ["doc_id", "text"]).collect()
        assert len(got) == len(rows)
        for r in got:
            best, score = slow_language(r.text, want)
            assert r.lang_pred == best and r.lang_score == pytest.approx(score, abs=1e-5)


def test_language_ties_and_empty_tables(docs):
    assert language.learn(docs([])) == {} and language.classify(docs([]), {"xx": np.ones(language.DIMENSIONS)}, ["doc_id"]).count() == 0
    same = language.learn(docs([(1, "some words here", "bb", "s"), (2, "some words here", "aa", "s")]))
    assert [r.lang_pred for r in language.classify(docs([(1, "some words"), (1, "some words")]), same, ["doc_id"]).collect()] == ["aa", "aa"]


def test_classified_columns(docs):
    d = docs([(1, "some words"), (2, None)]).withColumns({"lang_pred": F.lit(1), "text_": F.lit("t")})
    with pytest.raises(ValueError):
        language.classify(d, {}, d.columns)
    got = language.classify(d, language.learn(d), d.columns, "p", "s").orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == [1, 1] and [r.text_ for r in got] == ["t", "t"] and [r.text for r in got] == ["some words", None] and got[0].p == "en"


# pipeline


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_with_odd_rows_and_columns(spark, name, stage):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    names = ["stats", "quality", "Lang_Pred", "lang_score", "n_lines", "n_removed", "gone_id", "gone_text", "_gone", "row", "s", "limit", "lang_", "text_hash", "a.b", "bucket"]
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in ODD], frame.schema)
    both = frame.unionByName(odd).unionByName(frame.limit(20))
    want = sorted(map(repr, stage(spark, both, SF).collect()))
    extra = both.withColumns({x: F.concat(F.lit(x), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for x in names})
    found = stage(spark, extra, SF)
    if name != "packing":
        assert found.columns == extra.columns
        for r in found.select("doc_id", *(f"`{x}`" for x in names)).collect():
            assert list(r)[1:] == [f"{x}{'-' if r.doc_id is None else r.doc_id}" for x in names]
        assert sorted(map(repr, found.select(*frame.columns).collect())) == want
    else:
        assert found.columns == stage(spark, both, SF).columns and found.count() == len(want)
    nothing = stage(spark, extra.limit(0), SF)
    assert nothing.count() == 0 and nothing.columns == found.columns


@pytest.mark.parametrize("copies", [0, 2_000])
def test_language_stage_rejects_junk_and_unlearned_languages(spark, copies):
    rng, frame = random.Random(3), spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    clean = [(str(r.doc_id), r.text, r.lang if r.lang != "de" else None, r.source) for r in quality.judge(frame).where("quality.kept").collect()]
    unlearned = {r[0] for r in clean if r[2] is None}
    first = next(r for r in clean if r[2] == "en")
    clean += [(f"copy{i}", *first[1:]) for i in range(copies)]
    junk = []
    for name, letters in (("latin", "abcdefghijklmnopqrstuvwxyz"), ("cyrillic", "абвгдежзийклмнопрстуфхцчшщъыьэюя"), ("greek", "αβγδεζηθικλμνξοπρστυφχψω")):
        for i in range(40):
            text = " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 10))) for _ in range(rng.randint(25, 200)))
            junk.append((f"{name}{i}", text, None, None))
    d = spark.createDataFrame(clean + junk, "doc_id string, text string, lang string, source string").repartition(4)
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, d, SF).collect()}
    assert len(unlearned) > 3 and kept == {r[0] for r in clean} - unlearned


def test_pipeline(spark):
    before = spark.read.parquet(f"{SF}/documents.parquet")
    docs, columns = before, before.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, SF).cache()
        kept.append(found.count())
        assert kept[-1] > 0 and (found.columns == columns or name == "packing")
        if name == "quality_rules":
            want = {r.doc_id for r in registry.QUERIES["op4_quality_rules"](spark, SF).collect() if r.kept}
            assert {r.doc_id for r in found.collect()} == want
        if name == "line_dedup":
            want = {i for i, x in brute_lines([(r.doc_id, r.text) for r in docs.collect()], lines.MIN_LINES, lines.MIN_CHARS).items() if x}
            assert {r.doc_id for r in found.collect()} == want
        if name == "near_dedup":
            want = {i for i, (_, c) in brute_components([(r.doc_id, r.text) for r in docs.collect()], 5).items() if i == c}
            assert {r.doc_id for r in found.collect()} == want
        docs = found
    assert kept == sorted(kept, reverse=True) and kept[-1] == kept[-2]
    assert corpus_pipeline.run(spark, SF).count() == kept[-1]
