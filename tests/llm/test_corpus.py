import os
import random

import pytest
from pyspark.sql import functions as F

from allelora.llm import canonical, leakage, queries, spans, tokenize
from compare import duck, rows_of

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, word string, ids string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], DOCS)


FIELDS = {"chrom": "plain", "pos": "plain", "ref": "plain", "alts": "alleles", "info": "pairs"}


@pytest.fixture(scope="module")
def records(spark):
    rows = [
        (1, "chr1", "1000", "A", "C,G", "DP=5;AF=0.5"), (2, " CHR_1:", "1,000", "a", "{c;g}", "af = 0.5 | dp=5;;"), (3, "chr1", "1000", "A", "G,C", "DP=5;AF=0.5"),
        (4, "chr1", "1000", "A", "C,G", "DP=5;AF=05"), (5, "chr1", "1000", "A", "C,G", None), (6, "chr1", "1 000", "A", "C/G", None), (7, "chr1", "1000", "A", ".", ""),
        (8, "chr1", "1000", "A", "", ""), (9, None, None, None, None, None), (10, None, None, None, None, None), (11, "chr1", "1000", "A", "*", "DP=5"), (12, "chr1", "1000", "A", '"*"', "DP=5,DP=5"), (13, "chr1", "1000", "A", None, ""),
    ]
    return spark.createDataFrame(rows, "rec_id bigint, chrom string, pos string, ref string, alts string, info string").withColumns({"hash": F.lit("z"), "text": F.lit("z"), "first_id": F.lit(0)})


EQUAL = [(1, 2), (5, 6), (7, 8), (9, 10), (11, 12)]


@pytest.mark.parametrize("digest", [F.md5, lambda c: F.lit("00"), lambda c: F.substring(F.md5(c), 1, 1)])
def test_copies(records, digest):
    """With a hash that always collides the result is the same."""
    assert sorted(tuple(r) for r in canonical.later_copies(records, "rec_id", FIELDS, digest).collect()) == EQUAL
    groups = {r["first_id"]: r["copies"] for r in canonical.collapse(records, "rec_id", FIELDS, digest).collect()}
    assert groups == {1: 2, 3: 1, 4: 1, 5: 2, 7: 2, 9: 2, 11: 2, 13: 1}


def test_copies_of_nothing(records):
    assert canonical.later_copies(records.limit(0), "rec_id", FIELDS).count() == 0


def test_hot_copies(spark):
    rows = spark.range(500).select(F.col("id").alias("rec_id"), *(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias(c) for c in FIELDS))
    got = canonical.later_copies(rows, "rec_id", FIELDS).collect()
    assert sorted(r["id"] for r in got) == [i for i in range(3, 500, 3)] and {r["first_id"] for r in got} == {0}


TEXTS = [
    None, "", " ", "a", "Hello world's   end\n\n  x", "日本語のテキスト🎉🎉", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "x" * 3000, " " * 500 + "y", "=" * 101, "<|endoftext|>", "don't DON'T we'll",
    "١٢٣ ½ áb   z\u0085q", "\x1c\x1d\x00\x7f", "the the the", "the the the", "1234567890123", "\r\n\t x\r\n", "ÀÉ中文abc123!?",
]


@pytest.fixture(scope="module")
def tokenizer():
    pytest.importorskip("tokenizers")
    try:
        import public_tokenizers as P
    except ImportError:
        pytest.skip("no tokenizer files")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("hot", [0, 5, 32768])
def test_encoding(spark, tokenizer, hot):
    got = {r["doc_id"]: r["ids"] for r in tokenize.encode(docs(spark, TEXTS), hot_words=hot, min_hot=1).collect()}
    assert got == {i: None if t is None else tokenizer.encode(t, add_special_tokens=False).ids for i, t in enumerate(TEXTS)}


def test_encoding_does_not_depend_on_the_sample(spark, tokenizer):
    got = {r["doc_id"]: r["ids"] for r in tokenize.encode(docs(spark, TEXTS), min_hot=1, sample_texts=4).collect()}
    assert got == {i: None if t is None else tokenizer.encode(t, add_special_tokens=False).ids for i, t in enumerate(TEXTS)}


def test_long_words(spark, tokenizer):
    """Words folded in pieces, among them such whose pieces have no token in common."""
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyzÄÖ漢") for _ in range(n)) for n in (500, 513, 3000, 20000)]
    words += [p * (n // len(p)) for p in ("a", "ab", "abc", "theme", "interna", "Ü", "漢字語", "=", "-=", "   ") for n in (600, 1025, 5000)]
    words += ["".join(rnd.choice(["th", "e", "in", "ter", "aa", "ing"]) for _ in range(700)) for _ in range(5)] + ["1" * 2049, "".join(rnd.choice("0123456789") for _ in range(4100))]
    got = {r["doc_id"]: r["ids"] for r in tokenize.encode(docs(spark, words), hot_words=0).collect()}
    assert [i for i, w in enumerate(words) if got[i] != tokenizer.encode(w, add_special_tokens=False).ids] == []


def test_words_are_cut_where_no_token_lies(spark, tokenizer):
    """Words of letters are cut before capitals, so that fewer distinct ones are folded, but never inside of what may be a token."""
    vocab = tokenize.Vocab.load(tokenize.default_vocab_path())
    texts = [" segmentQuotaIndex LinkedIn", "realDonaldTrumpQuota", "ÄbQuota xÉquotaIndex HTTPServer"]
    got = [r[0] for r in docs(spark, texts).orderBy("doc_id").select(tokenize.split_words(F.col("text"), vocab)).collect()]
    assert got == [[" segment", "Quota", "Index", " LinkedIn"], ["realDonaldTrumpQuota"], ["ÄbQuota", " xÉquotaIndex", " HTTPServer"]]
    rnd = random.Random(5)
    inner = sorted(t.decode() for t in vocab.ids if t.isascii() and any(a.islower() and b.isupper() for a, b in zip(t.decode(), t.decode()[1:])))
    parts = [*inner, *(t[:n] for t in inner for n in (1, 2, 3)), *(t[-n:] for t in inner for n in (1, 2, 3)), *"azAZ", "quota", "Index", "É", "ß", "7", "'s", " "]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 8))) for _ in range(3000)] + inner
    for hot in (0, 32768):
        got = {r["doc_id"]: r["ids"] for r in tokenize.encode(docs(spark, texts), hot_words=hot, min_hot=1).collect()}
        assert [t for i, t in enumerate(texts) if got[i] != tokenizer.encode(t, add_special_tokens=False).ids] == []


@pytest.mark.parametrize("hot", [0, 32768])
def test_texts_with_marks(spark, tokenizer, hot):
    """Texts with the characters that mark rare words, and with those that stand for them."""
    rnd = random.Random(6)
    texts = ["\ue000", "\ue001", "a\ue000b\ue000", "\ue001\ue002", "\ue000\ue003 \ue001\ue001\ue003"] + ["".join(rnd.choice("\ue000\ue001\ue002\ue003ab' s\n") for _ in range(30)) for _ in range(60)]
    got = {r["doc_id"]: r["ids"] for r in tokenize.encode(docs(spark, texts), hot_words=hot, min_hot=1).collect()}
    assert got == {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}


def test_only_strings_are_written(spark, monkeypatch):
    """No array of a text's words is made into a column, which would copy each word; the frame between the steps has one string a text."""
    pytest.importorskip("public_tokenizers")
    kinds, real = [], tokenize.written
    monkeypatch.setattr(tokenize, "written", lambda df, **x: kinds.append([kind for _, kind in df.dtypes]) or real(df, **x))
    tokenize.encode(docs(spark, TEXTS))
    assert kinds == [["bigint", "string"]]


def test_frequent_words_are_bounded(spark, tokenizer):
    vocab = tokenize.Vocab.load(tokenize.default_vocab_path())
    texts = docs(spark, ["aaa bbb aaa", "aaa bbb ccc", "ccc ddd"]).select(F.col("doc_id").alias("__id"), F.col("text").alias("__text"))
    assert set(tokenize._frequent(texts, vocab, 100, 3, 1)) == {" bbb", "aaa", " ccc"} or len(tokenize._frequent(texts, vocab, 100, 3, 1)) <= 3
    assert tokenize._frequent(texts, vocab, 100, 0, 1) == {}
    assert len(tokenize._frequent(texts, vocab, 100, 100, 2)) == 2


def test_encoding_round_trip(spark, tokenizer):
    df = docs(spark, TEXTS)
    vocab = tokenize.Vocab.load(tokenize.default_vocab_path())
    back = {r["doc_id"]: r["t"] for r in tokenize.encode(df).select("doc_id", tokenize.decode(F.col("ids"), vocab).alias("t")).collect()}
    assert back == dict(enumerate(TEXTS))
    assert tokenize.encode(df.limit(0)).count() == 0


def brute_leaks(texts, items, words):
    import re

    split = lambda t: re.findall(r"[a-z0-9]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), t or ""), re.A)
    out = set()
    for i, t in enumerate(texts):
        w = split(t)
        grams = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)}
        for item, x in items:
            v = split(x)
            if any(tuple(v[k : k + words]) in grams for k in range(len(v) - words + 1)):
                out.add((i, item))
    return out


@pytest.mark.parametrize("block", [1, 10**6])
def test_leaks(spark, block):
    rng = random.Random(4)
    vocabulary = ["a", "b", "cc", "Dd", "é", "x1", "9"]
    text = lambda n: rng.choice([" ", "-", "K", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randrange(0, 9))) for i in range(20)] + [(50, None), (51, ""), (3, "other a b cc Dd")]
    texts = [text(rng.randrange(0, 60)) for _ in range(40)] + [None, "", "a" * 9000, (items[4][1] or "") * 300, "ccKcc"]
    it = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id bigint, text string, doc_id int")
    for words in (2, 4):
        got = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(docs(spark, texts), it, words=words, block_chars=block).collect()}
        assert got == brute_leaks(texts, items, words)
    assert leakage.leaks(docs(spark, texts), it.limit(0)).count() == 0
    assert leakage.leaks(docs(spark, texts).limit(0), it).count() == 0


def test_passages_do_not_depend_on_blocks(spark):
    """An item with two texts, and passages of several items, counted alike for any number of blocks."""
    it = spark.createDataFrame([(1, "a b c d", 0), (1, "w x y z", 0), (2, "a b c", 0), (3, "q r s", 0)], "item_id bigint, text string, doc_id int")
    df = docs(spark, ["a b c d, w x y z!", "A-B-C", None, "a b c q r s a b c"])
    for block in (1, 20, 10**6):
        got = sorted(tuple(r) for r in leakage.leaks(df, it, words=3, block_chars=block).collect())
        assert got == [(0, 1, 4), (0, 2, 1), (1, 1, 1), (1, 2, 1), (3, 1, 1), (3, 2, 1), (3, 3, 1)]


def brute_spans(texts, k):
    places = {}
    for i, t in enumerate(texts):
        for s in range(len(t or "") - k + 1):
            places.setdefault(t[s : s + k], set()).add(i)
    pairs = {(a, b) for g in places.values() for a in g for b in g if a < b}
    cover = {}
    for i, t in enumerate(texts):
        hit = set()
        for s in range(len(t or "") - k + 1):
            if len(places[t[s : s + k]]) > 1:
                hit |= set(range(s, s + k))
        if hit:
            cover[i] = len(hit)
    return pairs, cover


@pytest.mark.parametrize("piece, large, block", [(64, spans.LARGE, spans.BLOCK), (1 << 20, 0, 2)])
def test_shared_spans(spark, monkeypatch, piece, large, block):
    """Small pieces of texts, all buckets large, and pairs made in blocks give the same."""
    monkeypatch.setattr(spans, "PIECE", piece)
    monkeypatch.setattr(spans._pairs, "__defaults__", (block,))
    rng = random.Random(9)
    alphabet = "ab \n日🎉"
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    shared = [text(60) for _ in range(4)]
    texts = [text(rng.randrange(50)) + rng.choice(shared)[rng.randrange(20) :] + text(rng.randrange(50)) for _ in range(30)]
    texts += [None, "", "a", texts[0], texts[0] + "x", "ab" * 200, "ab" * 150, "a" * 300, shared[0] * 3, shared[1][:31], shared[1][:32], shared[1][:33]]
    pairs, cover = brute_spans(texts, 32)
    df = docs(spark, texts)
    assert {tuple(r) for r in spans.shared_pairs(df, k=32, m=8, large=large).collect()} == pairs
    got = spans.shared_stretches(df, k=32, m=8, large=large).groupBy("doc_id").agg(F.sum("n_chars").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == cover
    assert spans.shared_pairs(df.limit(0), k=32, m=8).count() == 0
    assert spans.shared_stretches(df.limit(0), k=32, m=8).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    pytest.importorskip("duckdb")
    if name == "p7_ids":
        pytest.importorskip("public_tokenizers")
    df = queries.QUERIES[name](spark, DATA)
    ours = rows_of(df.columns, df.collect())
    if name in queries.SQL:
        cur = duck(DATA).execute(queries.SQL[name])
        assert rows_of([c[0] for c in cur.description], cur.fetchall()) == ours
