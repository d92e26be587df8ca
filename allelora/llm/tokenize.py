"""Byte-level BPE encoding of a whole corpus with Spark higher-order functions.

Plan
----
1. The words of a bounded sample of texts are counted; those seen several times, at most ``hot_words``, are folded and go
   into a literal word map of bounded size. The sample changes the plan only, not the result.
2. Each text is cut into words once, by the tokenizer's pattern, words of letters also before capitals where no token of the
   vocabulary can lie across (``pieces``), so that fewer and shorter ones are left to fold, and encoded in place as far as the word
   map goes. Until the end its ids are one string, each id the character of that code, with each rare word between two marks; strings
   are shuffled and written several times more cheaply than arrays. The strings are written to the shared folder. Arrays of words
   don't leave the expression that makes them, as a column of them is a copy of each word.
3. Each distinct rare word is folded once: its bytes become an array of token ids, and a fold merges the
   adjacent pair of lowest rank until no pair has a rank. Ranks come from a literal rank map, hashed into buckets.
4. The rare words' ids are joined back by word, gathered by text, and set in between the marks. A word frequent enough to be a hot key is in the
   word map, so it isn't joined.

Defined results: a null text gives null ids; an empty text gives an empty array.
"""

from __future__ import annotations

import base64
import json
import re
from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelora.session import cut, written

#: Unicode White_Space, the class that ``\s`` means in the tokenizers' regex engines (fixed values).
SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The published pre-tokenization pattern of the vocabulary, for Java's regex engine (fixed values), and its part for letters.
LETTERS = r"\p{L}++"
WORDS = (
    r"'(?:[stmd]|re|ve|ll)| ?" + LETTERS + r"| ?\p{N}++| ?[^" + SPACE + r"\p{L}\p{N}]++"
    r"|[" + SPACE + r"]+(?![^" + SPACE + r"])|[" + SPACE + r"]+"
)
PAIR = 1 << 16
#: Slots of the two literal tables, for the rank map a prime, for words a power of two; a slot of the rank map holds about three entries.
PAIR_SLOTS = 16_411
WORD_SLOTS = 32_768
#: A cell of the fold holds, from its high bits down, the rank of the pair that a token forms with the one before it, its place among the
#: word's bytes, and its id. So cells of a word differ, and the least cell is the leftmost of the lowest rank.
PLACE_BITS, ID_BITS = 30, 16
RANK_BITS = PLACE_BITS + ID_BITS
#: The rank of pairs that aren't merged, above all others.
NONE = PAIR << RANK_BITS
#: Words of more bytes than LONG are folded in pieces. Pieces overlap by half; where pieces of a length have no token in common, longer ones are tried.
LONG = 512
PIECES = (256, 4096)
#: More than any array holds.
ALL = 1 << 30
#: Stands before and after a rare word among the characters of ids, which are below the surrogates.
MARK, IDS_END = "\ue000", 0xD800
#: What stands in a text for the mark itself, and for the character that makes that possible. The tokenizer's pattern has all of them in
#: one class, so the text is cut at the same places.
ESCAPES = (("\ue001", "\ue001\ue003"), (MARK, "\ue001\ue002"))


def default_vocab_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass(frozen=True)
class Vocab:
    """A byte-level BPE vocabulary: token bytes to ids, and the merge each longer token stems from."""

    ids: dict[bytes, int]
    merges: dict[tuple[int, int], int]

    @classmethod
    @lru_cache(maxsize=2)
    def load(cls, path: str) -> "Vocab":
        with open(path, "rb") as f:
            ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        if max(ids.values()) >= IDS_END:
            raise ValueError(f"ids must be below {IDS_END}")
        merges: dict[tuple[int, int], int] = {}
        for token, rank in sorted(ids.items(), key=lambda x: x[1]):
            parts = merge(ids, merges, token)
            if len(parts) == 2:
                merges[parts[0], parts[1]] = rank
        return cls(ids, merges)

    def encode_word(self, word: bytes) -> list[int]:
        return merge(self.ids, self.merges, word)


def merge(ids: dict[bytes, int], merges: dict[tuple[int, int], int], word: bytes) -> list[int]:
    """Plain fold of ranked merges over one word (used to prepare the vocabulary)."""
    parts = [ids[word[i : i + 1]] for i in range(len(word))]
    while len(parts) > 1:
        best = min((merges.get((a, b), PAIR) for a, b in zip(parts, parts[1:])), default=PAIR)
        if best == PAIR:
            break
        out: list[int] = []
        i = 0
        while i < len(parts):
            if i + 1 < len(parts) and merges.get((parts[i], parts[i + 1])) == best:
                out.append(best)
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _literal(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False, separators=(",", ":"))), kind)


def _buckets(entries, slots: int) -> list[dict | None]:
    table: list[dict | None] = [None] * slots
    for slot, key, value in entries:
        bucket = table[slot]
        if bucket is None:
            bucket = table[slot] = {}
        bucket[key] = value
    return table


def pair_table(vocab: Vocab) -> Column:
    """The literal rank map: small maps from ``left * 65536 + right`` to the merged id as a cell's rank, hashed into slots."""
    entries = ((k % PAIR_SLOTS, k, m << RANK_BITS) for (a, b), m in vocab.merges.items() for k in [a * PAIR + b])
    return _literal(_buckets(entries, PAIR_SLOTS), "array<map<string,bigint>>").cast("array<map<bigint,bigint>>")


def byte_cells(vocab: Vocab) -> tuple[Column, Column]:
    """Cells without their places: of a first byte, by its value, and of a byte after another one, by 256 times that one's value more."""
    ids = [vocab.ids[bytes([b])] for b in range(256)]
    first = _literal([NONE + i for i in ids], "array<bigint>")
    return first, _literal([(vocab.merges.get((a, b), PAIR) << RANK_BITS) + b for a in ids for b in ids], "array<bigint>")


def word_table(words: dict[str, str]) -> Column:
    """A literal map from words to their ids as characters, hashed into slots."""
    return _literal(_buckets(((_slot(w), w, ids) for w, ids in words.items()), WORD_SLOTS), "array<map<string,string>>")


def _slot(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode(), seed=42) % WORD_SLOTS


def lookup(words: Column, word: Column) -> Column:
    """Ids of ``word`` in a word table, as characters, or null."""
    return F.get(words, F.xxhash64(word).bitwiseAND(F.lit(WORD_SLOTS - 1)).cast("int"))[word]


def fold_merges(word: Column, vocab: Vocab) -> Column:
    """Ids of one word (string column) by folding ranked merges over its bytes; null for null.

    The folded state is an array of cells, one for each token. A step merges the leftmost pair of lowest rank and looks up the
    two ranks that change; the order is the same as when all places of that pair are merged at once. Words
    of more than LONG bytes are folded in overlapping pieces, see ``_pieced``, so their cost grows with their length.
    """
    first, second = byte_cells(vocab)
    # Each byte is one character of the text read as Latin 1.
    codes = F.transform(F.split(F.decode(word.cast("binary"), "ISO-8859-1"), ""), lambda c: F.ascii(c))
    size = F.octet_length(word)

    def encoded(b: Column, fold) -> Column:
        return F.when(size == 0, F.array().cast("array<int>")).when(size <= LONG, fold(b)).otherwise(_pieced(b, vocab, fold))

    def bound(*tables: Column) -> Column:
        return let(codes, lambda b: encoded(b, lambda c: _folded(c, *tables)))

    return let(pair_table(vocab), lambda r: let(first, lambda f: let(second, lambda s: F.when(word.isNotNull(), bound(r, f, s)))))


def _folded(codes: Column, ranks: Column, first: Column, second: Column) -> Column:
    """Ids of a non-empty array of bytes."""
    cell_id = lambda cell: cell.bitwiseAND(F.lit(PAIR - 1))
    none = F.lit(NONE)

    def rank(left: Column, right: Column) -> Column:
        key = left * F.lit(PAIR) + right
        return F.coalesce(F.get(ranks, (key % F.lit(PAIR_SLOTS)).cast("int"))[key], none)

    def merged(cells: Column, low: Column, left: Column) -> Column:
        # The pair's left token, at place ``left`` from 0, becomes the merged one; its right token goes. Slices and
        # concatenations of arrays would cost several times as much as these functions.
        m = F.shiftright(low, RANK_BITS)
        here = lambda x: F.when(left > 0, rank(cell_id(F.get(cells, left - 1)), m)).otherwise(none) + x.bitwiseAND(F.lit((1 << RANK_BITS) - PAIR)) + m
        after = lambda x: rank(m, cell_id(x)) + x.bitwiseAND(F.lit((1 << RANK_BITS) - 1))
        return F.transform(F.array_remove(cells, low), lambda x, i: F.when(i == left, here(x)).when(i == left + 1, after(x)).otherwise(x))

    def step(cells: Column, _: Column) -> Column:
        left = lambda low: F.array_position(cells, low).cast("int") - 2
        return let(F.array_min(cells), lambda low: F.when(low >= none, cells).otherwise(let(left(low), lambda at: merged(cells, low, at))))

    def cell(x: Column, i: Column) -> Column:
        plain = F.when(i == 0, F.get(first, x)).otherwise(F.get(second, F.get(codes, i - 1) * 256 + x))
        return plain + F.shiftleft(i.cast("bigint"), ID_BITS)

    return F.aggregate(F.array_remove(F.transform(codes, lambda x, i: i), 0), F.transform(codes, cell), step, lambda cells: F.transform(cells, lambda c: cell_id(c).cast("int")))


def _pieced(codes: Column, vocab: Vocab, fold) -> Column:
    """Ids of a long word, from those of overlapping pieces.

    A row of tokens is a word's encoding exactly if each two neighbours are the encoding of their bytes. So where two pieces have
    a token in common, at the same place, the tokens before it may be taken from one and those after it from the other.
    Where some overlap has none, longer pieces are taken, and in the end the whole word.
    """
    top = max(vocab.ids.values()) + 1
    sizes = [0] * top
    for token, i in vocab.ids.items():
        sizes[i] = len(token)
    return let(_literal(sizes, "array<int>"), lambda n: F.coalesce(*(_stitched(codes, fold, n, piece) for piece in PIECES), fold(codes)))


def _stitched(codes: Column, fold, sizes: Column, piece: int) -> Column:
    half = piece // 2

    def placed(begin: Column) -> Column:
        # Tokens as begin * 65536 + id, in order.
        ids = let(F.slice(codes, begin + 1, F.lit(piece)), fold)
        state = F.struct(begin.cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
        add = lambda s, i: F.struct((s["at"] + F.get(sizes, i)).alias("at"), F.array_append(s["out"], s["at"] * PAIR + i).alias("out"))
        return F.aggregate(ids, state, add, lambda s: s["out"])

    last = F.greatest(F.lit(0), F.size(codes) - half - 1)
    pieces = F.transform(F.sequence(F.lit(0), last, F.lit(half)), placed)

    def joined(p: Column) -> Column:
        # The first token that each piece has in common with the next one.
        common = F.transform(F.slice(p, F.lit(2), F.lit(ALL)), lambda x, i: F.array_min(F.array_intersect(F.get(p, i), x)))

        def own(c: Column) -> Column:
            part = F.transform(p, lambda x, i: F.filter(x, lambda t: (t >= F.coalesce(F.get(c, i - 1), F.lit(0).cast("bigint"))) & (t < F.coalesce(F.get(c, i), F.lit((1 << 63) - 1)))))
            return F.when(F.forall(c, lambda x: x.isNotNull()), F.transform(F.flatten(part), lambda t: t.bitwiseAND(F.lit(PAIR - 1)).cast("int")))

        return let(common, own)

    return let(pieces, joined)


def pieces(vocab: Vocab) -> str:
    """The tokenizer's pattern, with words of letters cut between a small and a capital ASCII letter too, except inside of what may be a token.

    A merge makes a token, so where no token has the letters on both sides as they stand there no merge goes across, and the ids of a word
    are those of its pieces. Of a token's letters around such a place only ASCII ones next to it are compared, and after a place that isn't
    cut the rest of the word stays whole, so at most too few places are cut.
    """
    spans = {(a[0], b[0]) for t in vocab.ids for i in range(1, len(t)) if (a := re.search(rb"[A-Za-z]*[a-z]\Z", t[:i])) and (b := re.match(rb"[A-Z][A-Za-z]*", t[i:]))}
    across = defaultdict(list)
    for a, b in sorted(spans):
        if not any((a[-i:], b[:j]) in spans for i in range(1, len(a) + 1) for j in range(1, len(b) + 1) if (i, j) != (len(a), len(b))):
            across[b[:1].decode()].append(f"(?<={a.decode()}{b[:1].decode()}){b[1:].decode()}")
    within = "".join(f"(?!{c}(?:{'|'.join(x)}))" for c, x in across.items())
    return WORDS.replace(LETTERS, rf"(?:[A-Z]?+[a-z]++(?:(?=[A-Z]){within}|\p{{L}}*+)|{LETTERS})")


def split_words(text: Column, vocab: Vocab) -> Column:
    """The words of a text by the tokenizer's pattern, or ``pieces`` of them; joined again they give the text."""
    return F.regexp_extract_all(text, F.lit(pieces(vocab)), F.lit(0))


def escaped(text: Column) -> Column:
    for plain, stand_in in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(stand_in))
    return text


def unescaped(text: Column) -> Column:
    for plain, stand_in in reversed(ESCAPES):
        text = F.replace(text, F.lit(stand_in), F.lit(plain))
    return text


def _frequent(texts: DataFrame, vocab: Vocab, sample_texts: int, hot_words: int, min_hot: int) -> dict[str, str]:
    """The frequent words of a sample of about ``sample_texts`` escaped texts and their ids as characters: at most ``hot_words``, each seen ``min_hot`` times or more."""
    share = sample_texts / max(1, texts.count())
    sample = texts.sample(share, seed=7) if share < 1 else texts
    counted = cut(sample.select(F.explode(split_words(F.col("__text"), vocab)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    # How often a count occurs: as many rows as there are different counts. The least count that keeps within the bound.
    counts = sorted((r for r in counted.where(F.col("n") >= min_hot).groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()), reverse=True)
    within = [n for (n, _), total in zip(counts, accumulate(c for _, c in counts)) if total <= hot_words]
    if not within:
        return {}
    return {r[0]: "".join(map(chr, r[1])) for r in counted.where(F.col("n") >= within[-1]).select("word", fold_merges(unescaped(F.col("word")), vocab).alias("ids")).collect()}


def encode(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocab_path: str | None = None,
    hot_words: int = 32_768,
    min_hot: int = 2,
    sample_texts: int = 4_000,
) -> DataFrame:
    """Token ids of every text: rows (``id_col``, ids array<int>), one for each row of ``df``.

    ``id_col`` must be unique. A null text has null ids, an empty text an empty array; a text of
    any length is encoded whole. ``hot_words``, ``min_hot`` and ``sample_texts`` choose the words that travel as a literal to every
    task: of a sample of about ``sample_texts`` texts, the words seen at least ``min_hot`` times, at most ``hot_words``. They change the plan, not the result.
    Other columns of ``df`` are ignored.
    """
    vocab = Vocab.load(vocab_path or default_vocab_path())
    texts = df.select(F.col(id_col).alias("__id"), escaped(F.col(text_col)).alias("__text"))
    known = word_table(_frequent(texts, vocab, sample_texts, hot_words, min_hot))
    marked = F.transform(split_words(F.col("__text"), vocab), lambda w: F.coalesce(lookup(known, w), F.concat(F.lit(MARK), w, F.lit(MARK))))
    coded = written(texts.select("__id", F.array_join(marked, "").alias("__coded")), codec="snappy")

    # Of the parts between marks, those at odd places are rare words.
    spots = coded.where(F.contains("__coded", F.lit(MARK))).select("__id", F.posexplode(F.split("__coded", MARK)).alias("at", "word")).where(F.col("at").bitwiseAND(F.lit(1)) == 1).withColumn("word", unescaped(F.col("word")))
    chars = _literal([chr(i) for i in range(max(vocab.ids.values()) + 1)], "array<string>")
    folded = let(chars, lambda c: F.array_join(F.transform(fold_merges(F.col("word"), vocab), lambda i: F.get(c, i)), ""))
    # Each word is in one row of ``words``, so its hash table has no skew.
    words = spots.groupBy("word").agg(F.lit(0).alias("one")).select("word", folded.alias("word_ids")).hint("shuffle_hash")
    found = spots.join(words, "word").groupBy("__id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "word_ids"))), lambda x: x["word_ids"]).alias("__found"))
    # Known stretches and the rare words between them, in turn.
    set_in = F.array_join(F.zip_with(F.split("__coded", MARK), "__found", lambda s, w: F.concat(s, F.coalesce(w, F.lit("")))), "")
    whole = F.when(F.col("__found").isNull(), F.col("__coded")).otherwise(set_in)
    known_only = F.regexp_replace("__coded", f"{MARK}[^{MARK}]*+{MARK}", MARK)
    joined = coded.select("__id", known_only.alias("__coded")).join(found, "__id", "left").select(F.col("__id").alias(id_col), whole.alias("__ids"))
    ids = F.transform(F.split("__ids", ""), lambda c: F.ascii(c))
    return joined.select(id_col, F.when(F.col("__ids") == "", F.array().cast("array<int>")).otherwise(ids).alias("ids"))


def decode(ids: Column, vocab: Vocab) -> Column:
    """Text of an array of ids: the tokens' binary pieces, concatenated two by two until one is left, read as UTF-8.

    Null for null ids, empty for none; ids outside the vocabulary stand for nothing. A piece is copied once in each of the about log2(n) rounds.
    """
    by_id = [""] * (max(vocab.ids.values()) + 1)
    for token, i in vocab.ids.items():
        by_id[i] = base64.b64encode(token).decode()
    empty = F.lit(b"")

    def halved(parts: Column, _: Column) -> Column:
        pair = lambda x, i: F.concat(x, F.coalesce(F.get(parts, i * 2 + 1), empty))
        return F.transform(F.filter(parts, lambda x, i: i % 2 == 0), pair)

    rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(F.size(ids) + F.lit(1.0))).cast("int") + 1))
    pieces = lambda tokens: F.transform(ids, lambda i: F.coalesce(F.get(tokens, i), empty))
    joined = let(_literal(by_id, "array<binary>"), lambda tokens: F.aggregate(rounds, pieces(tokens), halved, lambda p: F.coalesce(F.get(p, F.lit(0)), empty)))
    return F.when(ids.isNotNull(), F.decode(joined, "UTF-8"))
