"""Byte-level BPE in Spark expressions: ranked merges folded over the bytes of distinct words, decoding by joining pieces.

Method. A text is cut into words by the tokenizer's pattern. A word's bytes become an array of one-byte pieces beside an array
of the ranks of adjacent pairs; ``aggregate`` folds merges over them: each step joins the leftmost pair of the lowest rank and
looks up the ranks of its two new neighbours. Ranks come from a literal map, dealt into BUCKETS small maps, since Spark
searches a map from its start. A word that is a token itself is that token, as in the library.

Distinct words. Words are counted over all documents, and each of SLOTS hash slots keeps its most frequent word. Those words
are folded once and become a literal table (at most SLOTS words of at most KNOWN_BYTES bytes, so its size doesn't grow with
the corpus); a document's words are looked up in it by slot. Words that lost their slot are folded where they stand, by the
same expression, so nothing is shuffled but counts of distinct words, and a document of any size stays one row.

Long words. A fold's step copies its arrays, which is quadratic in a word's length. Words of over WINDOW bytes are therefore
encoded by windows that overlap: the next window begins at a token border in the middle of the last one. A sequence of tokens
is the encoding of its bytes exactly if each two adjacent tokens are the encoding of theirs (a first merge across a border
would be one in the pair alone as well). So if the next window's first token is the token that the last window has at this
place, the sequence through it is proven; if not, the last window is encoded again at twice the width.

Decoding looks pieces up by id in a literal array and concatenates them.

Null text counts as empty and has no tokens; empty tables give empty results; rows that repeat are encoded each; columns of any
name stay beside the result.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, lru_cache

import tiktoken
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

BUCKETS = 1 << 16
SLOTS = 1 << 17
KNOWN_BYTES = 48
WINDOW = 256
#: White space as the library understands it; Java's \\s has the ASCII ones only.
SPACE = "\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
#: Ids have at most so many bits; NEVER is the rank of what isn't a piece.
BITS = 20
NEVER = (1 << BITS) - 1
#: Separates the words of the literal table; words that hold it stay out of the table.
MARK = "\x01"


def java_pattern(pattern: str, letters: str = "", numbers: str = "") -> str:
    """The pattern with white space spelled out, for Java's regular expressions. letters, numbers: more of both, as ranges."""
    means = {"\\s": SPACE, "\\p{L}": f"\\p{{L}}{letters}", "\\p{N}": f"\\p{{N}}{numbers}"}
    out, in_class = "", False
    for part in re.findall(r"\\p\{\w\}|\\.|.", pattern, re.S):
        in_class = part == "[" or (in_class and part != "]")
        if part in means:
            part = means[part] if in_class else f"[{means[part]}]"
        out += f"[^{SPACE}]" if part == "\\S" else part
    return out


@lru_cache
def unknown_to_java(category: str) -> str:
    """Code points of a Unicode category that the library knows and this Java doesn't, as ranges of a character class. A library
    with the category as its pattern passes over everything else, and Java tells which of the rest it hasn't."""
    library = tiktoken.Encoding("points", pat_str=f"\\p{{{category}}}", mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    points = bytes(library.encode_ordinary("".join(chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF))).decode()
    spark = SparkSession.active()
    (new,) = spark.createDataFrame([(points,)], "points string").select(F.regexp_extract_all("points", F.lit(f"\\P{{{category}}}"), F.lit(0))).first()
    ranges: list[list[int]] = []
    for c in map(ord, new):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)


@dataclass(frozen=True)
class Tables:
    """The literal tables as variables of an expression."""

    ranks: Column
    pieces: Column
    pairs: Column

    def rank(self, piece: Column) -> Column:
        """The rank of a byte string, null if there is none."""
        return F.element_at(F.get(self.ranks, F.xxhash64(piece).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), piece)

    def piece(self, id: Column) -> Column:
        return F.get(self.pieces, id.cast("int"))

    def entry(self, id: Column, after: Column) -> Column:
        """An entry of the fold's array: the id with the rank of what it and the next piece would make."""
        return F.coalesce(self.rank(F.concat(self.piece(id), self.piece(after))), F.lit(NEVER).cast("long")) * F.lit(1 << BITS) + id


@dataclass(frozen=True)
class Vocabulary:
    """Ranks of pieces, which are their ids too, and the pattern that cuts words."""

    path: str
    pattern: str

    @cached_property
    def ranks(self) -> dict[bytes, int]:
        with open(self.path, "rb") as lines:
            return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}

    @cached_property
    def _rank_map(self) -> Column:
        """BUCKETS small maps from pieces, a character a byte, to ranks; a piece is in the bucket of its hash."""
        buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
        for piece, rank in self.ranks.items():
            key = piece.decode("latin-1")
            buckets[xxhash.xxh64(key.encode(), seed=42).intdigest() % BUCKETS][key] = rank
        return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,bigint>>")

    @cached_property
    def _by_id(self) -> list[bytes]:
        by_id = {rank: piece for piece, rank in self.ranks.items()}
        return [by_id.get(i, b"") for i in range(max(by_id) + 1)]

    @cached_property
    def _pieces(self) -> Column:
        """Pieces, a character a byte, by id."""
        return F.from_json(F.lit(json.dumps([piece.decode("latin-1") for piece in self._by_id])), "array<string>")

    @cached_property
    def _pairs(self) -> Column:
        """The fold's first entries: by a byte and the next one, or 256 for none, the byte's id and the pair's rank."""
        ids = [self.ranks[bytes([i])] for i in range(256)]
        entries = [(NEVER if b == 256 else self.ranks.get(bytes([a, b]), NEVER)) * (1 << BITS) + ids[a] for a in range(256) for b in range(257)]
        return F.from_json(F.lit(json.dumps(entries)), "array<bigint>")

    @cached_property
    def _hex_pieces(self) -> Column:
        return F.split(F.lit(",".join(piece.hex() for piece in self._by_id)), ",")

    @cached_property
    def _hex_ids(self) -> Column:
        return F.split(F.lit(",".join(i.to_bytes(4, "little").hex() for i in range(len(self._by_id)))), ",")

    def with_tables(self, body: Callable[[Tables], Column]) -> Column:
        """``body`` of the literal tables, each in the plan once however often the body uses it."""
        return C.bind(self._rank_map, lambda ranks: C.bind(self._pieces, lambda pieces: C.bind(self._pairs, lambda pairs: body(Tables(ranks, pieces, pairs)))))

    def words(self, text: Column) -> Column:
        """The pattern's matches. Texts with characters that Java's Unicode hasn't assigned yet need its longer form."""
        cut = lambda *more: F.regexp_extract_all(text, F.lit(java_pattern(self.pattern, *more)), F.lit(0))
        newer = (F.octet_length(text) > F.char_length(text)) & text.rlike("\\p{Cn}")
        return F.when(newer, cut(unknown_to_java("L"), unknown_to_java("N"))).otherwise(cut())


def public_vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> Vocabulary:
    import public_tokenizers

    return Vocabulary(public_tokenizers.path(name), public_tokenizers.PATTERN)


def _id(entry: Column) -> Column:
    return entry.bitwiseAND(F.lit((1 << BITS) - 1))


def merged(tables: Tables, data: Column) -> Column:
    """The ids of ``data``, a string with a character a byte, when no pair can be merged any more."""

    def step(entries: Column, _: Column) -> Column:
        # rank and place in one number (array_position would be slow: it leaves its loop by an exception)
        placed = F.transform(entries, lambda e, i: e.bitwiseAND(F.lit(-1 << BITS)) + i)
        return C.bind(F.array_min(placed), lambda low: F.when(low >= F.lit(NEVER << BITS), entries).otherwise(joined(entries, F.shiftright(low, BITS), _id(low).cast("int"))))

    def joined(entries: Column, id: Column, at: Column) -> Column:
        """Entries ``at`` and the next become one, the piece ``id``; the entry before it gets a new rank."""
        now = F.when(at + 2 < F.size(entries), tables.entry(id, _id(F.get(entries, at + 2)))).otherwise(F.lit(NEVER << BITS) + id)
        rest = F.slice(entries, at + 3, F.size(entries))
        before = tables.entry(_id(F.get(entries, at - 1)), id)
        # flatten copies its parts at once, where concat of arrays builds a lazy list of them
        return F.when(at == 0, F.flatten(F.array(F.array(now), rest))).otherwise(F.flatten(F.array(F.slice(entries, 1, at - 1), F.array(before, now), rest)))

    # a byte and the next one have their entry in a table of all pairs of bytes; 256 stands for the end
    codes = F.transform(F.split(data, ""), lambda c: F.ascii(c))
    after = lambda codes: F.zip_with(codes, F.slice(codes, 2, F.size(codes)), lambda a, b: F.get(tables.pairs, a * 257 + F.coalesce(b, F.lit(256))))
    return F.aggregate(F.slice(F.split(data, ""), 2, F.length(data)), C.bind(codes, after), step, lambda es: F.transform(es, lambda e: _id(e).cast("int")))


def _windows(tables: Tables, data: Column) -> Column:
    """The ids of long ``data``, by overlapping windows (see above)."""
    length = F.length(data)
    none = F.lit(None).cast("int")

    def width_of(ids: Column) -> Column:
        return F.aggregate(ids, F.lit(0), lambda n, i: n + F.length(tables.piece(i)))

    def state(at, width, done, kept, expect) -> Column:
        """at: place of the next window. done: ids before it. kept: how many of them there were a window ago. expect: the id that
        the next window has to begin with."""
        return F.struct(at.alias("at"), width.alias("width"), done.alias("done"), kept.alias("kept"), expect.alias("expect"))

    def step(s: Column, _: Column) -> Column:
        return F.when(s["at"] > length, s).otherwise(C.bind(merged(tables, F.substring(data, s["at"], s["width"])), lambda found: after(s, found)))

    def after(s: Column, found: Column) -> Column:
        back = state(s["at"] - width_of(F.slice(s["done"], s["kept"] + 1, F.size(s["done"]))), s["width"] * 2, F.slice(s["done"], 1, s["kept"]), s["kept"], none)
        last = state(length + 1, s["width"], F.concat(s["done"], found), F.size(s["done"]), none)
        half = C.bind(F.greatest(F.size(found).cast("int") / 2, F.lit(1)).cast("int"), lambda n: C.bind(F.slice(found, 1, n), lambda head: state(
            s["at"] + width_of(head), s["width"], F.concat(s["done"], head), F.size(s["done"]), F.get(found, n))))
        return F.when(F.coalesce(s["expect"] != F.get(found, F.lit(0)), F.lit(False)), back).when(s["at"] + s["width"] > length, last).otherwise(half)

    start = state(F.lit(1), F.lit(WINDOW), F.array().cast("array<int>"), F.lit(0), none)
    # half of a window's ids are kept, so at least WINDOW / 2 / longest piece of them; a step that widens is made up for by those after it
    steps = F.sequence(F.lit(0), length)
    return F.aggregate(steps, start, step, lambda s: s["done"])


def word_ids(tables: Tables, word: Column) -> Column:
    """The ids of one word of the pattern."""

    def encoded(data: Column) -> Column:
        return C.bind(tables.rank(data), lambda whole: F.when(whole.isNotNull(), F.array(whole.cast("int"))).when(F.length(data) <= WINDOW, merged(tables, data)).otherwise(_windows(tables, data)))

    return C.bind(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), encoded)


def slot(word: Column) -> Column:
    return F.xxhash64(word).bitwiseAND(F.lit(SLOTS - 1)).cast("int")


def known_words(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> DataFrame:
    """slot, word, ids: the most frequent word of each hash slot over all documents, at most SLOTS rows."""
    words = docs.select(F.explode(vocabulary.words(C.text_of(text_col))).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    fit = counts.filter((F.octet_length("word") <= KNOWN_BYTES) & ~F.contains("word", F.lit(MARK)))
    best = fit.groupBy(slot(F.col("word")).alias("slot")).agg(F.max(F.struct("n", "word")).alias("best"))
    return best.select("slot", F.col("best.word").alias("word"), vocabulary.with_tables(lambda tables: word_ids(tables, F.col("best.word"))).alias("ids"))


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text. See above."""
    words, ids = [""] * SLOTS, [[]] * SLOTS
    for row in known_words(docs, vocabulary, text_col).toLocalIterator():  # at most SLOTS short words
        words[row.slot], ids[row.slot] = row.word, row.ids
    keys, values = F.split(F.lit(MARK.join(words)), MARK), F.from_json(F.lit(json.dumps(ids)), "array<array<int>>")

    def of_word(tables: Tables, word: Column) -> Column:
        return C.bind(slot(word), lambda s: F.when(F.get(keys, s) == word, F.get(values, s)).otherwise(word_ids(tables, word)))

    words = vocabulary.words(C.text_of(text_col))
    return docs.withColumn(ids_col, vocabulary.with_tables(lambda tables: F.flatten(F.transform(words, lambda word: of_word(tables, word)))))


def decoded(vocabulary: Vocabulary, ids: Column) -> Column:
    """The bytes that ids stand for."""
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(vocabulary._hex_pieces, i)), ""))


def ids_bytes(vocabulary: Vocabulary, ids: Column) -> Column:
    """Ids as little-endian unsigned 32-bit integers."""
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(vocabulary._hex_ids, i)), ""))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_vocabulary()
    encoded = encode(C.documents(spark, sf_dir).select("doc_id", "text"), vocabulary)
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids_bytes(vocabulary, F.col("ids")), 256).alias("ids_sha256"), F.sha2(decoded(vocabulary, F.col("ids")), 256).alias("decoded_sha256")
    )
