"""Token counts by a compiled transducer, and exact token ids by cached words, for tokenizers of the ``tokenizers`` library.

Tokenizers that drop white space (``word_bpe_49k.json``) treat each run of characters between ASCII white space on its own:
normalisation, special strings, pre-tokenisation and merges never reach across. That makes a word's emission a function of
the word, and a text a walk through a finite-state transducer.

Compilation. States are prefixes of words; each byte is two transitions of four bits. The transition on a delimiter leads to
the start state and is annotated with the number of tokens of the word read so far. That number comes from the tokenizer's
merges, compiled into an automaton over the letters of a pre-token (``merges.Merges``). The transducer is deterministic and
made lazily, in each worker process: a word that it doesn't know ends in a dead or unannotated state, is run through the
merges' automaton and, when it comes again, compiled. A full table starts anew, so memory is bounded whatever the vocabulary.
The library normalises letters beyond ASCII, and counts whole only words that mix those with other characters, or hold the
marks of special strings.

Counting. A buffer of texts is cut into lanes of LANE bytes that advance together, one byte of every lane a step. A lane that
begins inside a word can't know its entry state; it skips to the first delimiter. What a lane does to the state is thus a map
"reset at a delimiter, open word since then", or, without a delimiter, "the open word goes on". These maps compose by a
parallel prefix scan (running maximum of delimiter positions), which yields the words that cross lanes; they are run as lanes
of their own. Words of over LONGEST bytes go to the library directly.

Other tokenizers get their texts encoded whole by the library.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import merges

LANE = 256
LONGEST = 255
SEGMENT = 4 << 20
MAX_STATES = 1_500_000
MAX_WORDS = 300_000

DELIMITERS = b" \t\n\x0b\x0c\r"
_TAIL = re.compile(rb"(.*?)([.,;:!?]+)", re.S)
_NEXT = re.compile(rb"[\x20\x09-\x0d]")
_MARKS = b".,;:!?"
_PRINTABLE = re.compile(rb"[!-~]+")
#: The pre-tokenizer's pattern, and what it means for printable ASCII in lower case.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_SPLIT_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def segments(data: bytes, size: int = SEGMENT) -> Iterator[bytes]:
    """``data`` in parts of about ``size`` bytes, each but the last ending with a delimiter."""
    at = 0
    while len(data) - at > size:
        cut = _NEXT.search(data, at + size)
        if not cut:
            break
        yield data[at : cut.end()]
        at = cut.end()
    yield data[at:]


class Words(dict):
    """Ids of words as little-endian 32-bit bytes, from the library. Up to ``limit`` words are kept, and as many from before
    the last time that it was full, so frequent words stay."""

    def __init__(self, path: str, limit: int = MAX_WORDS):
        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.limit, self.old = limit, {}
        # byte-level tokenizers show bytes that aren't printable Latin-1 as the code points from 256 on, in order
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte_letters = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}
        spec = json.loads(self.library.to_str())
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        normal = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        #: White space is dropped and nothing reaches across it.
        self.by_word = normal == ["NFC", "Replace", "Lowercase"] and split.get("behavior") == "Removed" and split.get("invert") is True and not spec.get("post_processor")
        self.by_word &= (split.get("pattern") or {}).get("Regex") == SPLIT and spec["model"].get("end_of_word_suffix") == "</w>"
        self.by_word &= not any(t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"] or not t["content"].startswith("<|") for t in spec["added_tokens"])

        self.merges = merges.Merges(spec["model"]) if self.by_word else None

    def count(self, word: bytes) -> int:
        """Tokens of a word without white space, by the merges' automaton wherever its pre-tokens are plain."""
        if b"<|" not in word:
            if _PRINTABLE.fullmatch(word):
                return sum(map(self.merges.count, _SPLIT_ASCII.findall(word.decode().lower())))
            m = _TAIL.fullmatch(word)
            head, tail = (m[1], m[2]) if m else (word, b"")
            if (normal := self.normal(head.decode())).isalpha():
                return self.merges.count(self.byte_form(normal)) + (self.merges.count(tail.decode()) if tail else 0)
        return len(self.encode(word.decode())) // 4

    def byte_form(self, normal: str) -> str:
        return normal if normal.isascii() else normal.encode().decode("latin-1").translate(self.byte_letters)

    def encode(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def normal(self, text: str) -> str:
        if text.isascii() or (text.isalpha() and max(text) <= "\xff"):
            return text.lower()  # letters of Latin-1 are composed, and each has its lower case in Latin-1
        return self.library.normalizer.normalize_str(text)

    def letters(self, text: str) -> bytes:
        """As ``encode``. A word of letters alone is a single pre-token and goes straight to the merges."""
        if text.isalpha():
            normal = self.normal(text)
            if normal.isalpha():
                return array("I", [t.id for t in self.library.model.tokenize(self.byte_form(normal))]).tobytes()
        return self.encode(text)

    def found(self, word: bytes) -> bytes:
        """The ids of a word that isn't kept, by those of others where it has the same."""
        if b"<|" in word:
            return self.letters(word.decode())
        head = word.rstrip(_MARKS)
        if head and len(head) < len(word) and (head.isalpha() or self.normal(head.decode()).isalpha()):
            return self[head] + self[word[len(head) :]]  # letters and other characters are apart; marks, as lower-casing may add, are not
        if word.isascii() and (low := word.lower()) != word:
            return self[low]  # the normaliser lower-cases; ASCII alone composes with nothing
        return self.letters(word.decode())

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.found(word)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """The ids of a whole text."""
        if not self.by_word:
            return self.encode(text)
        return b"".join([b"".join(map(self.__getitem__, part.split())) for part in segments(text.encode())])


_held: dict[tuple[str, int], Words] = {}


def words_for(path: str, limit: int = MAX_WORDS) -> Words:
    """The process's words of a tokenizer: a worker that gets another task keeps them."""
    if (path, limit) not in _held:
        _held[path, limit] = Words(path, limit)
    return _held[path, limit]


class Transducer:
    """Counts tokens of white-space-dropping tokenizers; see the module's text."""

    START, SKIP, DEAD = 0, 1, 2

    def __init__(self, words: Words, max_states: int = MAX_STATES):
        self.words, self.max_states = words, max_states
        self.delimiter = np.zeros(256, bool)
        self.delimiter[list(DELIMITERS)] = True
        self.reset()

    def reset(self) -> None:
        self.n = 3
        self.next = array("i", [self.DEAD] * 16 + [self.SKIP] * 16 + [self.DEAD] * 16)
        self.emit = array("H", [0, 0, 0])  # a word of LONGEST bytes can have more than 255 tokens
        self.known = bytearray([1, 1, 0])
        self.seen: dict[bytes, int] = {}

    def add(self, word: bytes, tokens: int) -> None:
        nxt, s = self.next, 0
        for byte in word:
            for half in (byte >> 4, byte & 15):
                t = nxt[s * 16 + half]
                if t == self.DEAD:
                    t = nxt[s * 16 + half] = self.n
                    self.n += 1
                    nxt.extend(_NO_MOVES)
                    self.emit.append(0)
                    self.known.append(0)
                s = t
        self.emit[s] = tokens
        self.known[s] = 1

    def run(self, lanes: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """lanes: bytes, a column each. Returns emissions and whether an unknown word ended, by position."""
        nxt, emit, known = np.frombuffer(self.next, np.int32), np.frombuffer(self.emit, np.uint16), np.frombuffer(self.known, np.uint8)
        out, lost = np.zeros(lanes.shape, np.uint16), np.zeros(lanes.shape, bool)
        ends = self.delimiter[lanes]
        high, low = lanes >> 4, lanes & 15
        for i in range(len(lanes)):
            end = ends[i]
            at = np.flatnonzero(end)
            if len(at):
                s = state[at]
                out[i, at] = emit[s]
                lost[i, at] = known[s] == 0
            state = nxt[nxt[state * 16 + high[i]] * 16 + low[i]]
            state[end] = 0
        return out, lost

    def count(self, data: np.ndarray) -> np.ndarray:
        """Emissions by position of a buffer (uint8) that ends with a delimiter: each word's tokens, at the byte after it."""
        n = -(-len(data) // LANE)
        padded = np.full(n * LANE, 32, np.uint8)
        padded[: len(data)] = data
        lanes = np.ascontiguousarray(padded.reshape(n, LANE).T)
        ends = self.delimiter[padded]
        inside = np.concatenate([[False], ~ends[LANE - 1 : -1 : LANE]])
        out, lost = self.run(lanes, np.where(inside, self.SKIP, self.START))
        total = np.ascontiguousarray(out.T).reshape(-1).astype(np.int32)
        # the prefix scan: where the word that is open at each lane's begin started, and the delimiter that ends it
        marks = np.where(ends, np.arange(len(padded), dtype=np.int64), -1).reshape(n, LANE)
        since = np.maximum.accumulate(marks.max(axis=1))
        begins = since[:-1][inside[1:]] + 1
        stop = np.flatnonzero(ends)
        crossing = np.unique(begins)
        dead = np.flatnonzero(np.ascontiguousarray(lost.T).reshape(-1))
        first = np.searchsorted(stop, dead)
        begin_dead = np.where(first > 0, stop[first - 1] + 1, 0)
        begin = np.concatenate([crossing, begin_dead])
        end = np.concatenate([stop[np.searchsorted(stop, crossing)] if len(crossing) else crossing, dead])
        begin, at = np.unique(begin, return_index=True)
        self.finish(padded, begin, end[at], total)
        return total[: len(data)]

    def finish(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, total: np.ndarray) -> None:
        """Counts the words data[begin:end] that lanes couldn't, and notes them at their ends."""
        size, raw = end - begin, data.tobytes()
        for b, e in zip(begin[size > LONGEST].tolist(), end[size > LONGEST].tolist(), strict=True):
            total[e] = len(self.words.encode(raw[b:e].decode())) // 4
        begin, end = begin[size <= LONGEST], end[size <= LONGEST]
        for k in range(0, len(begin), 20_000):
            bs, es = begin[k : k + 20_000], end[k : k + 20_000]
            at = bs + np.arange(int((es - bs).max(initial=0)) + 1)[:, None]
            lanes = np.where(at < es, data[np.minimum(at, len(data) - 1)], 32).astype(np.uint8)
            out, lost = self.run(lanes, np.zeros(len(bs), np.int64))
            where = (es - bs, np.arange(len(bs)))
            total[es] = out[where]
            unknown = lost[where]
            for b, e in zip(bs[unknown].tolist(), es[unknown].tolist(), strict=True):
                total[e] = self.learn(raw[b:e])

    def learn(self, word: bytes) -> int:
        """The tokens of a word that isn't in the table. Seen for the second time, it is compiled into it."""
        n = self.seen.pop(word, None)
        if n is not None:
            if self.n + 2 * len(word) > self.max_states:
                self.reset()
            self.add(word, n)
            return n
        n = self.words.count(word)
        if len(self.seen) >= MAX_WORDS:
            self.seen.clear()
        self.seen[word] = n
        return n


_NO_MOVES = array("i", [Transducer.DEAD] * 16)


class Counter:
    """Numbers of tokens for lists of texts, as UTF-8."""

    def __init__(self, path: str, max_states: int = MAX_STATES):
        self.words = words_for(path)
        self.transducer = Transducer(self.words, max_states)

    def __call__(self, texts: list[bytes]) -> list[int]:
        if not self.words.by_word:
            return [len(self.words.encode(x.decode())) // 4 for x in texts]
        out, parts, held, owners = [0] * len(texts), [], 0, []

        def flush() -> None:
            nonlocal parts, held, owners
            if parts:
                data = b"\n".join(parts) + b"\n"
                emitted = self.transducer.count(np.frombuffer(data, np.uint8))
                starts = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])
                for i, n in zip(owners, np.add.reduceat(emitted, starts).tolist(), strict=True):
                    out[i] += n
            parts, held, owners = [], 0, []

        for i, text in enumerate(texts):
            for part in segments(text):
                if held and held + len(part) > SEGMENT:
                    flush()
                parts.append(part)
                owners.append(i)
                held += len(part)
        flush()
        return out


_counters: dict[str, Counter] = {}


def counter_for(path: str) -> Counter:
    """The process's counter of a tokenizer: a worker that gets another task keeps what it has compiled."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, text_col: str = "text", path: str | None = None, limit: int = 2048) -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) added, one row per input row, in place.

    Null and empty texts have 0 of both. Texts are counted whole, at any length; rows that repeat are counted each. Empty
    input gives an empty result. Columns of those names are replaced; the tokenizer's file must exist on every executor.
    """
    path = path or tokenizer_path()

    @F.arrow_udf("bigint")
    def counted(texts: pa.Array) -> pa.Array:
        return pa.array(counter_for(path)([x or b"" for x in texts.cast(pa.binary()).to_pylist()]), pa.int64())

    n = counted(C.text_of(text_col))
    return docs.withColumn("n_bytes", F.octet_length(C.text_of(text_col)).cast("long")).withColumn("n_tokens", n).withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(C.documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
