"""Problem 7: encode a whole corpus with a public byte-level BPE vocabulary.

Method. The bytes of each pre-token are mapped to Latin-1 characters, a pyahocorasick automaton over the
vocabulary finds the longest token that starts at each byte, and a backtracking search accepts a token only
where it is compatible with the one before it. Two adjacent tokens are compatible if undoing their merges
never meets a pair that the merge order would have joined across the border; the answer depends on the two
tokens only and is memoised. The search visits each byte position at most once per token length, so a
pre-token of a million bytes costs linear time, and the result equals that of applying the merges in order.

Defined cases: null and empty text give an empty list; strings of special tokens are ordinary text; a lone
surrogate cannot occur in Spark's UTF-8 strings.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_TOKENIZERS = "/opt/tokenizers"
DEFAULT_VOCABULARY = "byte_bpe_50k.json"
#: Entries of a worker's memo after which it is emptied; results do not depend on it.
MEMO_WORDS, MEMO_PAIRS = 300_000, 1_000_000
#: The pre-token pattern of the vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary_path(tokenizers: str = DEFAULT_TOKENIZERS, name: str = DEFAULT_VOCABULARY) -> str:
    return os.path.join(tokenizers, name)


def _printable_bytes() -> dict[str, int]:
    """Character -> byte of the vocabulary file: printable Latin-1 bytes stand for themselves, the others are
    numbered from U+0100 in byte order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens as Latin-1 strings, the merge that makes each, and the automaton."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        model = json.load(open(path, encoding="utf-8"))["model"]
        to_byte = _printable_bytes()
        latin = lambda s: "".join(chr(to_byte[c]) for c in s)
        vocab = {}
        for shown, i in model["vocab"].items():
            if all(c in to_byte for c in shown):
                vocab[latin(shown)] = i
        self.merged: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            left, right = (latin(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.merged[a, b] = c
            if c not in self.parts:
                self.parts[c], self.rank[c] = (a, b), r
        self.text_of = {i: s for s, i in vocab.items() if len(s) == 1 or i in self.parts}
        self.pairs: dict[tuple[int, int], bool] = {}
        usable = {i: s for i, s in self.text_of.items() if i not in self.parts or self._compatible(*self.parts[i], self.rank[i])}
        self.ids = {s: i for i, s in usable.items()}
        self.auto = ahocorasick.Automaton()
        for s, i in self.ids.items():
            self.auto.add_word(s, (i, len(s)))
        self.auto.make_automaton()
        self.shorter: dict[int, int | None] = {}
        self.words: dict[str, list[int]] = {}
        self.split = regex.compile(PATTERN).findall

    def _compatible(self, left: int, right: int, below: int | None = None) -> bool:
        """Whether the merges leave `left` and `right` apart. The later of the two merges is undone first, as the
        one that happened last; a pair over the border that merges earlier than what was undone would have won."""
        last = below if below is not None else 1 << 60
        rank, parts, merged = self.rank, self.parts, self.merged
        while True:
            joined = merged.get((left, right))
            if joined is not None and rank[joined] < last:
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                last, left = a, parts[left][1]
            else:
                # of equal merges the left one happens first: at the border the right one is met later,
                # so a pair of the same rank as the undone right merge still wins
                last, right = b + 1, parts[right][0]

    def fits(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > MEMO_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._compatible(left, right)
        return known

    def _next_shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of `token`."""
        if token not in self.shorter:
            s = self.text_of[token]
            self.shorter[token] = next((self.ids[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in self.ids), None)
        return self.shorter[token]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token given as Latin-1."""
        n = len(word)
        longest: list[int] = [0] * n
        length = [0] * n
        for end, (i, size) in self.auto.iter(word):
            start = end + 1 - size
            if size > length[start]:
                longest[start], length[start] = i, size
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while at < n:
            while True:
                end = at + len(self.text_of[token])
                if not dead[end] and (not out or self.fits(out[-1], token)):
                    out.append(token)
                    at = end
                    if at < n:
                        token = longest[at]
                    break
                less = self._next_shorter(token)
                if less is not None:
                    token = less
                    continue
                dead[at] = 1
                if not out:
                    raise ValueError("the vocabulary cannot spell this text")
                token = out.pop()
                at -= len(self.text_of[token])
                # the popped token led to a dead end, which its end position now records
                break
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        words = self.words
        for w in self.split(text):
            ids = words.get(w)
            if ids is None:
                ids = self.encode_word(w.encode("utf-8", "surrogatepass").decode("latin-1"))
                if len(words) > MEMO_WORDS:
                    words.clear()
                if len(w) <= 64:
                    words[w] = ids
            out += ids
        return out


_LOADED: dict[str, Vocabulary] = {}


def load_vocabulary(path: str) -> Vocabulary:
    """One vocabulary per worker process; workers are reused between tasks."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids array<int>) for every row of `docs`; a narrow map without any shuffle.

    Null and empty texts give an empty list, repeated rows come out as often as they came in, an empty table
    gives an empty table, further columns are ignored."""
    path = path or vocabulary_path()
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_vocabulary(path).encode
        for b in batches:
            offsets, values = [0], []
            for t in b.column(1).to_pylist():
                values += encode(t)
                offsets.append(len(values))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["doc_id", "ids"])

    schema = T.StructType([T.StructField("doc_id", src.schema["doc_id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return src.mapInArrow(run, schema)


def count_tokens(docs: DataFrame, text_col: str = "text", out: str = "n_tokens", path: str | None = None) -> DataFrame:
    """`docs` with the number of tokens of `text_col` as column `out` (0 for null and empty)."""
    path = path or vocabulary_path()

    @F.pandas_udf(T.LongType())
    def size(texts):  # noqa: ANN001, ANN202
        encode = load_vocabulary(path).encode
        return texts.map(lambda t: len(encode(t)))

    return docs.withColumn(out, size(F.col(text_col)))
