"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For each prefix of a byte string exactly one token can be the last of its
valid encoding; ``Prefixes`` stores that token for every prefix. A token t
that ends at position n is the one sought if the last token of the prefix
before t may stand left of t, that is, if merging the two tokens' bytes gives
these two again (decided from the vocabulary's merge tree). So an append only
looks back from the new bytes, and after an edit the table is recomputed from
the edit until it agrees with the old one for as long as the longest token.

Texts are split by the vocabulary's pattern; pieces repeat, so every worker
keeps the encodings of pieces it has met (a bounded cache; a miss costs time
only). The vocabulary file is read on the driver and broadcast: its size is
that of the tokenizer, whatever the input.

Results: null encodes as the empty text, which has no tokens; texts of any
length are encoded whole; decoding gives the text's UTF-8 bytes. Rows repeat
as they are, further columns pass through, an empty table gives an empty
result."""

from __future__ import annotations

import base64
import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import packed, table

CACHE_PIECES = 300_000
CACHE_PAIRS = 200_000

# Unicode White_Space, and the letters, numbers and white space below U+0250.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LOW_SPACE, LOW_LETTERS, LOW_NUMBERS = "\t-\r \x85\xa0", "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"

_VOCABULARIES: dict = {}


def _spelled_out(pattern: str, classes: dict[str, str]) -> str:
    """The pattern with its character classes written as plain ranges."""
    out, inside = [], False
    for part in re.findall(r"\\[pP]\{\w+\}|\\.|.", pattern, re.S):
        inside = part == "[" or inside and part != "]"
        if part == r"\S":
            part = f"[^{classes[chr(92) + 's']}]"
        elif part in classes:
            part = classes[part] if inside else f"[{classes[part]}]"
        out.append(part)
    return "".join(out)


def splitter(pattern: str):
    """A function that cuts a text into the pattern's matches."""
    import regex

    low = re.compile(_spelled_out(pattern, {r"\s": LOW_SPACE, r"\p{L}": LOW_LETTERS, r"\p{N}": LOW_NUMBERS}))
    full = regex.compile(_spelled_out(pattern, {r"\s": SPACE}))
    beyond = re.compile("[^\x00-\u024f]").search

    def split(text: str) -> list[str]:
        return full.findall(text) if beyond(text) else low.findall(text)

    return split


class Vocabulary:
    """Ranks, merge tree and the pair test of one rank file."""

    def __init__(self, rank_file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line.strip())}
        self.texts = {i: t for t, i in self.ranks.items()}
        self.left, self.right, self.pairs, self.usable = {}, {}, {}, {}
        for text, i in self.ranks.items():
            halves = self._halves(text)
            if halves is None:
                continue  # no sequence of merges ends in this token
            self.usable[text] = i
            self.left[i], self.right[i] = halves
            if len(text) > 1:
                self.pairs[halves] = i
        #: Every tail of a usable token, with its id if it is one (else -1): looking back stops at a text outside.
        self.tails = dict.fromkeys((t[j:] for t in self.usable for j in range(len(t))), -1) | self.usable
        self.known: dict[tuple[int, int], bool] = {}

    def _halves(self, text: bytes):
        """The two tokens whose merge makes this token; None if merging its bytes ends otherwise."""
        if len(text) == 1:
            return self.ranks[text], self.ranks[text]
        parts = [text[i:i + 1] for i in range(len(text))]
        while len(parts) > 2:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                return None
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if all(p in self.ranks for p in parts) else None

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the bytes of tokens a and b leaves exactly a and b."""
        if (a, b) not in self.known:
            if len(self.known) >= CACHE_PAIRS:
                self.known.clear()
            self.known[a, b] = self._undo(a, b)
        return self.known[a, b]

    def _undo(self, a: int, b: int) -> bool:
        # take the merges back, latest first; a merge across the border that
        # would have come before the one taken back last forbids the pair
        before = 1 << 60
        while True:
            across = self.pairs.get((a, b))
            if across is not None and across < before:
                return False
            if a > b:
                sides = ("a", "b")
            else:
                sides = ("b", "a")
            for side in sides:
                if side == "a" and self.right[a] != a:
                    before, a = a, self.right[a]
                    break
                if side == "b" and self.left[b] != b:
                    before, b = b + 1, self.left[b]  # an equal rank further left comes first
                    break
            else:
                return True


class Prefixes:
    """The last token of every prefix of a growing byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        if data:
            self.append(data)

    def _extend(self, data: bytes, start: int, end: int):
        """Yields n after finding the last token of data[:n], for n from start + 1 to end."""
        v, last = self.vocabulary, self.last
        tails, known, fits = v.tails.get, v.known, v.fits
        for n in range(start + 1, end + 1):
            j = n - 1
            while (token := tails(data[j:n])) is not None:
                if token >= 0:
                    if j == 0:
                        break
                    fit = known.get((last[j - 1], token))
                    if fit or fit is None and fits(last[j - 1], token):
                        break
                j -= 1
                if j < 0:
                    token = None
                    break
            if token is None:
                raise ValueError("the vocabulary lacks a byte")
            last.append(token)
            yield n

    def append(self, more: bytes) -> None:
        start, self.data = len(self.data), self.data + more
        for _ in self._extend(self.data, start, len(self.data)):
            pass

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Exchange the bytes [start, end); returns how many prefixes were computed anew."""
        old_last, old_end, n_old = self.last, end, len(self.data)
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old_last[:start]
        longest = max(map(len, self.vocabulary.usable), default=1)
        shift, same, done = start + len(new) - old_end, 0, 0
        for n in self._extend(self.data, start, len(self.data)):
            token = self.last[n - 1]
            done += 1
            old = n - 1 - shift
            past = n > start + len(new) and old < n_old
            same = same + 1 if past and old_last[old] == token else 0
            if same >= longest:  # every later prefix sees the same last tokens as before
                self.last += old_last[old + 1:]
                break
        return done

    def tokens(self) -> list[int]:
        out, n = [], len(self.data)
        while n:
            token = self.last[n - 1]
            out.append(token)
            n -= len(self.vocabulary.texts[token])
        return out[::-1]


class Encoder:
    """Encodes and decodes whole texts; ids as decimal text, pieces cached."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.vocabulary = Vocabulary(rank_file)
        self.split = splitter(pattern)
        self.by_number = {str(i): t for i, t in self.vocabulary.texts.items()}
        self.older: dict[str, str] = {}
        encoder = self

        class Pieces(dict):
            def __missing__(self, piece):
                # two generations: what was used since the last change stays
                if len(self) >= CACHE_PIECES:
                    encoder.older = dict(self)
                    self.clear()
                ids = encoder.older.get(piece)
                self[piece] = ids = encoder.piece(piece.encode("utf-8", "surrogatepass")) if ids is None else ids
                return ids

        self.pieces = Pieces()

    def piece(self, data: bytes) -> str:
        whole = self.vocabulary.ranks.get(data)
        ids = [whole] if whole is not None else Prefixes(self.vocabulary, data).tokens()
        return " ".join(map(str, ids))

    def encode(self, text: str) -> str:
        """The ids of the text, decimal, joined by one space."""
        return " ".join(map(self.pieces.__getitem__, self.split(text)))

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.by_number.__getitem__, ids.split(" "))) if ids else b""


def encoder(rank_file: bytes, pattern: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    key = (hashlib.sha256(rank_file).digest(), pattern)
    if key not in _VOCABULARIES:
        _VOCABULARIES.clear()
        _VOCABULARIES[key] = Encoder(rank_file, pattern)
    return _VOCABULARIES[key]


def _shared(spark: SparkSession, rank_path: str | None, pattern: str | None):
    import public_tokenizers

    with open(rank_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return spark.sparkContext.broadcast((f.read(), pattern or public_tokenizers.PATTERN))


def encode_column(spark: SparkSession, rank_path: str | None = None, pattern: str | None = None):
    """Column function text -> array<int> of ids."""
    shared = _shared(spark, rank_path, pattern)

    @F.pandas_udf("array<int>")
    def encode(text: pd.Series) -> pd.Series:
        e = encoder(*shared.value)
        return pd.Series([[int(i) for i in e.encode(t).split()] if t else [] for t in text], dtype=object)

    return encode


def decode_column(spark: SparkSession, rank_path: str | None = None, pattern: str | None = None):
    """Column function array<int> of ids -> the bytes they stand for (null for null)."""
    shared = _shared(spark, rank_path, pattern)

    @F.pandas_udf("binary")
    def decode(ids: pd.Series) -> pd.Series:
        texts = encoder(*shared.value).vocabulary.texts
        return pd.Series([None if i is None else b"".join(texts[int(x)] for x in i) for i in ids], dtype=object)

    return decode


def digest_column(spark: SparkSession, rank_path: str | None = None, pattern: str | None = None):
    """Column function text -> (n_tokens, ids_sha256, decoded_sha256): encode, then decode the ids."""
    shared = _shared(spark, rank_path, pattern)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(text: pd.Series) -> pd.DataFrame:
        e, rows = encoder(*shared.value), []
        for t in text:
            ids = e.encode(t) if t else ""
            rows.append((ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(),
                         hashlib.sha256(e.decode(ids)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digest


def encode_documents(docs: DataFrame, rank_path: str | None = None, ids: str = "token_ids") -> DataFrame:
    """The documents with their token ids in column ``ids`` (replaced if it exists)."""
    rows = docs.select(packed(docs), encode_column(docs.sparkSession, rank_path)("text").alias("i"))
    kept = [c for c in docs.columns if c.lower() != ids.lower()]
    return rows.select(*[F.col("d").getField(c).alias(c) for c in kept], F.col("i").alias(ids))


def digests(docs: DataFrame, rank_path: str | None = None) -> DataFrame:
    return (docs.select("doc_id", digest_column(docs.sparkSession, rank_path)("text").alias("e"))
            .select("doc_id", "e.n_tokens", "e.ids_sha256", "e.decoded_sha256"))


def op4_byte_bpe(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"))
