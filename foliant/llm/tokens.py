"""Encoding of a corpus with a public byte-level BPE vocabulary, by dynamic programming over byte prefixes.

For every byte prefix of a piece there is exactly one token that ends the prefix's encoding. It is the one vocabulary entry
that ends there whose predecessor (the last token of the shorter prefix) would not have merged with it. Storing that token
for each prefix gives the encoding of all prefixes at once, so that text can be appended without encoding again what is
there, and an edit needs encoding again only from the edited piece to the next piece that stayed as it was.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k"
#: Fixed value: the pattern that cuts a text into the pieces within which tokens may lie.
PIECE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose ids a worker remembers; beyond it the memory starts anew (speed only, never the result).
REMEMBERED_PIECES = 200_000


def _byte_letters() -> dict[str, int]:
    """The vocabulary file spells bytes as letters: printable Latin-1 stands for itself, the rest follows from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class PrefixEncoder:
    """Byte-level BPE over one vocabulary file."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        spell = {word: "".join(chr(letters[c]) for c in word) for word in model["vocab"] if all(c in letters for c in word)}
        merged: dict[int, tuple[int, int]] = {}
        self.merge_of: dict[tuple[int, int], int] = {}
        vocab = model["vocab"]
        self.rank: dict[int, int] = {}
        for order, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            token = vocab[left + right]
            if token not in merged:
                merged[token] = (vocab[left], vocab[right])
            self.merge_of[vocab[left], vocab[right]] = order
            self.rank[token] = order
        self.parts = merged
        self.id_of: dict[str, int] = {}
        finder = ahocorasick.Automaton()
        for word, token in vocab.items():
            if word in spell and (token in merged or len(word) == 1):
                self.id_of[spell[word]] = token
                finder.add_word(spell[word], (len(spell[word]), token))
        finder.make_automaton()
        self.ends = finder
        self.pieces = regex.compile(PIECE_PATTERN)
        self.known: dict[str, list[int]] = {}
        self.compatible: dict[tuple[int, int], bool] = {}

    def _stays_apart(self, left: int, right: int) -> bool:
        """Whether merging runs its course inside both tokens without any merge across their border.

        Both tokens are taken apart from the outside in, the later merge first. At each stage the tokens at the border
        are those that stood there at some time of merging; a merge of them that ranks before the one that
        ended their time would have come first.
        """
        key = (left, right)
        if (got := self.compatible.get(key)) is not None:
            return got
        never = len(self.merge_of) + 1
        ends_left = ends_right = never  # rank of the merge that swallowed the token at the border
        ok = True
        while True:
            across = self.merge_of.get((left, right))
            # merges of one rank go from left to right: before an equal one in the right token, after one in the left
            if across is not None and across < ends_left and across <= ends_right:
                ok = False
                break
            split_left, split_right = self.rank.get(left, -1), self.rank.get(right, -1)
            if split_left < 0 and split_right < 0:
                break
            if split_left > split_right:
                ends_left, left = split_left, self.parts[left][1]
            elif split_right >= 0:
                ends_right, right = split_right, self.parts[right][0]
        if len(self.compatible) > 4_000_000:
            self.compatible.clear()
        self.compatible[key] = ok
        return ok

    def last_tokens(self, piece: str) -> tuple[list[int], list[int]]:
        """For every byte prefix of a piece (bytes as Latin-1) its last token and that token's length."""
        n = len(piece)
        tokens, lengths = [-1] * (n + 1), [0] * (n + 1)
        for end, (length, token) in self.ends.iter(piece):
            end += 1
            if tokens[end] >= 0:
                continue
            start = end - length
            if start == 0 or (tokens[start] >= 0 and self._stays_apart(tokens[start], token)):
                tokens[end], lengths[end] = token, length
        return tokens, lengths

    def piece_ids(self, piece: str) -> list[int]:
        """The ids of one piece."""
        got = self.known.get(piece)
        if got is None:
            raw = piece.encode("utf-8", "surrogatepass").decode("latin-1")
            whole = self.id_of.get(raw)
            if whole is not None:
                got = [whole]
            else:
                tokens, lengths = self.last_tokens(raw)
                got, at = [], len(raw)
                while at:
                    got.append(tokens[at])
                    at -= lengths[at]
                got.reverse()
            if len(self.known) >= REMEMBERED_PIECES:
                self.known.clear()
            self.known[piece] = got
        return got

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text, without special tokens; an empty list for an empty or null text."""
        out: list[int] = []
        if text:
            for piece in self.pieces.findall(text):
                out += self.piece_ids(piece)
        return out


class EditableEncoding:
    """A text with its ids that takes appended text and edits without encoding again what stays.

    A cut between two pieces holds for any continuation once the pattern has looked one piece ahead, so
    text is cut again from one piece before the edit until a cut falls on an old one after the edit.
    """

    def __init__(self, encoder: PrefixEncoder, text: str = ""):
        self.encoder, self.text = encoder, ""
        self.starts: list[int] = []
        self.piece_ids: list[list[int]] = []
        self.encoded_chars = 0
        self.replace(0, 0, text)

    @property
    def ids(self) -> list[int]:
        return [x for ids in self.piece_ids for x in ids]

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        """Put new in place of text[start:end]."""
        from bisect import bisect_left

        text = self.text[:start] + new + self.text[end:]
        shift = len(new) - (end - start)
        first = max(0, bisect_left(self.starts, start) - 2)
        at = self.starts[first] if first < len(self.starts) else 0
        settled = {s + shift: i for i, s in enumerate(self.starts) if s >= end + 2}
        starts, ids, resume = self.starts[:first], self.piece_ids[:first], len(self.starts)
        for m in self.encoder.pieces.finditer(text, at):
            if m.start() in settled and m.start() > start + len(new):
                resume = settled[m.start()]
                break
            starts.append(m.start())
            ids.append(self.encoder.piece_ids(m.group()))
            self.encoded_chars += len(m.group())
        self.text = text
        self.starts = starts + [s + shift for s in self.starts[resume:]]
        self.piece_ids = ids + self.piece_ids[resume:]


@lru_cache(maxsize=4)
def encoder(path: str) -> PrefixEncoder:
    """The encoder of a vocabulary file, built once in each worker process."""
    return PrefixEncoder(path)


def vocabulary_path(tokenizer: str = TOKENIZER, tokenizer_dir: str = TOKENIZER_DIR) -> str:
    return os.path.join(tokenizer_dir, f"{tokenizer}.json")


def token_ids(text: Column, path: str) -> Column:
    """Ids of a text column; an empty array for empty and null texts."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(texts):
        import pandas as pd

        enc = encoder(path)
        return pd.Series([enc.encode(x) for x in texts], dtype=object)

    return run.asNondeterministic()(text)


def token_count(text: Column, path: str) -> Column:
    """Number of ids of a text column; 0 for empty and null texts."""

    @F.pandas_udf(T.LongType())
    def run(texts):
        import pandas as pd

        enc = encoder(path)
        return pd.Series([sum(len(enc.piece_ids(p)) for p in enc.pieces.findall(x)) if x else 0 for x in texts], dtype="int64")

    return run.asNondeterministic()(text)


def encode_corpus(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, tokenizer_dir: str = TOKENIZER_DIR
) -> DataFrame:
    """id and ids of every row, in one pass without a shuffle.

    Nulls in either column are allowed: a null or empty text has the empty array, a null id stays null. Repeated rows
    come out as often as they came in; an empty table gives an empty one. Other columns are not read.
    """
    path = vocabulary_path(tokenizer, tokenizer_dir)
    return documents.select(documents[id_col], token_ids(documents[text_col], path).alias("ids"))
