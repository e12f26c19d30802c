"""BPE encoding and decoding with forced boundaries (operator 7).

A byte pair that occurs inside no vocabulary token can never be bridged by a
merge, so it is a certain cut: the fragments between cuts are encoded
independently and concatenated. Fragments repeat far more often than words,
so each distinct one is merged once and remembered.

The tokenizer file (its own parameter, read on the driver and broadcast; its
size is fixed by the vocabulary) is of the word-level kind: normalisation NFC,
runs of white space to one space, lower case; pre-tokens by pattern, white
space dropped; byte-level symbols, the last one of a pre-token marked as a
word end. Special strings in a text become their ids. Decoding joins the
tokens with spaces, as the library does for a file without decoder.

Nulls and empty texts give no ids and an empty decoded text. Texts of any
length are encoded whole. Repeated rows give repeated results; an empty table
gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrolens.llm.common import map_arrow

# White space, letters (in lower and upper case) and numbers up to U+024F.
_SPACES = " \\t\\n\\x0b\\x0c\\r\\x85\\xa0"
_LETTERS = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f"
_NUMBERS = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
LONG = 100                # symbols of a fragment from which merging uses a heap
CACHE_WORDS = 300_000     # distinct pre-tokens remembered per task; older ones are encoded again


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def read_tokenizer(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return {k: spec[k] for k in ("model", "pre_tokenizer", "added_tokens")} | {"unassigned": newly_assigned()}


def newly_assigned() -> str:
    """Character ranges that the pattern library used here takes for letters
    or numbers, but the (older) Unicode tables of the tokenizers library do not."""
    from tokenizers import Regex, pre_tokenizers

    known = regex.compile(r"[\p{L}\p{N}]")
    new = "".join(chr(c) for c in range(0x300, sys.maxunicode + 1)
                  if unicodedata.category(chr(c)) == "Cn" and known.match(chr(c)))
    other = pre_tokenizers.Split(Regex(r"[\p{L}\p{N}]"), "removed").pre_tokenize_str(new)
    odd = sorted(ord(c) for piece, _ in other for c in piece)
    starts = [c for i, c in enumerate(odd) if not i or odd[i - 1] != c - 1]
    ends = [c for i, c in enumerate(odd) if i + 1 == len(odd) or odd[i + 1] != c + 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends))


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level
    vocabulary: visible Latin-1 characters stand for themselves, the other
    bytes take the code points from 256 on, in order."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """Encoder and decoder of one tokenizer file; one per task."""

    def __init__(self, spec: dict):
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab = model["vocab"]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(pattern)
        # Up to U+024F the classes are few ranges, which the plain engine matches much faster.
        self.latin = re.compile(pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{_SPACES}{_LETTERS}{_NUMBERS}]")
                                .replace(r"[\p{L}]", f"[{_LETTERS}]").replace(r"[\p{N}]", f"[{_NUMBERS}]"))
        self.beyond_latin = re.compile("[^\x00-\u024f]")
        odd = f"[{spec['unassigned']}]" if spec["unassigned"] else r"[^\s\S]"
        self.odd = regex.compile(odd)
        strict = (pattern.replace(r"[^\s\p{L}\p{N}]", f"[[^\\s\\p{{L}}\\p{{N}}]||{odd}]")
                  .replace(r"[\p{L}]", f"[\\p{{L}}--{odd}]").replace(r"[\p{N}]", f"[\\p{{N}}--{odd}]"))
        self.strict = regex.compile(strict, regex.V1)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile(
            "(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        to_byte = byte_symbols()
        self.first = [0] * 512                      # id of a symbol: a byte, or 256 + a word-final byte
        for char, b in to_byte.items():
            self.first[b], self.first[256 + b] = vocab[char], vocab[char + end]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.merged = [vocab[a + b] for a, b in pairs]
        self.none = len(pairs)
        self.inside = self.pairs_inside(vocab, end, to_byte)
        self.strings = {i: s.encode() for s, i in (vocab | self.special).items()}
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.fragments: dict[tuple, list[int]] = {}

    @staticmethod
    def pairs_inside(vocab: dict, end: str, to_byte: dict) -> set[tuple[int, int]]:
        """Neighbouring symbols inside any token: bytes 0-255, word-final
        bytes as 256-511. Every other pair is a forced boundary."""
        found = set()
        for token in vocab:
            final = token.endswith(end) and len(token) > len(end)
            body = [to_byte[c] for c in (token[:-len(end)] if final else token) if c in to_byte]
            if final and body:
                body[-1] += 256
            found.update(zip(body, body[1:]))
        return found

    def merge(self, ids: list[int]) -> list[int]:
        """Byte pair merging of one fragment: lowest rank first, from the left."""
        if len(ids) > LONG:
            return self.merge_long(ids)
        rank, none = self.rank.get, self.none
        ranks = [rank(pair, none) for pair in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i:i + 2] = [self.merged[best]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), none)
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), none)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same for a fragment of any length in n log n steps: a linked list
        of symbols and a heap of the pairs by rank, then by place."""
        rank, none, n = self.rank.get, self.none, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r * n + i for i, pair in enumerate(zip(ids, ids[1:])) if (r := rank(pair, none)) != none]
        heapify(heap)
        while heap:
            r, i = divmod(heappop(heap), n)
            j = after[i]
            if ids[i] < 0 or j >= n or rank((ids[i], ids[j]), none) != r:
                continue                                # the pair has changed since
            ids[i], ids[j], after[i] = self.merged[r], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (new := rank((ids[i], ids[after[i]]), none)) != none:
                    heappush(heap, new * n + i)
            if before[i] >= 0 and (new := rank((ids[before[i]], ids[i]), none)) != none:
                heappush(heap, new * n + before[i])
        return [x for x in ids if x >= 0]

    def encode_word(self, word: str) -> bytes:
        """Ids (little-endian unsigned 32-bit) of one pre-token: cut at forced
        boundaries, encode the fragments, concatenate."""
        symbols = list(word.encode("utf-8", "surrogatepass"))
        symbols[-1] += 256
        pairs = list(zip(symbols, symbols[1:]))
        first = self.first
        if self.inside.issuperset(pairs):
            return array("I", self.merge([first[b] for b in symbols])).tobytes()
        cuts = [i for i, pair in enumerate(pairs, 1) if pair not in self.inside]
        out = array("I")
        for start, stop in zip([0, *cuts], [*cuts, len(symbols)]):
            piece = tuple(symbols[start:stop])
            ids = self.fragments.get(piece)
            if ids is None:
                ids = self.merge([first[b] for b in piece])
                if len(piece) <= 32:
                    if len(self.fragments) >= CACHE_WORDS:
                        self.fragments.clear()
                    self.fragments[piece] = ids
            out.extend(ids)
        return out.tobytes()

    def lookup(self, word: str) -> bytes:
        got = self.words.get(word)
        if got is None:
            got = self.old.get(word) or self.encode_word(word)
            if len(word) <= 64:
                if len(self.words) >= CACHE_WORDS // 2:      # two generations: frequent words survive
                    self.old, self.words = self.words, {}
                self.words[word] = got
        return got

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings."""
        if text.isascii():
            text = text.lower()
        else:
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()   # lower case is per character
            if self.beyond_latin.search(text):
                return (self.strict if self.odd.search(text) else self.pattern).findall(text)
        return self.latin.findall(text)

    def parts(self, text: str) -> list[str]:
        """The text cut at special strings; these stand at odd places."""
        return self.special_pattern.split(text) if "<|" in text else [text]

    def plain_pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text, special strings left out."""
        if "<|" not in text:
            return self.split(text)
        return [word for part in self.parts(text)[::2] for word in self.split(part)]

    def count_special(self, text: str) -> int:
        return len(self.parts(text)) // 2

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, packed as little-endian unsigned 32-bit integers."""
        return b"".join(
            np.array([self.special[part]], "<u4").tobytes() if i % 2 else
            b"".join(map(self.lookup, self.split(part)))
            for i, part in enumerate(self.parts(text)))

    def decode(self, ids: np.ndarray) -> bytes:
        return b" ".join(map(self.strings.__getitem__, ids.tolist()))


OUTPUTS = {"n_tokens": "long", "ids": "array<int>", "decoded": "string",
           "ids_sha256": "string", "decoded_sha256": "string"}


def encode_decode(spark: SparkSession, docs: DataFrame, outputs=("n_tokens", "ids", "decoded"),
                  tokenizer: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encode each text and decode its ids again; ``outputs`` names the
    columns to make, ``keep`` the columns of ``docs`` to pass through."""
    spec = spark.sparkContext.broadcast(read_tokenizer(tokenizer or default_tokenizer()))
    cell: list[Codec] = []

    def run(part):
        if not cell:
            cell.append(Codec(spec.value))
        codec = cell[0]
        made: dict[str, list] = {k: [] for k in outputs}
        for text in part.column("text").to_pylist():
            packed = codec.encode(text or "")
            ids = np.frombuffer(packed, "<u4")
            if "n_tokens" in made:
                made["n_tokens"].append(len(ids))
            if "ids" in made:
                made["ids"].append(ids.astype(np.int32))
            if "ids_sha256" in made:
                made["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
            if "decoded" in made or "decoded_sha256" in made:
                decoded = codec.decode(ids)
                if "decoded" in made:
                    made["decoded"].append(decoded.decode())
                if "decoded_sha256" in made:
                    made["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
        return made

    return map_arrow(docs.select(*dict.fromkeys([*keep, "text"])), run,
                     ", ".join(f"{k} {OUTPUTS[k]}" for k in outputs), keep=keep)
