import hashlib
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from metrolens.llm import bpe, token_counts
from tests.llm.helpers import docs_df

TEXTS = [None, "", " \n", "Hello, WORLD! it's 2024's", "a<|endoftext|>b<|startoftext|> <|x|>", "<|endoftext|>",
         "ΣΑΣ σας İstanbul ß ẞ ﬁ", "é café Å", "a\x85b c​d\xa0g\x1c", "😀😃 中文字 ٣ ½ Ⅷ", "x" * 3000,
         "ab" * 2000, "!!!???...###", "\x00\x01", "ſ K ŉ", "The quick brown fox " * 50]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(bpe.default_tokenizer())


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_tokenizer(bpe.default_tokenizer()))


def test_codec_equals_library(library, codec):
    rng = random.Random(1)
    pool = [chr(c) for a, b in ((0, 0x250), (0x300, 0x500), (0x1E00, 0x2100), (0x3000, 0x3100)) for c in range(a, b)]
    odd = ["".join(rng.choices(pool, k=rng.randint(1, 30))) for _ in range(3000)]
    plain = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzqzxj' .,éß", k=60)) for _ in range(1000)]
    for text in [t or "" for t in TEXTS] + odd + plain:
        ids = library.encode(text, add_special_tokens=False).ids
        packed = codec.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == ids
        assert codec.decode(np.frombuffer(packed, "<u4")).decode() == library.decode(ids, skip_special_tokens=False)


def test_forced_boundaries_exist_and_are_certain(codec):
    cut = [p for p in ((ord("q"), ord("z")), (ord("x"), ord("j"))) if p not in codec.inside]
    assert cut
    for a, b in cut:
        ids = np.frombuffer(codec.encode_word("ab" + chr(a) + chr(b) + "cd"), "<u4").tolist()
        at, ends = 0, set()
        for i in ids:
            at += len(codec.strings[i].removesuffix(b"</w>").decode())
            ends.add(at)
        assert 3 in ends


def test_long_fragments_equal_library_in_seconds(library, codec, monkeypatch):
    import time
    rng = random.Random(2)
    texts = ["".join(rng.choices(letters, k=n)) for letters in ("a", "ab", "acgt", "theradinosy", "-", "=-#") for n in (99, 101, 5000)]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == ids
        monkeypatch.setattr(bpe, "LONG", 1)                      # the heap on short fragments too
        assert np.frombuffer(codec.encode_word(text), "<u4").tolist() == ids if text.isalpha() else True
        monkeypatch.undo()
    start = time.time()
    million = "a" * 1_000_000
    packed = codec.encode(million)
    assert time.time() - start < 60
    assert np.frombuffer(packed, "<u4").tolist() == library.encode(million, add_special_tokens=False).ids


def test_small_cache_gives_the_same_ids(codec, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 4)
    small = bpe.Codec(bpe.read_tokenizer(bpe.default_tokenizer()))
    text = " ".join(f"word{i % 50}qzqz{i % 7}" for i in range(500))
    assert small.encode(text) == codec.encode(text)


def test_encode_decode(spark, library):
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, "null id")]
    got = bpe.encode_decode(spark, docs_df(spark, rows), outputs=tuple(bpe.OUTPUTS)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "null id" if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r["ids"], r["n_tokens"], r["decoded"]) == (ids, len(ids), decoded)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


@pytest.mark.parametrize("hot", [0, 3, 100_000])
def test_token_counts(spark, library, hot):
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3])] * 2 + [(3, "other text of the id")] + [(None, "null id"), (None, "null id")]
    got = token_counts.token_counts(spark, docs_df(spark, rows), hot_words=hot).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_empty(spark):
    none = docs_df(spark, [(1, "a")]).limit(0)
    assert bpe.encode_decode(spark, none).count() == 0
    assert token_counts.token_counts(spark, none).count() == 0
    assert none.where(F.lit(True)).count() == 0
