import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from provenir.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.load_ranks(PATH)
TRUE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = bpe.Encoder(RANKS, public_tokenizers.PATTERN)


def ids(packed):
    return [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)]


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("abehnost ", max_size=300), st.text(" \n\t'sx1", max_size=60)))
def test_as_the_library_does(text):
    assert ids(ENCODER.encode(text)) == TRUE.encode_ordinary(text)


def test_long_pieces():
    for text in ("a" * 20_000, "ab" * 5_000, "thisisonelongwordwithoutspaces" * 300, "=" * 3000, "é漢😀" * 500, "<|endoftext|>"):
        assert ids(ENCODER.encode(text)) == TRUE.encode_ordinary(text)
    assert not ENCODER.buckets and not any(ENCODER.low) and not any(ENCODER.mid)


def test_cache_forgets_and_encodes_again(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 3)
    small = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    text = " some words come again and some words do not: some words, again and again"
    assert [ids(small.encode(text)) for _ in range(3)] == [TRUE.encode_ordinary(text)] * 3 and len(small.cache) <= 3


def test_nasty(spark, nasty, empty):
    coder = bpe.ByteBpe(spark, PATH, public_tokenizers.PATTERN)
    got = nasty.select("text", coder.encode(F.col("text")).alias("ids")).select("text", "ids", coder.decode(F.col("ids")).alias("back"), bpe.unpack(F.col("ids")).alias("list"), bpe.n_tokens(F.col("ids")).alias("n")).collect()
    for r in got:
        assert r.list == TRUE.encode_ordinary(r.text or "") and r.n == len(r.list) and bytes(r.back).decode() == (r.text or "")
    assert empty.select(coder.decode(coder.encode(F.col("text")))).count() == 0
