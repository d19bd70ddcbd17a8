from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from newsgrid.llm import tokens
from tests.conftest import SMALL


def reference(vocabulary, fallback=False):
    pieces = [(f"<0x{b:02X}>", 0.0) for b in range(256)] if fallback else []
    t = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces, *vocabulary], 0, fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


def words_of(text):
    return " ".join(w for w in (text or "").translate(tokens._GAPS).split(" ") if w)


def test_against_tokenizer(spark, odd, none):
    import public_tokenizers

    # the file has byte pieces, so its unknown characters are bytes, as op5_token_count counts them
    t = reference(tokens.vocabulary(public_tokenizers.path("piece_bpe_32k.model")), fallback=True)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    want = sorted((str(r.doc_id), len(t.encode(words_of(r.text)).ids)) for r in docs.collect())
    assert sorted((str(r.doc_id), r.n_tokens) for r in tokens.op5_token_count(docs).collect()) == want
    assert tokens.op5_token_count(none).count() == 0


#: Equal scores make ties; the letters c and é have no piece of their own.
TIES = [("▁", -1.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("ba", -4.0), ("aba", -4.0), ("bab", -6.0), ("▁a", -3.0), ("▁ab", -5.0), ("cab", -9.0)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcé ", max_size=24))
def test_ties_and_unknowns(text):
    assert tokens.Counter(TIES).text(text) == len(reference(TIES).encode(words_of(text)).ids)


def test_byte_fallback(spark):
    """Characters without a piece count as their UTF-8 bytes, as in the library's model with byte fallback."""
    import public_tokenizers

    known = tokens.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    t = reference(known, fallback=True)
    texts = ["".join(chr(0x1200 + i % 80) + " " * (i % 5 == 4) for i in range(300)), "plain words", "a🧿b🧿🧿 ሀለ x", "", "ሀ"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.op5_token_count(docs).collect()}
    assert got == {i: len(t.encode(words_of(x)).ids) for i, x in enumerate(texts)} and got[4] == 4
