import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallygrid.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    return bpe.Encoder(bpe.read_vocabulary(PATH)), Tokenizer.from_file(PATH)


TEXT = st.one_of(
    st.text(st.characters(exclude_categories=["Cs"]), max_size=60),
    st.text("abcdefgh the ing'stre0123!?éßΣσİ中́\x1c\x85🙂", max_size=80),
    st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "a", " The", "'re", "don't", "\n"]), max_size=12).map("".join),
)


@settings(max_examples=500, deadline=None)
@given(text=TEXT)
def test_same_ids_and_text_as_the_library(both, text):
    mine, library = both
    want = library.encode(text, add_special_tokens=False).ids
    assert mine.encode(text) == want
    assert mine.decode(want) == library.decode(want, skip_special_tokens=False)


def test_every_code_point(both):
    """Within letters, before a sign and twice: letters, numbers, signs, spaces and small forms of all of Unicode."""
    mine, library = both
    for form in ("a{0}b", "{0}!{0}{0}"):
        texts = [form.format(chr(c)) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
        for at in range(0, len(texts), 50_000):
            part = texts[at : at + 50_000]
            found = library.encode_batch(part, add_special_tokens=False)
            assert [t for t, one in zip(part, found) if mine.encode(t) != one.ids] == []


def test_two_generations_forget_and_bring_back():
    asked = []
    known = bpe._Remembered(lambda k: asked.append(k) or str(k), 4)
    for k in (1, 2, 3, 1, 4, 1, 5, 1, 2):
        assert known[k] == str(k)
    assert asked == [1, 2, 3, 4, 5, 2] and len(known) <= 2 and len(known.older) <= 2


def test_long_piece_without_space(both):
    mine, library = both
    text = "abcab" * 3000
    assert mine.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_unknown_ids_decode_to_nothing(both):
    mine, _ = both
    assert mine.decode([-5, 10**6]) == "" and mine.decode([]) == ""


def test_query_on_edge_rows(edge_docs, edge_rows, no_docs, clashing_docs, both):
    _, library = both
    rows = bpe.token_digests(edge_docs, PATH).collect()
    assert len(rows) == len(edge_rows)
    texts = dict((i, t or "") for i, t, *_ in edge_rows)
    for row in rows:
        ids = library.encode(texts[row.doc_id], add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert row.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.token_digests(no_docs, PATH).count() == 0
    assert bpe.encode_texts(clashing_docs, PATH).columns == clashing_docs.columns
