import pytest

from unievents.llm import token_counts as T

from .conftest import odd_rows


def _whole(name):
    import public_tokenizers
    if name.endswith(".model"):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        return lambda t: len(model.encode(t or ""))
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda t: len(model.encode(t or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_odd_rows_as_the_library_counts(odd, name):
    """Parts of 2,000 characters, so that many texts are cut."""
    count = _whole(name)
    got = sorted(map(str, T.count_tokens(odd, vocabulary=name, part_chars=2000, batch_bytes=50_000).collect()))
    known = {t: count(t) for _, t in odd_rows()}
    from pyspark.sql import Row
    want = [Row(id=i, n_bytes=len((t or "").encode()), n_tokens=known[t], over_limit=known[t] > 4096) for i, t in odd_rows()]
    assert got == sorted(map(str, want))


def test_parts_are_cut_at_safe_boundaries():
    count = _whole("piece_bpe_32k.model")
    text = "a b  c ▁ d<s> e\n f. G 1 2  end " * 50
    for size in (1, 7, 50, 333):
        parts = T.split_safely(text, T._PIECE_CUT, size)
        assert sum(map(count, parts)) == count(text) and " ".join(parts) == text


def test_unknown_kind():
    with pytest.raises(ValueError):
        T._counter("vocabulary.txt")


def test_empty(no_docs):
    assert T.count_tokens(no_docs).count() == 0
