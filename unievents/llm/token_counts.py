"""Token counts of whole texts by the libraries of public tokenizer files."""

from __future__ import annotations

import functools
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unievents.llm.common import pick, rows_of

# Between these, a text falls apart into pieces that no token crosses. The piece model
# writes each space as the start of the next word, and a text starts like a word, so the
# space itself is left out; the byte-level patterns put a space in front of its word.
_PIECE_CUT = re.compile(r"(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")
_BYTE_CUT = re.compile(r"(?<=[0-9A-Za-z])(?= [0-9A-Za-z])")


def vocabulary_path(name: str) -> str:
    """A file by absolute path, or by its name among the installed public vocabularies
    (looked up where this runs: on the executors)."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def _counter(name: str):
    """(function of a list of texts to their lengths in tokens, pattern of safe cuts)."""
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(name))
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)], _PIECE_CUT
    if name.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(vocabulary_path(name))
        model.no_truncation()
        model.no_padding()
        # other kinds of vocabularies may join words across spaces, so their texts stay whole
        cut = _BYTE_CUT if '"ByteLevel"' in model.pre_tokenizer.__getstate__().decode() else None
        return lambda texts: [len(e.ids) for e in model.encode_batch(texts, add_special_tokens=False)], cut
    raise ValueError(f"neither a .model nor a .json file: {name}")


def split_safely(text: str, cut: re.Pattern | None, size: int) -> list[str]:
    """The text in parts of about ``size`` characters, cut at the first safe boundary after
    each; without one the rest stays whole."""
    parts, at = [], 0
    while cut is not None and len(text) - at > size:
        found = cut.search(text, at + size)
        if found is None:
            break
        parts.append(text[at:found.start()])
        at = found.end()
    parts.append(text[at:])
    return parts


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 vocabulary: str = "piece_bpe_32k.model", limit: int = 4096, part_chars: int = 1 << 16,
                 batch_bytes: int = 1 << 20) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row, without added special tokens.

    Texts longer than ``part_chars`` are cut at safe boundaries, and parts are encoded in
    batches of about ``batch_bytes``, so that neither one long text nor many short ones
    fill the memory. Special strings inside a text are handled as the library's default
    does. Null and empty texts have no tokens; every row, repeated or not, has its own
    result; no rows give no rows.
    """
    plain = pick(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))

    def run(batches):
        encode, cut = _counter(vocabulary)
        for batch in rows_of(batches, batch_bytes):
            texts = batch.column(1).to_pylist()
            totals, owners, parts, size = [0] * len(texts), [], [], 0

            def flush():
                for owner, n in zip(owners, encode(parts)):
                    totals[owner] += n
                owners.clear()
                parts.clear()

            for row, text in enumerate(texts):
                for part in split_safely(text, cut, part_chars):
                    owners.append(row)
                    parts.append(part)
                    size += len(part)
                    if size > batch_bytes:
                        flush()
                        size = 0
            if parts:
                flush()
            yield pa.record_batch([batch.column(0), pa.array(totals, pa.int64()), batch.column(2)],
                                  names=["id", "n_tokens", "n_bytes"])

    kind = plain.schema["id"].dataType.simpleString()
    sized = plain.withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    counted = sized.mapInArrow(run, f"id {kind}, n_tokens bigint, n_bytes bigint")
    return counted.select("id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
