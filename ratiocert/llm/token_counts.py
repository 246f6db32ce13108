"""Token counts by batch encoding: Arrow in, lengths out."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bounded

BATCH_BYTES = 1 << 20
KNOWN_PIECES = 1 << 20

# Where no token spans the cut: a blank or line end after a visible character, since white space only ever leads a
# byte-level pre-token. Special strings hold no white space.
_SAFE = re.compile("(?<=[!-~\u00a1-\u167f\u1681-\u17ff\u2c00-\u2fff\u3001-\ufefe])(?=[ \n])")


def split_safely(text: str) -> list[str]:
    """``text`` in pieces whose tokens together are those of the whole text.

    A stretch without a safe place stays in one piece, however long.
    """
    return _SAFE.split(text)


def byte_batches(pieces: Iterable[str], size: int = BATCH_BYTES) -> Iterator[list[str]]:
    """``pieces`` in batches of about ``size`` bytes, so that one batch costs about what another does."""
    texts, held = [], 0
    for piece in pieces:
        texts.append(piece)
        held += len(piece) + 1
        if held >= size:
            yield texts
            texts, held = [], 0
    if texts:
        yield texts


class _Lengths(dict):
    """Token counts of pieces; at most ``KNOWN_PIECES`` short ones are kept between batches."""

    def __init__(self, encode, batch_bytes: int):
        super().__init__()
        self.encode, self.batch_bytes = encode, batch_bytes

    def learn(self, pieces: Iterable[str]) -> None:
        if len(self) > KNOWN_PIECES:
            self.clear()
        for some in byte_batches(set(pieces).difference(self), self.batch_bytes):
            self.update(zip(some, self.encode(some), strict=True))


def _encoder(vocabulary: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    if not os.path.isabs(vocabulary):
        import public_tokenizers

        vocabulary = public_tokenizers.path(vocabulary)
    if vocabulary.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        return (lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]), False
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(vocabulary)
    model.no_truncation()
    model.no_padding()
    kind = (model.pre_tokenizer.__class__.__name__ if model.pre_tokenizer else "", model.normalizer is None)
    return (lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]), kind == ("ByteLevel", True)


@functools.cache
def _known(vocabulary: str, batch_bytes: int) -> tuple[_Lengths, bool]:
    """Kept by the Python worker from task to task."""
    encode, may_cut = _encoder(vocabulary)
    return _Lengths(encode, batch_bytes), may_cut


def _held(texts: pa.Array, split, size: int) -> Iterator[tuple[list[int], list[list[str]]]]:
    """Rows and their pieces, about 4 ``size`` characters of text at a time."""
    rows, parts, held = [], [], 0
    for row, text in enumerate(texts):
        if text := text.as_py():
            rows.append(row)
            parts.append(split(text))
            held += len(text)
            if held >= 4 * size:
                yield rows, parts
                rows, parts, held = [], [], 0
    if rows:
        yield rows, parts


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512,
                 batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text.

    ``vocabulary`` is an absolute path or a file name known to ``public_tokenizers`` on the executors. No begin, end or
    other special tokens are added, nothing is cut or padded; special strings inside a text count as the library's
    default has it. Only lengths leave the encoder. Texts are cut where byte-level pre-tokens can't span the cut and the
    distinct pieces of a batch of rows are encoded, in batches of equal bytes; other kinds of vocabulary get whole texts.

    Null and empty texts have 0 bytes and tokens. Repeated rows are counted each. Columns other than the id are not
    kept, so that none can clash; an empty table gives an empty result.
    """
    bounded(docs.sparkSession)
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, may_cut = _known(vocabulary, batch_bytes)
        for batch in batches:
            texts = batch.column("__text")
            total = np.zeros(batch.num_rows, np.int64)
            for rows, parts in _held(texts, split_safely if may_cut else lambda text: [text], batch_bytes):
                known.learn(piece for part in parts for piece in part)
                for row, part in zip(rows, parts, strict=True):
                    total[row] = sum(map(known.__getitem__, part))
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), n_bytes, pa.array(total), pa.array(total > limit)],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    narrow = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    kind = narrow.schema["__id"].dataType.simpleString()
    return narrow.mapInArrow(count, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
