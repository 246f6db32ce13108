"""SentencePiece BPE: ids of whole texts by a table of prefixes, and texts of ids.

A row of pieces is what merging gives for a text if and only if each piece merges from its own characters and every two
neighbours are compatible: merging the two together leaves them apart. So each prefix of a text has one last piece: that which
ends there, and is compatible with the last piece of the prefix before it. An automaton finds all pieces in the text; the last
pieces are filled in from left to right, and the ids are read off backwards.

Whether two pieces are compatible is seen from their edges. As the characters of a piece merge, its outermost symbol grows in
steps, and each step waits for merges of some lowest score. The two sides run down their steps in the order of these scores;
the pieces are apart if no pair of edge symbols can merge before one of them has grown.
"""

from __future__ import annotations

import functools
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bounded

SPACE = "▁"
KNOWN_UNITS = 1 << 18  # units and pairs that a worker remembers; they are found anew beyond
LONG_UNIT = 256  # longer units are not remembered
WINDOW = 1 << 20  # characters of a text that are cut at a time
_NORMAL, _UNKNOWN, _BYTE = 1, 2, 6
_INF = float("inf")


class Pieces:
    """A vocabulary file of the BPE kind with byte fallback and without a normalising table."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, kind = model.normalizer_spec, model.trainer_spec
        plain = not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and norm.escape_whitespaces and norm.add_dummy_prefix
        types = {p.type for p in model.pieces}
        if kind.model_type != 2 or not kind.byte_fallback or kind.treat_whitespace_as_suffix or not plain or types - {1, 2, 3, 6}:
            raise ValueError(f"{path}: only BPE with byte fallback, a leading blank and unchanged text")
        self.surface: list[bytes | int | None] = []  # text of an id; a number for a byte; None for control ids
        self.byte_id, self.id, self.score = {}, {}, {}
        for i, p in enumerate(model.pieces):
            if p.type == _BYTE:
                self.byte_id[int(p.piece[1:-1], 16)] = i
                self.surface.append(int(p.piece[1:-1], 16))
            elif p.type == _NORMAL:
                self.id[p.piece], self.score[i] = i, p.score
                self.surface.append(p.piece.replace(SPACE, " ").encode())
            else:
                self.surface.append(kind.unk_surface.encode() if p.type == _UNKNOWN else None)
        # A control id ends a run of bytes; here it is a byte that is never UTF-8.
        self.raw = [bytes([s]) if isinstance(s, int) else b"\xff" if s is None else s for s in self.surface]
        self.chars = frozenset(p for p in self.id if len(p) == 1)
        symbol = dict(self.id)
        for c in sorted(set("".join(self.id)) - self.chars):
            symbol[c] = len(model.pieces) + len(symbol)
        self.merge = {}
        for p, i in self.id.items():
            for cut in range(1, len(p)):
                if p[:cut] in symbol and p[cut:] in symbol:
                    self.merge[symbol[p[:cut]], symbol[p[cut:]]] = i
        self.left, self.right, self.size = {}, {}, {}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            left, right, whole = self._edges([symbol[c] for c in p])
            if whole:
                self.left[i], self.right[i], self.size[i] = left, right, len(p)
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        # Two characters that no piece holds next to each other are never in one piece: texts fall apart into units there.
        number = {c: i for i, c in enumerate(sorted(set("".join(self.id))), 1)}
        self.sort_of = np.zeros(0x110000, np.uint16)  # 0: a character that no piece holds
        self.sort_of[[ord(c) for c in number]] = list(number.values())
        self.beside = np.zeros((len(number) + 1, len(number) + 1), bool)
        for p in self.id:
            for x, y in zip(p, p[1:]):
                self.beside[number[x], number[y]] = True
        self.known: dict[str, list[int]] = {}
        self.apart: dict[tuple[int, int], bool] = {}

    def _edges(self, symbols: list[int]) -> tuple[list, list, bool]:
        """Steps (symbol, lowest score that its growth waits for) of the first and the last symbol, and whether one symbol remains."""
        left, right = [[symbols[0], _INF]], [[symbols[-1], _INF]]
        while True:
            found = [(-self.score[m], i, m) for i, pair in enumerate(zip(symbols, symbols[1:])) if (m := self.merge.get(pair)) is not None]
            if not found:
                left[-1][1] = right[-1][1] = -_INF
                return left, right, len(symbols) == 1
            cost, i, m = min(found)  # the best score, the leftmost of equal ones
            symbols[i:i + 2] = [m]
            left[-1][1], right[-1][1] = min(left[-1][1], -cost), min(right[-1][1], -cost)
            if i == 0:
                left.append([m, _INF])
            if i == len(symbols) - 1:
                right.append([m, _INF])

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the characters of both pieces leaves the two pieces."""
        ends, begins = self.right[a], self.left[b]
        i = j = 0
        while True:
            (x, wait_x), (y, wait_y) = ends[i], begins[j]
            m = self.merge.get((x, y))
            # Of equal scores the leftmost pair merges: the left piece's own before the pair across, that before the right one's.
            if m is not None and self.score[m] > wait_x and self.score[m] >= wait_y:
                return False
            if i == len(ends) - 1 and j == len(begins) - 1:
                return True
            if wait_x >= wait_y:
                i += 1
            else:
                j += 1

    def _run(self, run: str) -> list[int]:
        """Ids of a run of known characters."""
        apart = self.apart
        if len(apart) > 4 * KNOWN_UNITS:
            apart.clear()
        last = [-1] * (len(run) + 1)
        for at, (piece, size) in self.automaton.iter(run):
            end = at + 1
            if last[end] >= 0:
                continue
            if size == end:
                last[end] = piece
                continue
            pair = (last[end - size], piece)
            fits = apart.get(pair)
            if fits is None:
                fits = apart[pair] = self.compatible(*pair)
            if fits:
                last[end] = piece
        ids, at = [], len(run)
        while at:
            ids.append(last[at])
            at -= self.size[last[at]]
        ids.reverse()
        return ids

    def _unit(self, unit: str) -> list[int]:
        """Ids of a run whose neighbours all stand next to each other in some piece, or of a character that no piece holds."""
        return self._run(unit) if len(unit) > 1 or unit in self.chars else [self.byte_id[b] for b in unit.encode()]

    def ends(self, text: str) -> Iterator[int]:
        """Where the units of ``text`` end."""
        before = 0
        for at in range(0, len(text), WINDOW):
            sorts = self.sort_of[np.frombuffer(text[at:at + WINDOW].encode("utf-32-le"), np.uint32)]
            apart = ~self.beside[np.concatenate([[before], sorts[:-1]]), sorts]
            before = sorts[-1]
            yield from (np.flatnonzero(apart) + at).tolist()
        yield len(text)

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        ids: list[int] = []
        known = self.known
        text = SPACE + text.replace(" ", SPACE)
        begin = 0
        for end in self.ends(text):
            unit = text[begin:end]
            begin = end
            found = known.get(unit)
            if found is None:
                if not unit:
                    continue
                found = self._unit(unit)
                if len(unit) <= LONG_UNIT:
                    if len(known) >= KNOWN_UNITS:
                        known.clear()
                    known[unit] = found
            ids.extend(found)
        return ids

    def decode(self, ids: list[int]) -> str:
        """Text of the ids: bytes that are no UTF-8 become U+FFFD each, and one blank at the begin of the text goes."""
        surface = self.surface
        if ids and ids[0] in self.score:
            try:  # where all is UTF-8, so is each run of bytes
                text = b"".join(map(self.raw.__getitem__, ids)).decode()
                return text[1:] if text[:1] == " " else text
            except UnicodeDecodeError:
                pass
        out: list[bytes] = []
        raw = bytearray()
        begin = True
        for i in ids:
            s = surface[i]
            if s.__class__ is int:
                raw.append(s)
                continue
            if raw:
                out.append(_text_of(bytes(raw)))
                raw.clear()
                begin = False
            if s is None:
                continue
            if begin:
                cut = i in self.score and s[:1] == b" "
                out.append(s[1:] if cut else s)
                begin = not (cut or s)
            else:
                out.append(s)
        if raw:
            out.append(_text_of(bytes(raw)))
        return b"".join(out).decode()


def _text_of(raw: bytes) -> bytes:
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at:at + size].decode())
                break
            except UnicodeDecodeError:
                size = 0
        if not size:
            out.append("�")
        at += size or 1
    return "".join(out).encode()


@functools.cache
def _pieces(vocabulary: str) -> Pieces:
    """Kept by the Python worker from task to task."""
    if not os.path.isabs(vocabulary):
        import public_tokenizers

        vocabulary = public_tokenizers.path(vocabulary)
    return Pieces(vocabulary)


def encode_pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the ids of every whole text, without begin or end.

    ``vocabulary`` is an absolute path or a file name known to ``public_tokenizers`` on the executors. Null and empty texts
    have no ids. Repeated rows are encoded each. Columns other than the id are not kept, so that none can clash; an empty
    table gives an empty result. One pass without a shuffle; a unit between blanks is encoded in time linear in its length.
    """
    bounded(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(vocabulary)
        for batch in batches:
            flat, at = array("i"), [0]
            for text in batch.column("__text"):
                flat.extend(pieces.encode(text.as_py() or ""))
                at.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.frombuffer(flat, np.int32)) if flat else pa.array([], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("__id"), ids], names=[id_col, "ids"])

    narrow = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    return narrow.mapInArrow(encode, f"`{id_col}` {narrow.schema['__id'].dataType.simpleString()}, ids array<int>")


def decode_pieces(rows: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, text): the text of every list of ids.

    Null lists, null ids and ids outside the vocabulary give a null text, empty lists an empty one. Other columns are not kept, so
    that none can clash; an empty table gives an empty result.
    """
    bounded(rows.sparkSession)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(vocabulary)
        most = len(pieces.surface)
        for batch in batches:
            texts = []
            for ids in batch.column("__ids"):
                values = ids.values if ids.is_valid else None
                if values is None or values.null_count:
                    texts.append(None)
                    continue
                held = values.to_numpy()
                texts.append(pieces.decode(held.tolist()) if not len(held) or 0 <= held.min() and held.max() < most else None)
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__ids"), pa.array(texts, pa.string())], names=[id_col, "ids", "text"])

    narrow = rows.select(F.col(id_col).alias("__id"), F.col(ids_col).cast("array<int>").alias("__ids"))
    kind = narrow.schema["__id"].dataType.simpleString()
    return narrow.mapInArrow(decode, f"`{id_col}` {kind}, ids array<int>, text string")
