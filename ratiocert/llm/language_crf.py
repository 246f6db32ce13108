"""Language of every word by a linear-chain conditional random field, and of a text by its words.

A word's features are hashed: its fingerprint (lexicon), its first and last one to three bytes (affixes) and its byte
pairs and triples (n-grams). Transitions between the languages of neighbouring words are learned from spliced texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import SMALL_BATCH, bounded, bounded_sample
from .tokens import chunked, mixed, powers

BITS = 17
SAMPLE_DOCS = 2500  # at most so many labelled rows train the model
UNDETERMINED = "und"
_U = np.uint64
_SPAN = 64  # words per block of the forward-backward scan
_GAP = b"   "  # after each text, so that no feature reaches into the next one


def lowered(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace")


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


class WordFeatures:
    """Letter runs of some lower-cased texts and the feature numbers of each."""

    def __init__(self, texts: list[bytes]):
        joined = np.frombuffer(_GAP.join([*texts, b""]), np.uint8)
        letter = ((joined >= 97) & (joined <= 122)) | (joined >= 128)
        edge = np.diff(letter.astype(np.int8), prepend=0)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        begins = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + len(_GAP) for t in texts], out=begins[1:])
        self.first = np.searchsorted(self.start, begins)
        self.bytes = joined.astype(_U)

    def _slot(self, value: np.ndarray, kind: int) -> np.ndarray:
        return (mixed(value * _U(64) + _U(kind)) >> _U(64 - BITS)).astype(np.int64)

    def of_words(self) -> list[np.ndarray]:
        """Lexicon and affix features, one number a word each."""
        b, s, e = self.bytes, self.start, self.end
        forward, back = powers(len(b) + 1)
        total = np.zeros(len(b) + 1, _U)
        np.cumsum(b * forward[:-1], dtype=_U, out=total[1:])
        out = [self._slot(mixed((total[e] - total[s]) * back[s]), 0)]
        head = np.zeros(len(s), _U)
        tail = np.zeros(len(s), _U)
        for n in range(1, 4):
            inside = s + n <= e
            head = head * _U(257) + np.where(inside, b[np.minimum(s + n - 1, len(b) - 1)], _U(0))
            tail = tail * _U(257) + np.where(inside, b[np.maximum(e - n, 0)], _U(0))
            out += [self._slot(head, n), self._slot(tail, n + 3)]
        return out

    def of_places(self) -> list[np.ndarray]:
        """Byte pairs and triples that start at each place, word ends included."""
        b = self.bytes
        pair = b[:-2] * _U(257) + b[1:-1]
        return [self._slot(pair, 7), self._slot(pair * _U(257) + b[2:], 8)]


@dataclass
class ChainModel:
    labels: list[str]
    weight: np.ndarray  # feature numbers x labels
    step: np.ndarray  # transition scores, from x to
    begin: np.ndarray

    def scores(self, features: WordFeatures) -> np.ndarray:
        """Emission scores, words x labels."""
        out = np.zeros((len(features.start), len(self.labels)), np.float32)
        if not len(out):
            return out
        for slot in features.of_words():
            out += self.weight[slot]
        places = np.stack([features.start, features.end], 1).ravel()
        for slot in features.of_places():
            out += np.add.reduceat(self.weight[slot], places, axis=0, dtype=np.float64)[::2]
        return out


def posteriors(model: ChainModel, emission: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Forward-backward over texts of any length at once: P(label of word | text), words x labels.

    Texts are cut into blocks; the product of a block's transitions carries what comes before and after past it, so that
    steps within blocks run side by side for all blocks, and only block products are chained along a text.
    """
    n_labels = len(model.labels)
    n_words = np.diff(first)
    n_blocks = -(-n_words // _SPAN)
    total = int(n_blocks.sum())
    if not total:
        return np.zeros((0, n_labels))
    block_first = np.concatenate([[0], np.cumsum(n_blocks)])
    text_of = np.repeat(np.arange(len(n_words)), n_blocks)
    nth = np.arange(total) - block_first[text_of]
    begin = first[text_of] + nth * _SPAN
    length = np.minimum(_SPAN, first[text_of + 1] - begin)
    place = begin[:, None] + np.arange(_SPAN)
    used = np.arange(_SPAN) < length[:, None]
    e = np.exp(emission - emission.max(1, keepdims=True)).astype(np.float64)
    e = np.where(used[..., None], e[np.minimum(place, len(e) - 1)], 1.0)
    step = np.exp(model.step - model.step.max())

    product = np.broadcast_to(np.eye(n_labels), (total, n_labels, n_labels)).copy()
    for t in range(_SPAN):
        on = used[:, t]
        moved = (product[on] @ step) * e[on, t][:, None, :]
        product[on] = moved / moved.sum((1, 2), keepdims=True)
    before = np.empty((total, n_labels))
    after = np.ones((total, n_labels))
    start = np.exp(model.begin - model.begin.max())
    for k in range(int(n_blocks.max())):
        here = block_first[:-1][n_blocks > k] + k
        if k == 0:
            before[here] = start / start.sum()
        else:
            v = np.einsum("bi,bij->bj", before[here - 1], product[here - 1])
            before[here] = v / v.sum(1, keepdims=True)
    for k in range(int(n_blocks.max()) - 2, -1, -1):
        here = block_first[:-1][n_blocks > k + 1] + k
        v = np.einsum("bij,bj->bi", product[here + 1], after[here + 1])
        after[here] = v / v.sum(1, keepdims=True)
    forward = np.empty((_SPAN, total, n_labels))
    v = before
    for t in range(_SPAN):
        moved = (v @ step) * e[:, t]
        v = np.where(used[:, t, None], moved / moved.sum(1, keepdims=True), v)
        forward[t] = v
    v = after
    for t in range(_SPAN - 1, -1, -1):
        forward[t] *= v
        moved = (e[:, t] * v) @ step.T
        v = np.where(used[:, t, None], moved / moved.sum(1, keepdims=True), v)
    p = forward.transpose(1, 0, 2)[used]
    return p / p.sum(1, keepdims=True)


def fit_chain(texts: list[str], langs: list[str], seed: int = 5, span: int = 32, batch: int = 64, rate: float = 0.3,
              max_words: int = 300_000) -> ChainModel:
    """Adaptive gradient steps on the conditional likelihood of word labels in spliced sequences.

    Each sequence has ``span`` words; half of them are spliced from two texts at a random place, so that changes of
    language are seen and their scores learned. At most ``max_words`` words are used, taken over all texts by lot.
    """
    labels = sorted(set(langs))
    rng = np.random.default_rng(seed)
    slots, gold = [np.zeros((0, 7 + 2 * 8), np.int32)], [np.zeros(0, np.int64)]
    share = min(1.0, max_words / max(1, sum(map(len, texts)) / 5))
    for first, some in chunked((lowered(t) for t in texts), 1 << 18):
        feats = WordFeatures(some)
        owner = np.repeat(np.arange(len(some)), np.diff(feats.first))
        spans = np.arange(max(1, len(owner) // span) if len(owner) >= span else 0)
        spans = spans[rng.random(len(spans)) < share]
        chosen = (spans[:, None] * span + np.arange(span)).ravel()
        table = np.full((len(chosen), 7 + 2 * 8), -1, np.int32)
        for j, slot in enumerate(feats.of_words()):
            table[:, j] = slot[chosen]
        for j, slot in enumerate(feats.of_places()):
            for k in range(8):
                spot = feats.start[chosen] + k
                ok = spot < feats.end[chosen]
                table[ok, 7 + 8 * j + k] = slot[np.minimum(spot[ok], len(slot) - 1)]
        slots.append(table)
        gold.append(np.array([labels.index(langs[first + i]) for i in range(len(some))], np.int64)[owner[chosen]])
    table, gold = np.concatenate(slots), np.concatenate(gold)
    n_seq = len(table) // span
    model = ChainModel(labels, np.zeros((1 << BITS, len(labels)), np.float32), np.zeros((len(labels),) * 2), np.zeros(len(labels)))
    if not n_seq:
        return model
    rows = rng.permutation(n_seq)[:max(1, max_words // span)][:, None] * span + np.arange(span)
    other = rng.permutation(len(rows))
    cut = rng.integers(1, span, len(rows))
    spliced = rng.random(len(rows)) < 0.5
    rows = np.where(spliced[:, None] & (np.arange(span) >= cut[:, None]), rows[other], rows)
    seen_w, seen_a, seen_b = np.full(model.weight.shape, 1e-6, np.float32), np.full(model.step.shape, 1e-6), np.full(model.begin.shape, 1e-6)
    for lo in range(0, len(rows), batch):
        some = rows[lo:lo + batch]
        n, x, y = len(some), table[some], gold[some]
        weighted = np.where((x >= 0)[..., None], model.weight[x], 0).sum(2, dtype=np.float64)
        e = np.exp(weighted - weighted.max(2, keepdims=True))
        a = np.exp(model.step)
        alpha, beta = np.empty_like(e), np.ones_like(e)
        b0 = np.exp(model.begin - model.begin.max())
        v = np.broadcast_to(b0 / b0.sum(), (n, len(labels)))
        for t in range(span):
            v = (v @ a) * e[:, t]
            v = v / v.sum(1, keepdims=True)
            alpha[:, t] = v
        v = np.ones((n, len(labels)))
        for t in range(span - 1, 0, -1):
            v = (e[:, t] * v) @ a.T
            v = v / v.sum(1, keepdims=True)
            beta[:, t - 1] = v
        gamma = alpha * beta
        gamma /= gamma.sum(2, keepdims=True)
        hot = np.eye(len(labels))[y]
        pairs = alpha[:, :-1, :, None] * a * (e * beta)[:, 1:, None, :]
        pairs /= pairs.sum((2, 3), keepdims=True)
        g_step = np.einsum("nti,ntj->ij", hot[:, :-1], hot[:, 1:]) - pairs.sum((0, 1))
        enter = (b0 / b0.sum())[:, None] * a * (e[:, 0] * beta[:, 0])[:, None, :]
        enter /= enter.sum((1, 2), keepdims=True)
        g_begin = enter.sum((0, 2)) - n * b0 / b0.sum()
        flat = x.reshape(-1)
        keep = flat >= 0
        spot, inverse = np.unique(flat[keep], return_inverse=True)
        err = np.repeat((hot - gamma).reshape(-1, len(labels)), x.shape[2], 0)[keep]
        g_w = np.stack([np.bincount(inverse, err[:, j], len(spot)) for j in range(len(labels))], 1).astype(np.float32)
        for grad, total, value, where in ((g_w, seen_w, model.weight, spot), (g_step, seen_a, model.step, ...), (g_begin, seen_b, model.begin, ...)):
            total[where] += grad**2
            value[where] += rate * grad / np.sqrt(total[where]) * (0.3 if where is spot else 1.0)
    return model


def fit_languages(docs: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
                  sample: int = SAMPLE_DOCS) -> ChainModel | None:
    """A model from at most ``sample`` rows with a label for which ``train`` holds, chosen by the digest of their id. None if
    there is no such row."""
    rows = (
        docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
        .select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    )
    rows = bounded_sample(rows, rows.count(), sample, "id").orderBy("id", "text", "lang").collect()
    return fit_chain([r["text"] for r in rows], [r["lang"] for r in rows]) if rows else None


def predict_languages(docs: DataFrame, model: ChainModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, n_words, n_switches, shares) of every whole text.

    ``shares`` is the mean posterior of each language over the words, ``lang_pred`` the largest (ties: first by name) and
    ``score`` its share; ``n_switches`` counts neighbouring words whose likeliest languages differ. A text that is null or has
    no letter is ``und`` with score 0, as is every text without a model. Repeated rows are predicted each. Other
    columns are not kept, so that none can clash. An empty table gives an empty result.
    """
    bounded(docs.sparkSession, SMALL_BATCH)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        labels = model.labels if model else [UNDETERMINED]
        for batch in batches:
            texts = batch.column("text").to_pylist()
            share = np.zeros((len(texts), len(labels)))
            words, switches = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for row, some in chunked(map(lowered, texts)) if model else ():
                feats = WordFeatures(some)
                p = posteriors(model, model.scores(feats), feats.first)
                n = np.diff(feats.first)
                total = np.concatenate([np.zeros((1, len(labels))), np.cumsum(p, axis=0)])
                share[row:row + len(some)] = (total[feats.first[1:]] - total[feats.first[:-1]]) / np.maximum(n, 1)[:, None]
                words[row:row + len(some)] = n
                best = p.argmax(1)
                change = np.concatenate([[0], np.cumsum(np.append(best[1:] != best[:-1], False))]) if len(best) else np.zeros(1, int)
                last = np.maximum(feats.first[1:] - 1, feats.first[:-1])
                switches[row:row + len(some)] = np.where(n > 1, change[last] - change[np.minimum(feats.first[:-1], last)], 0)
            known = np.array([words[i] > 0 and has_letter(t) for i, t in enumerate(texts)], bool)
            best = share.argmax(1) if len(texts) else np.zeros(0, int)
            name = [labels[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)]
            score = np.where(known, np.clip(share[np.arange(len(texts)), best], 0, 1), 0.0)
            shares = [dict(zip(labels, s.tolist(), strict=True)) if k else {} for s, k in zip(share, known, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(name, pa.string()), pa.array(score), pa.array(words), pa.array(switches),
                 pa.array([list(s.items()) for s in shares], pa.map_(pa.string(), pa.float64()))],
                names=[id_col, "lang_pred", "score", "n_words", "n_switches", "shares"],
            )

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(predict, f"`{id_col}` {kind}, lang_pred string, score double, n_words bigint, n_switches bigint, shares map<string,double>")
