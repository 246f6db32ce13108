"""Personal data: generators propose spans, boosted trees score them, calibrated thresholds choose what is redacted.

Spans of the four strict patterns always stay. Looser generators propose more: addresses spelled out, numbers that look like
a card or phone but lack a mark of the strict form. Positives are the strict spans as the looser generators see them once their
marks are masked in the text (no plus; @ and dots spelled out); negatives are only proposals that are plainly something
else (failed check digit, shape of an address part, date or decimal), which are never chosen. Other proposals have no label. The
features leave out what the strict check looks at, so that the trees learn from format and context.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import SMALL_BATCH, Shelf, bounded, sampled
from .boosting import BoostedTrees, calibrate_scores, fit_boosted_rows, listed, threshold_for

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98
Span = tuple[int, int]

# Fixed values of the contract.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")  # an ip is each four parts of such a run, from the left
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Looser forms.
_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]+)+")
_NUMBER = re.compile(r"(?<![0-9])[(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,22}(?![0-9])")
# A text without any of these holds no span of any generator.
_WORTH_A_LOOK = r"[0-9@]|[(\[]at[)\]]"
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(int(d) * 2 - 9 * (d > "4") for d in digits[-2::-2])) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def strict_emails(text: str) -> list[Span]:
    """Leftmost matches, found from each @ outwards."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def dotted_fours(text: str) -> list[Span]:
    """Leftmost non-overlapping runs of four numbers joined by dots, whatever their values."""
    out = []
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            end = at + sum(map(len, parts[i:i + 4])) + 3
            out.append((at, end))
            at = end + 1
    return out


def _byte_parts(s: str) -> bool:
    return all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in s.split("."))


def strict_spans(text: str) -> dict[str, list[Span]]:
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    found["email"] = strict_emails(text) if "@" in text else []
    found["ip"] = [(a, b) for a, b in dotted_fours(text) if _byte_parts(text[a:b])]
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 60:
            d = _digits(m[0])
            if 16 <= len(d) <= 19 and luhn(d):
                found["card"].append(m.span())
    if "+" in text:
        found["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


def proposals(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the looser generators; they may overlap each other and the strict spans."""
    out = []
    if "@" in text or "at)" in text or "at]" in text:
        out += [("email", *m.span()) for m in _SPELLED.finditer(text)]
    out += [("ip", *s) for s in dotted_fours(text)]
    for m in _NUMBER.finditer(text):
        n = len(_digits(m[0]))
        if n >= 13:
            out.append(("card", *m.span()))
        if 7 <= n <= 15:
            out.append(("phone", *m.span()))
    return out


_DATE = re.compile(
    r"(?:19|20)[0-9]{2}[-. ]?(?:0[1-9]|1[0-2])[-. ]?(?:0[1-9]|[12][0-9]|3[01])(?:[^0-9].*|[0-9]{4}(?:[0-9]{2})?)?"
    r"|(?:0?[1-9]|[12][0-9]|3[01])[-. ](?:0?[1-9]|1[0-2])[-. ](?:19|20)[0-9]{2}(?:[^0-9].*)?|(?:1[5-9]|20)[0-9]{2} ?- ?(?:1[5-9]|20)[0-9]{2}"
)
_DECIMAL = re.compile(r"(?![0-9]{3}\.[0-9]{4}\Z)[0-9]+\.[0-9]+")
_FOUR_OR_MORE = re.compile(r"[0-9]+(?:\.[0-9]+){3,}")


def something_else(kind: str, s: str) -> bool:
    """True where a proposal is plainly not of its kind."""
    if kind == "email":  # no top-level domain, or a sentence ends inside
        return not re.search(r"[A-Za-z]{2,}\Z", re.split(r"[. )\]]", s)[-1]) or bool(re.search(r"[^ ]\. ", s))
    if kind == "ip":
        return not _byte_parts(s)
    if kind == "card":
        d = _digits(s)
        return len(d) > 19 or not luhn(d)
    return any(p.fullmatch(s) for p in (_DATE, _DECIMAL, _FOUR_OR_MORE))


def masked(text: str, strict: dict[str, list[Span]]) -> tuple[str, dict[str, list[Span]]]:
    """The text with the marks of its strict spans taken away, and where the spans are then. How an address is spelled
    depends on its digest."""
    edits: dict[int, str] = {a: "" for a, _ in strict["phone"]}
    for a, b in strict["email"]:
        way = hashlib.blake2s(text[a:b].encode("utf-8", "replace"), digest_size=1).digest()[0]
        at = text.index("@", a, b)
        edits[at] = ("(at)", "[at]", " (at) ", " [at] ", " @ ")[way % 5]
        dot = (".", "(dot)", "[dot]", " (dot) ", " [dot] ")[way // 5 % 5]
        edits |= {i: dot for i in range(at, b) if text[i] == "."}
    out, last, places, size = [], 0, [], 0
    for i in sorted(edits):
        out += [text[last:i], edits[i]]
        last = i + 1
        size += len(edits[i]) - 1
        places.append((i, size))
    keys = [i for i, _ in places]
    moved = lambda i: i + (places[k - 1][1] if (k := bisect_left(keys, i)) else 0)
    return "".join([*out, text[last:]]), {k: [(moved(a), moved(b)) for a, b in v] for k, v in strict.items()}


def examples(text: str) -> Iterator[tuple[list[float], float]]:
    """Features and label of the proposals that have a label."""
    plain, strict = masked(text, strict_spans(text))
    every = [s for spans in strict.values() for s in spans]
    for kind, a, b in proposals(plain):
        if any(x < b and a < y for x, y in strict[kind]):
            yield features(plain, kind, a, b), 1.0
        elif something_else(kind, plain[a:b]) or any(x < b and a < y for x, y in every):
            yield features(plain, kind, a, b), 0.0


def _context_bucket(word: str, buckets: int = 16) -> int:
    return int.from_bytes(hashlib.blake2s(word.lower().encode(), digest_size=4).digest(), "big") % buckets if word else 0


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    s = text[start:end]
    before, after = text[max(0, start - 40):start], text[end:end + 40]
    groups = re.findall(r"[0-9]+", s)
    sizes = [len(g) for g in groups] or [0]
    lead = re.search(r"([^\W\d_]+)\W*\Z", before)
    trail = re.match(r"\W*([^\W\d_]+)", after)
    return [
        float(KINDS.index(kind)), float(len(s)), float(sum(sizes)), float(len(groups)), float(max(sizes)), float(min(sizes)),
        float(s.count(" ")), float(s.count("-")), float(s.count(".")), float(s.count("(")),
        float(len(set(s))), float(sum(c.isalpha() for c in s)), float(after[:1].isspace() or not after), float(after[:1].isalnum()),
        float(sum("0" <= c <= "9" for c in before + after)), float(_context_bucket(lead[1] if lead else "")),
        float(_context_bucket(trail[1] if trail else "")), float(len(lead[1]) if lead else 0),
    ]


N_FEATURES = len(features("", KINDS[0], 0, 0))


@dataclass
class Scorer:
    trees: BoostedTrees | None = None
    threshold: dict[str, float] = field(default_factory=dict)

    def choose(self, text: str, strict: dict[str, list[Span]]) -> list[tuple[str, int, int]]:
        """Strict spans and the proposals that the trees select; a proposal touching a strict span of any kind adds nothing."""
        taken = sorted(s for spans in strict.values() for s in spans)
        extra = []
        if self.trees is not None:
            open_ones = [p for p in proposals(text) if not any(a < p[2] and p[1] < b for a, b in taken) and not something_else(p[0], text[p[1]:p[2]])]
            if open_ones:
                score = self.trees.probability(np.array([features(text, *p) for p in open_ones]))
                ranked = sorted(zip(-score, open_ones, strict=True))
                for minus, (kind, a, b) in ranked:
                    if -minus >= self.threshold.get(kind, 2.0) and not any(x < b and a < y for _, x, y in extra):
                        extra.append((kind, a, b))
        return [(k, *s) for k in KINDS for s in strict[k]] + extra


def fit_scorer(docs: DataFrame, id_col: str, text_col: str, sample: int | None = None, precision: float = PRECISION) -> Scorer:
    """Trees and thresholds from the different labelled proposals of all rows. A caller may name a ``sample``: then about so many
    of the proposals of about so many rows, both chosen by a digest: of the id, and of the proposal itself, so that every part
    and label keeps the same share.

    Two thirds of the rows train, the others calibrate; a kind's threshold is the lowest score at which the
    calibration rows reach the precision. Without both labels in both parts, only strict spans are found. Proposals stay in the
    tasks: sums of the trees' levels, and counts of the calibration rows by kind, score and label, are what the driver gets.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").rlike(_WORTH_A_LOOK))
    if sample is not None:
        narrow = sampled(narrow, docs.count(), sample, "id")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, labels, part = [], [], []
            for text in batch.column("text").to_pylist():
                fold = hashlib.blake2s(text.encode("utf-8", "replace"), digest_size=2).digest()[0] % 3
                for x, y in examples(text):
                    rows.append(x)
                    labels.append(y)
                    part.append(fold)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.list_(pa.float64())), pa.array(labels, pa.float64()), pa.array(part, pa.int32())],
                names=["x", "y", "part"],
            )

    shelf = Shelf()
    found = shelf.keep(narrow.select("text").mapInArrow(describe, "x array<double>, y double, part int").distinct())
    seen = found if sample is None else sampled(found, found.count(), sample, "part", "y", "x")
    fit, held = seen.where("part > 0"), seen.where("part = 0")
    both = seen.groupBy((F.col("part") > 0).alias("fit"), "y").count().count() == 4  # both labels in both parts
    scorer = Scorer()
    if both:
        trees = fit_boosted_rows(fit, N_FEATURES)
        counts = _score_counts(held, trees)
        s, y, n = (counts[c].to_numpy() for c in ("score", "y", "n"))
        trees = calibrate_scores(trees, s, y, n)
        of_kind = {k: counts["kind"].to_numpy() == i for i, k in enumerate(KINDS)}
        p = trees.scaled(s)
        scorer = Scorer(trees, {k: threshold_for(p[m], y[m], precision, n[m]) for k, m in of_kind.items()})
    shelf.drop(found)
    return scorer


def _score_counts(rows: DataFrame, trees: BoostedTrees) -> pd.DataFrame:
    """How many of ``rows`` (x, y) have each (kind, score, y); raw scores are on a grid, so that there are few."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = listed(batch.column("x"), N_FEATURES)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(trees.raw(x)), batch.column("y")], names=["kind", "score", "y"])

    scored = rows.select("x", "y").mapInArrow(score, "kind double, score double, y double")
    return scored.groupBy("kind", "score", "y").agg(F.count("*").alias("n")).orderBy("kind", "score", "y").toPandas()


def _listed(spans: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1], s[2])))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b in spans):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scorer: Scorer | None = None) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base, spans, redacted) of every whole text.

    The counts and ``base`` are of the strict spans, ``spans`` of all chosen ones, listed as kind:start:end in code points;
    ``redacted`` is the text with all of them replaced. Null texts count as empty and stay null. Repeated rows are treated
    each. Other columns are not kept, so that none can clash. An empty table gives an empty result.
    """
    bounded(docs.sparkSession, SMALL_BATCH)
    scorer = scorer or fit_scorer(docs, id_col, text_col)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, base, every, clean = [], [], [], []
            look = pc.match_substring_regex(batch.column("text"), _WORTH_A_LOOK).to_pylist()
            for text, worth in zip(batch.column("text").to_pylist(), look, strict=True):
                strict = strict_spans(text if worth else "")
                chosen = scorer.choose(text, strict) if worth else []
                counts.append([len(strict[k]) for k in KINDS])
                base.append(_listed([(k, *s) for k in KINDS for s in strict[k]]))
                every.append(_listed(chosen))
                clean.append(redacted(text, chosen) if text and chosen else text)
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *columns, pa.array(base, pa.string()), pa.array(every, pa.string()), pa.array(clean, pa.string())],
                names=[id_col, *(f"n_{k}" for k in KINDS), "base", "spans", "redacted"],
            )

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(find, f"`{id_col}` {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, spans string, redacted string")


def redact(docs: DataFrame, text_col: str = "text", scorer: Scorer | None = None, id_col: str = "doc_id") -> DataFrame:
    """All columns of ``docs``, with the chosen spans of the text replaced. Null texts stay null."""
    bounded(docs.sparkSession, SMALL_BATCH)
    scorer = scorer or fit_scorer(docs, id_col, text_col)
    at = docs.columns.index(text_col)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = []
            look = pc.match_substring_regex(batch.column(at), _WORTH_A_LOOK).to_pylist()
            for text, worth in zip(batch.column(at).to_pylist(), look, strict=True):
                chosen = scorer.choose(text, strict_spans(text)) if worth else []
                clean.append(redacted(text, chosen) if chosen else text)
            yield batch.set_column(at, text_col, pa.array(clean, pa.string()))

    return docs.mapInArrow(replace, docs.schema)
