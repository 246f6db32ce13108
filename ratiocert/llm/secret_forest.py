"""Secrets in texts: proposals by patterns, false positives removed by a random forest.

Patterns with a high recall propose candidates: known key formats, values assigned to a telling name, key blocks, and any
long run that mixes digits with letters or is long for a word. A forest then decides from what a candidate looks
like (length, changes between kinds of characters, how usual its letter pairs are, how much of it dictionary words cover) and
where it stands (source, neighbouring words and marks). Everything on the main path is a column expression or Spark's own forest.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .base import bounded, bounded_sample

SAMPLE_FINDINGS = 20_000  # at most so many labelled findings train the forest
KNOWN_SHARE, KNOWN_LEAST = 1e-6, 3  # a word of the dictionary is in such a share of all documents, and in so many at least

_NAMES = "password|passwd|pwd|secret|token|api_key|apikey|access_key|auth"
_RUN = "A-Za-z0-9+/_-"
_ASSIGNED = rf"(?i:{_NAMES})[\"']?[ ]{{0,3}}[=:][ ]{{0,3}}[\"']?"  # what stands before an assigned value
# A key block goes to its END line, whatever its length and headers; one that is cut off goes on as long as it looks like a key.
_BLOCK = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END [A-Z ]{0,40}PRIVATE KEY-----"
    r"|(?:\s*+(?:Proc-Type|DEK-Info):[^\n]*+)*+[A-Za-z0-9+/=\s]*+)"
)
PROPOSAL = (
    _BLOCK
    + rf"|(?<=[=: \"'])(?<={_ASSIGNED})[^\s\"'=:][^\s\"']{{5,}}"
    rf"|(?<![{_RUN}])AKIA[0-9A-Z]{{16}}(?![{_RUN}])"
    rf"|(?<![{_RUN}])(?=[{_RUN}]*?[0-9])[{_RUN}]{{12,}}+={{0,2}}"
    r"|(?<![A-Za-z])[A-Za-z]{24,}+"
)
_WORTH_A_LOOK = rf"[0-9]|(?i:{_NAMES})|AKIA|PRIVATE KEY|[A-Za-z]{{24}}"

FEATURES = [
    "f_length", "f_digits", "f_upper", "f_lower", "f_marks", "f_changes", "f_case_changes", "f_letter_pairs", "f_pair_cost", "f_dictionary",
    "f_slashes", "f_source", "f_before", "f_after", "f_assigned", "f_quoted", "f_before_known", "f_after_known", "f_named",
]


def proposals(docs: DataFrame, id_col: str, text_col: str, source_col: str | None) -> DataFrame:
    """(id, source, start, end, value, before, after): every proposal of every whole text, in code points."""
    source = F.coalesce(F.col(source_col), F.lit("")) if source_col else F.lit("")
    rows = docs.where(F.col(text_col).rlike(_WORTH_A_LOOK)).select(
        F.col(id_col).alias("id"), source.alias("source"),
        F.expr(f"regexp_extract_all(`{text_col}`, {_literal(PROPOSAL)}, 0)").alias("values"), F.col(text_col).alias("text"),
    ).where(F.size("values") > 0)
    rows = rows.select("id", "source", "values", F.split("text", PROPOSAL).alias("gaps"))
    # each value follows the gap of its number; where a value ends the text, the last gap is empty
    at = F.aggregate(
        F.sequence(F.lit(1), F.size("values")), F.array(F.lit(0)),
        lambda acc, i: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(F.get("gaps", i - 1)) + F.length(F.get("values", i - 1)))),
    )
    return rows.withColumn("ends", at).select(
        "id", "source", F.posexplode("values").alias("i", "value"), "gaps", "ends"
    ).select(
        "id", "source", (F.element_at("ends", F.col("i") + 2) - F.length("value")).cast("long").alias("start"),
        F.element_at("ends", F.col("i") + 2).cast("long").alias("end"), "value",
        F.right(F.get("gaps", F.col("i")), F.lit(60)).alias("before"), F.left(F.coalesce(F.get("gaps", F.col("i") + 1), F.lit("")), F.lit(60)).alias("after"),
    )


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _letter_statistics(docs: DataFrame, text_col: str) -> tuple[str, DataFrame]:
    """Cost (-log share) of each letter pair as a list, and the dictionary as a table of words (w); both from all documents,
    each word counted once a document."""
    listed = docs.select(F.array_distinct(F.expr(f"regexp_extract_all(lower(`{text_col}`), '[a-z]{{2,}}', 0)")).alias("ws"))
    words = cut_lineage(listed.select(F.explode("ws").alias("w")).groupBy("w").count())
    pairs = words.select(
        F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring(F.col("w"), i, F.lit(2)))).alias("p"), "count"
    ).groupBy("p").agg(F.sum("count").alias("n")).collect()
    counts = {r["p"]: r["n"] for r in pairs}  # at most 676
    total = sum(counts.values()) + 676
    letters = "abcdefghijklmnopqrstuvwxyz"
    cost = ",".join(f"{-math.log((counts.get(a + b, 0) + 1) / total):.3f}" for a in letters for b in letters)
    return cost, words.where((F.length("w") >= 3) & (F.col("count") >= max(KNOWN_LEAST, KNOWN_SHARE * docs.count()))).select("w")


def numbered(found: DataFrame) -> DataFrame:
    """The findings, stored with a number each (``row``)."""
    return cut_lineage(found.withColumn("row", F.monotonically_increasing_id()))


def _known_words(found: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(row, covered, before_known, after_known) of the findings that hold words of the dictionary or stand by one."""
    entry = lambda w, place: F.struct(w.alias("w"), F.lit(place).alias("place"))
    runs = F.expr("regexp_extract_all(lower(value), '[a-z]{3,}', 0)")
    words = found.select("row", F.explode(F.concat(
        F.transform(runs, lambda w: entry(w, 0)), F.array(entry(_before_word(), 1), entry(_after_word(), 2)),
    )).alias("x")).where("x.w <> ''").groupBy("row", F.col("x.w").alias("w"), F.col("x.place").alias("place")).count()
    return words.join(dictionary, "w").groupBy("row").agg(
        F.sum(F.when(F.col("place") == 0, F.length("w") * F.col("count")).otherwise(0)).alias("covered"),
        F.max((F.col("place") == 1).cast("double")).alias("before_known"), F.max((F.col("place") == 2).cast("double")).alias("after_known"),
    )


def _before_word() -> Column:
    return F.lower(F.regexp_extract("before", r"(\p{L}+)[^\p{L}]*$", 1))


def _after_word() -> Column:
    return F.lower(F.regexp_extract("after", r"^[^\p{L}]*(\p{L}+)", 1))


def with_features(found: DataFrame, cost: str, dictionary: DataFrame) -> DataFrame:
    """Adds FEATURES to findings that are :func:`numbered`."""
    v, low = F.col("value"), F.lower("value")
    n = F.greatest(F.length(v), F.lit(1)).cast("double")

    def share(pattern: str) -> Column:
        return F.regexp_count(v, F.lit(pattern)) / n

    def bucket(word: Column) -> Column:
        return F.when(word == "", F.lit(-1.0)).otherwise(F.pmod(F.xxhash64(word), F.lit(32)).cast("double"))

    costs = F.split(F.lit(cost), ",").cast("array<double>")
    pairs = F.regexp_extract_all(low, F.lit("(?=([a-z]{2}))"), F.lit(1))  # one pass, however long a key block is
    place = lambda p: ((F.ascii(p) - 97) * 26 + F.ascii(F.substring(p, 2, 1)) - 97 + 1).cast("int")
    known = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return found.join(_known_words(found, dictionary), "row", "left").withColumns({
        "pairs": pairs, "before_word": _before_word(), "after_word": _after_word(),
    }).withColumns({
        "f_length": F.log1p(n), "f_digits": share("[0-9]"), "f_upper": share("[A-Z]"), "f_lower": share("[a-z]"), "f_marks": share("[^A-Za-z0-9]"),
        "f_changes": F.regexp_count(v, F.lit("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]")) / n,
        "f_case_changes": F.regexp_count(v, F.lit("(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]")) / n,
        "f_letter_pairs": F.size("pairs") / n,
        "f_pair_cost": F.when(F.size("pairs") > 0, F.aggregate("pairs", F.lit(0.0), lambda acc, p: acc + F.element_at(costs, place(p))) / F.size("pairs")).otherwise(0.0),
        "f_dictionary": known("covered") / n, "f_slashes": share("/"), "f_source": F.pmod(F.xxhash64("source"), F.lit(16)).cast("double"),
        "f_before": bucket(F.col("before_word")), "f_after": bucket(F.col("after_word")),
        "f_assigned": F.col("before").rlike("[=:]\\s*[\"']?$").cast("double"), "f_quoted": F.col("before").rlike("[\"']$").cast("double"),
        "f_before_known": known("before_known"), "f_after_known": known("after_known"),
        "f_named": F.col("before_word").rlike(f"(?:{_NAMES.replace('_', '|')})$").cast("double"),
    }).drop("pairs", "covered", "before_known", "after_known")


def distant_labels(found: DataFrame) -> DataFrame:
    """Findings with a label where one is plain: known formats and assigned values that look random are secrets; bare numbers,
    and words without digits that nothing assigns, are not. Others get none."""
    v = F.col("value")
    telling = F.col("before").rlike(f"{_ASSIGNED}$")
    random_looking = v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (F.length(v) >= 12)
    return found.withColumn("label", F.when(v.rlike("^AKIA[0-9A-Z]{16}$") | v.startswith("-----BEGIN "), 1.0)
                            .when(telling & random_looking, 1.0)
                            .when(~telling & (v.rlike(r"^[0-9 ().+_-]+$") | v.rlike("^[A-Za-z]+$")), 0.0))


def fit_forest(labelled: DataFrame, cost: str, dictionary: DataFrame, trees: int = 20, depth: int = 6, seed: int = 11, sample: int = SAMPLE_FINDINGS) -> RandomForestClassificationModel | None:
    """A forest from at most ``sample`` labelled findings (value, before, after, source, ``label``), as many of either label
    where there are, chosen by their digest. None unless both labels occur."""
    labelled = labelled.select("value", "before", "after", "source", "label")
    counts = {r["label"]: r["count"] for r in labelled.where("label IS NOT NULL").groupBy("label").count().collect()}
    if not counts.get(0.0) or not counts.get(1.0):
        return None
    parts = [bounded_sample(labelled.where(F.col("label") == y), counts[y], sample // 2, "value", "before", "after") for y in (0.0, 1.0)]
    rows = cut_lineage(with_features(numbered(parts[0].union(parts[1])), cost, dictionary).select(*FEATURES, "label"))
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=32).fit(ready)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source",
                 labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """(id, start, end, value_sha256, format, score, secret): every proposal of every whole text, in code points.

    ``labelled`` has value, before, after, source and a 0/1 ``label`` of findings that were looked at; without it, labels are
    those of :func:`distant_labels` on the proposals themselves. ``score`` is the forest's probability that the proposal is a
    secret, ``secret`` whether it reaches the threshold. Without both labels nothing can be learned; then the score is 1
    and all proposals stay. A value is given as a digest, so that results don't spread it.

    Null and empty texts have no proposals. Repeated rows have theirs each; null ids and sources count as values. Other columns are
    not kept, so that none can clash. An empty table gives an empty result.
    """
    bounded(docs.sparkSession)
    found = numbered(proposals(docs, id_col, text_col, source_col))
    cost, dictionary = _letter_statistics(docs, text_col)
    known = distant_labels(found) if labelled is None else labelled
    model = fit_forest(known, cost, dictionary)
    if model is None:
        scored = found.withColumn("score", F.lit(1.0))
    else:
        ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(found, cost, dictionary))
        scored = model.transform(ready).withColumn("score", vector_to_array("probability")[1])
    kind = F.when(F.col("value").startswith("-----BEGIN "), "private key").when(F.col("value").rlike("^AKIA[0-9A-Z]{16}$"), "access key").when(
        F.col("value").rlike("^[0-9a-fA-F]+$") & F.col("value").rlike("[a-fA-F]"), "hexadecimal").otherwise("other")
    return scored.select(
        F.col("id").alias(id_col), "start", "end", F.sha2("value", 256).alias("value_sha256"), kind.alias("format"),
        F.round("score", 9).alias("score"), (F.col("score") >= threshold).alias("secret"),
    )
