"""The synthetic task corpus, one sequence per order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratiocert.functions import tasks as T
from ratiocert.operators import aggregates as A
from ratiocert.plans import scorers as S
from ratiocert.plans import tasks as K
from ratiocert.session import scratch_path, spread_rows
from ratiocert.sources import writers

from .base import query, table
from .certificates import rounded

N_INT, N_CHAR, LENGTH, SEED = 12, 28, 9, 23633


def sql_letter(i: str) -> str:
    return f"CASE WHEN {i} < 26 THEN chr(CAST(97+{i} AS INT)) ELSE concat(chr(CAST(97+(({i}-26)//26) AS INT)), chr(CAST(97+(({i}-26)%26) AS INT))) END"


SQL_POOL = f"""pool AS (SELECT list_concat(list_transform(range(1, {N_INT + 1}), lambda i: CAST(i AS VARCHAR)), list_transform(range({N_CHAR}), lambda i: {sql_letter('i')})) AS pool)"""
SQL_ITEMS = f"""items AS (SELECT o_orderkey AS id, pool, list_transform(list_sort(list_transform(pool, lambda w: concat(md5(concat('{SEED}|', CAST(o_orderkey AS VARCHAR), '|', w)), w)))[1:CAST(
  1 + CAST(concat('0x', substring(md5(concat('{SEED}-length|', CAST(o_orderkey AS VARCHAR))), 1, 8)) AS BIGINT) % {LENGTH} AS INT)], lambda s: s[33:]) AS items FROM orders CROSS JOIN pool)"""
SQL_BASE = f"WITH {SQL_POOL}, {SQL_ITEMS}"
SQL_PARITY = "(list_sum(list_transform(range(1, length({w})+1), lambda j: ord({w}[j])))) % 2"
SQL_TASK = {
    "sort": "list_sort(items)",
    "reverse-sort": "list_reverse(list_sort(items))",
    "add": "list_transform(items, lambda w: pool[list_position(pool, w) % len(pool) + 1])",
    "even-odd": f"list_transform(list_sort(list_transform(items, lambda w: concat(CAST(CAST({SQL_PARITY.format(w='w')} AS INT) AS VARCHAR), w))), lambda s: s[2:])",
}


def _sequences(spark, sf, task):
    orders = spread_rows(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")))
    return K.sequences(orders, "id", task, LENGTH, N_INT, N_CHAR, SEED)


@query("tsk_population", f"WITH {SQL_POOL} SELECT o_orderkey, pool[o_orderkey % {N_INT + N_CHAR} + 1] AS item FROM orders CROSS JOIN pool")
def tsk_population(spark, sf):
    rows = K.with_population(table(spark, sf, "orders").select("o_orderkey"), N_INT, N_CHAR, "mixed", "pool")
    return rows.select("o_orderkey", F.element_at("pool", (F.col("o_orderkey") % (N_INT + N_CHAR) + 1).cast("int")).alias("item"))


@query("tsk_sequences", SQL_BASE + " SELECT id, array_to_string(items, ' ') AS input FROM items")
def tsk_sequences(spark, sf):
    return _sequences(spark, sf, "sort").select("id", "input")


def _task_query(key: str, task: str) -> None:
    @query(key, SQL_BASE + f" SELECT id, array_to_string(items, ' ') AS input, array_to_string({SQL_TASK[task]}, ' ') AS answer FROM items")
    def run(spark, sf):
        return _sequences(spark, sf, task)


for _key, _task in (("tsk_sort", "sort"), ("tsk_reverse_sort", "reverse-sort"), ("tsk_add", "add"), ("tsk_even_odd", "even-odd")):
    _task_query(_key, _task)

SQL_MARK = "array_to_string(list_transform(list_sort(list_transform(['A', 'E', 'R'], lambda x: concat(md5(concat('3|', CAST(id AS VARCHAR), '|', x)), x))), lambda s: s[-1:]), ' ')"
SQL_PROMPT = f"""concat('Q ', array_to_string(items, ' '), ' S ', {SQL_MARK}, ' ')"""


@query("tsk_prompt", SQL_BASE + f" SELECT id, {SQL_PROMPT} AS prompt, concat({SQL_PROMPT}, array_to_string({SQL_TASK['sort']}, ' ')) AS sequence, CAST(length({SQL_PROMPT}) AS INT) AS len_prompt_text FROM items")
def tsk_prompt(spark, sf):
    s = _sequences(spark, sf, "sort")
    p = T.prompt(F.col("input"), "sort", 3, F.col("id"))
    return s.select("id", p.alias("prompt"), "answer").select(
        "id", "prompt", F.concat("prompt", "answer").alias("sequence"), F.length("prompt").alias("len_prompt_text"))


# Completed sequences: right ones, swapped answers, cut answers, missing start.
SQL_DONE = f"""done AS (SELECT id, items, {SQL_TASK['sort']} AS want, CASE id % 4 WHEN 1 THEN list_reverse({SQL_TASK['sort']}) WHEN 2 THEN ({SQL_TASK['sort']})[1:greatest(len(items)-1, 1)] ELSE {SQL_TASK['sort']} END AS got, {SQL_PROMPT} AS prompt FROM items),
  texts AS (SELECT id, items, want, got, CASE WHEN id % 4 = 3 THEN concat(prompt, array_to_string(got, ' '))[3:] ELSE concat(prompt, array_to_string(got, ' ')) END AS text FROM done),
  checked AS (SELECT id, text, id % 4 <> 3 AS ok, CASE WHEN id % 4 <> 3 THEN len(got) = len(items) END AS lengths_match, id % 4 <> 3 AND got = want AS task_correct,
    CASE WHEN id % 4 <> 3 THEN len(list_filter(items, lambda w: regexp_matches(w, '^[0-9]+$'))) = len(items) END AS int_population,
    CASE WHEN id % 4 <> 3 THEN len(list_filter(range(1, least(len(got), len(want))+1), lambda i: got[i] = want[i]))/CAST(least(len(got), len(want)) AS DOUBLE) END AS num_token_match FROM texts)"""


def _done(spark, sf):
    s = _sequences(spark, sf, "sort").withColumn("want", F.split("answer", " "))
    got = (
        F.when(F.col("id") % 4 == 1, F.reverse("want"))
        .when(F.col("id") % 4 == 2, F.slice("want", F.lit(1), F.greatest(F.size("want") - 1, F.lit(1))))
        .otherwise(F.col("want")))
    text = F.concat(T.prompt(F.col("input"), "sort", 3, F.col("id")), F.array_join(got, " "))
    cut = F.when(F.col("id") % 4 == 3, F.substring("text", F.lit(3), F.length("text"))).otherwise(F.col("text"))
    return s.select("id", text.alias("text")).select("id", cut.alias("text"))


def _checked(spark, sf):
    return K.scored_sequences(_done(spark, sf), "text", N_INT, N_CHAR)


@query("tsk_score", SQL_BASE + f", {SQL_DONE} SELECT id, ok AS starts_with_q, ok AS instruct_sequence_valid, lengths_match, task_correct, int_population, round(num_token_match, 9) AS num_token_match FROM checked")
def tsk_score(spark, sf):
    return rounded(_checked(spark, sf).select("id", "check.*"), 9)


@query("agg_task_scores", SQL_BASE + f""", {SQL_DONE} SELECT """ + ", ".join(
    f"round(avg(coalesce(CAST({c} AS DOUBLE), 0)),9) AS {n}" for c, n in (
        ("int_population", "int_population"), ("task_correct", "task_correct"), ("ok", "instruct_sequence_valid"), ("lengths_match", "lengths_match"), ("num_token_match", "num_token_match")))
    + ", round(count(DISTINCT text)/CAST(count(*) AS DOUBLE),9) AS unique_sequences, round(avg(CAST(task_correct AS DOUBLE)) FILTER (coalesce(int_population, true)),9) AS task_correct_int_population FROM checked")
def agg_task_scores(spark, sf):
    return rounded(A.task_scores(_checked(spark, sf), "text"), 9)


# One sequence for each order is wanted; ids go on after the orders' where some are equal. As many more are enough here.
SQL_TOPPED = f"""{SQL_BASE.replace("FROM orders CROSS JOIN pool", "FROM every CROSS JOIN pool").replace(f"WITH {SQL_POOL}", f"""WITH {SQL_POOL},
  every AS (SELECT unnest(range(1, 2 * (SELECT count(*) FROM orders) + 1)) AS o_orderkey)""")},
  u AS (SELECT min(id) AS id, array_to_string(items, ' ') AS input, any_value(array_to_string({SQL_TASK['add']}, ' ')) AS answer FROM items GROUP BY 2),
  p AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS position FROM u QUALIFY position < (SELECT count(*) FROM orders))"""


def _topped_up(spark, sf):
    def generate(first, count):
        return K.sequences(spark.range(first, first + count), "id", "add", LENGTH, N_INT, N_CHAR, SEED)

    return K.unique_sequences(spark, generate, table(spark, sf, "orders").count(), first=1)


@query("set_dedup_sequences", SQL_TOPPED + " SELECT id, input, answer FROM p")
def set_dedup_sequences(spark, sf):
    """As many unique sequences as there are orders."""
    return _topped_up(spark, sf).select("id", "input", "answer")


@query("tsk_dataset", SQL_TOPPED + " SELECT input, answer, CASE WHEN position < 10000 THEN 'train' WHEN position < 11024 THEN 'val' ELSE 'test' END AS split FROM p")
def tsk_dataset(spark, sf):
    """As many unique sequences as there are orders, split and written under their settings, then read back."""
    folder = K.settings_path("mixed", "add", LENGTH, N_INT, N_CHAR, False)
    path = f"{scratch_path(spark, 'tasks')}/{folder}"
    writers.write_splits(K.split_sequences(_topped_up(spark, sf), "id", 10000, 1024), path, "id")
    return spark.read.schema("input string, answer string, split string").json(f"{path}/splits")


# Task sequences and, for every fifth order, a question whose target is its customer; each is scored by its own rule.
SQL_MIXED = f"""{SQL_DONE}, mixed AS (SELECT 'task_data' AS dataset, text, CAST(NULL AS VARCHAR) AS response, CAST(NULL AS VARCHAR) AS target, id FROM texts
  UNION ALL SELECT 'orders', NULL, concat('priority ', CASE WHEN o_orderkey % 3 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END), o_orderpriority, o_orderkey FROM orders WHERE o_orderkey % 5 = 0),
  words AS (SELECT *, regexp_split_to_array(trim(response), '\\s+') AS g, regexp_split_to_array(trim(target), '\\s+') AS w FROM mixed WHERE dataset = 'orders'),
  answers AS (SELECT CAST(ends_with(response, target) AS DOUBLE) AS e, CAST(len(g) = len(w) AS DOUBLE) AS l, len(list_filter(range(1, least(len(g), len(w)) + 1), lambda i: g[i] = w[i])) / CAST(least(len(g), len(w)) AS DOUBLE) AS m FROM words)"""


@query("scr_by_dataset", SQL_BASE + f", {SQL_MIXED} " + " UNION ALL ".join(
    f"SELECT 'task_data' AS dataset, '{n}' AS \"check\", count(*) AS n, round(avg(coalesce(CAST({c} AS DOUBLE), {m})), 9) AS mean FROM checked"
    for c, n, m in (("ok", "starts_with_q", 0), ("ok", "instruct_sequence_valid", 0), ("lengths_match", "lengths_match", 0), ("task_correct", "task_correct", 0), ("int_population", "int_population", 1), ("num_token_match", "num_token_match", 0)))
    + "".join(f" UNION ALL SELECT 'orders', '{n}', count(*), round(avg({c}), 9) FROM answers" for c, n in (("e", "ends_with_target"), ("l", "lengths_match"), ("m", "word_match"))))
def scr_by_dataset(spark, sf):
    """Two data sets in one table, each scored by its own rule; a missing integer flag counts as true."""
    rules = {"task_data": S.Scorer(S.task_checks(N_INT, N_CHAR), {"int_population": 1.0}), "orders": S.Scorer(S.answer_checks, {})}
    tasks = _done(spark, sf).select(F.lit("task_data").alias("dataset"), F.col("text").alias("response"), F.lit(None).cast("string").alias("target"))
    said = F.when(F.col("o_orderkey") % 3 == 0, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority"))
    orders = table(spark, sf, "orders").where("o_orderkey % 5 = 0").select(
        F.lit("orders").alias("dataset"), F.concat(F.lit("priority "), said).alias("response"), F.col("o_orderpriority").alias("target"))
    scored = S.scored_items(tasks.unionByName(orders), "dataset", "response", "target", rules)
    return rounded(S.aggregate_scores(scored, "dataset", rules), 9)
