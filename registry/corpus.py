"""Corpus preparation: prompts, answers, token sequences, blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratiocert.functions import prompts as P
from ratiocert.functions import sequences as Q
from ratiocert.operators.merges import few_shot_prompts
from ratiocert.operators.packing import packed_blocks

from .base import (SQL_WORDS, V_ITEMS, V_PAIR_TOKENS, V_PAIRS, items, joined, pair_tokens, pairs, query, table, wide_table)

NL = "chr(10)"


@query("fmt_context_qa", f"""WITH {V_PAIRS} SELECT conv_id, turn, concat('Question: ', prompt, {NL}, {NL}, 'Context: ', array_to_string(string_split(response, '. '), {NL}), {NL}, {NL}, {NL}, 'Answer: ', response) AS text FROM v_pairs""")
def fmt_context_qa(spark, sf):
    contexts = P.joined_contexts(F.split("response", r"\. "))
    text = P.with_answer(P.context_question(F.col("prompt"), contexts), F.col("response"))
    return pairs(spark, sf).select("conv_id", "turn", text.alias("text"))


@query("fmt_prefix_qa", f"""WITH {V_PAIRS} SELECT conv_id, turn, concat(CASE WHEN turn > 0 THEN concat('Turn ', CAST(turn AS VARCHAR), {NL}, {NL}) ELSE '' END,
  'Question: ', prompt, {NL}, {NL}, 'Context: ', response, {NL}, {NL}, 'Answer: ', response) AS text FROM v_pairs""")
def fmt_prefix_qa(spark, sf):
    prefix = F.when(F.col("turn") > 0, F.concat(F.lit("Turn "), F.col("turn").cast("string")))
    prompt = P.context_question(F.col("prompt"), F.col("response"), prefix)
    return pairs(spark, sf).select("conv_id", "turn", P.with_answer(prompt, F.col("response")).alias("text"))


@query("fmt_question", f"""SELECT conv_id, turn, CASE WHEN q LIKE '%?' THEN concat('Question: ', q, {NL}, {NL}, 'Answer: ') ELSE concat(q, ' ') END AS text FROM
  (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN concat(text, '?') ELSE text END AS q FROM conversations) t""")
def fmt_question(spark, sf):
    q = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", P.plain_question(q).alias("text"))


SQL_MC = f"""concat(question, {NL}, 'A. ', choices[1], {NL}, 'B. ', choices[2], {NL}, 'C. ', choices[3], {NL}, 'D. ', choices[4], {NL}, 'Answer:')"""


@query("fmt_multiple_choice", f"WITH {V_ITEMS} SELECT idx, {SQL_MC} AS text, concat({SQL_MC}, ' ', ['A','B','C','D'][answer+1]) AS solved FROM v_items")
def fmt_multiple_choice(spark, sf):
    args = F.col("question"), F.col("choices")
    return items(spark, sf).select("idx", P.multiple_choice(*args).alias("text"), P.multiple_choice(*args, F.col("answer")).alias("solved"))


@query("fmt_yesno_scoring", f"""WITH {V_PAIRS} SELECT conv_id, turn, concat({NL}, {NL}, 'Question: ', prompt, {NL}, {NL}, 'Context: ', response, {NL}, {NL}, {NL}, 'Answer:') AS text,
  concat('Instruction: Say yes or no.', {NL}, {NL}, 'Question: ', prompt, {NL}, {NL}, 'Context: ', response, {NL}, {NL}, {NL}, 'Answer:') AS instructed,
  CAST(CASE turn % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS INT) AS answer_id FROM v_pairs""")
def fmt_yesno_scoring(spark, sf):
    contexts = F.array("response")
    decision = F.element_at(F.array(*map(F.lit, ["yes", "no", "maybe", "none"])), (F.col("turn") % 4 + 1).cast("int"))
    return pairs(spark, sf).select(
        "conv_id", "turn", P.yes_no_question(F.col("prompt"), contexts).alias("text"),
        P.yes_no_question(F.col("prompt"), contexts, "Say yes or no.").alias("instructed"), P.yes_no_id(decision).alias("answer_id"))


@query("fmt_few_shot", f"""WITH {V_ITEMS}, ex AS (SELECT subject, idx, concat({SQL_MC}, ' ', ['A','B','C','D'][answer+1]) AS e, row_number() OVER (PARTITION BY subject ORDER BY idx) AS rn FROM v_items),
  shots AS (SELECT subject, string_agg(e, {NL}||{NL} ORDER BY idx) AS shots FROM ex WHERE rn <= 5 GROUP BY subject)
  SELECT v.idx, concat('The following are multiple choice questions (with answers) about ', replace(v.subject, '_', ' '), '.', {NL}, {NL}, s.shots, {NL}, {NL}, {SQL_MC.replace('question', 'v.question').replace('choices', 'v.choices')}) AS text,
  concat('The following are multiple choice questions (with answers) about ', replace(v.subject, '_', ' '), '.', {NL}, {NL}, {NL}, {NL}, {SQL_MC.replace('question', 'v.question').replace('choices', 'v.choices')}) AS zero_shot
  FROM v_items v JOIN shots s ON v.subject=s.subject""")
def fmt_few_shot(spark, sf):
    rows = items(spark, sf)
    five = few_shot_prompts(rows, rows, 5).select("idx", F.col("prompt").alias("text"))
    none = few_shot_prompts(rows, rows, 0).select("idx", F.col("prompt").alias("zero_shot"))
    return five.join(none, "idx")


@query("sel_longest_answer", f"""WITH {V_ITEMS} SELECT idx, list_filter(choices, lambda x: length(x) = list_max(list_transform(choices, lambda y: length(y))))[1] AS answer FROM v_items""")
def sel_longest_answer(spark, sf):
    return items(spark, sf).select("idx", Q.first_longest(F.col("choices")).alias("answer"))


SQL_HEX = "CAST(concat('0x', substring(md5(concat({seed}, CAST({id} AS VARCHAR))), 1, 8)) AS BIGINT)"


@query("sel_answer_choice", f"""WITH {V_ITEMS} SELECT idx, choices[answer+1] AS correct, choices[{SQL_HEX.format(seed="'5|'", id="idx")} % 4 + 1] AS random,
  list_filter(choices, lambda x: length(x) = list_max(list_transform(choices, lambda y: length(y))))[1] AS longest FROM v_items""")
def sel_answer_choice(spark, sf):
    pick = lambda mode: P.chosen_answer(F.col("choices"), F.col("answer"), mode, 5, F.col("idx"))
    return items(spark, sf).select("idx", *[pick(m).alias(m) for m in ("correct", "random", "longest")])


@query("seq_truncate_budget", f"""WITH {V_PAIR_TOKENS} SELECT conv_id, turn, array_to_string(pt[1:greatest(64 - len(rt) - 2, 0)], ' ') AS prompt,
  array_to_string(list_concat(['<s>'], pt[1:greatest(64 - len(rt) - 2, 0)], rt, ['</s>'])[1:64], ' ') AS sequence FROM v_pair_tokens""")
def seq_truncate_budget(spark, sf):
    cut = Q.truncate_prompt(F.col("pt"), F.col("rt"), 64)
    whole = F.concat(F.array(F.lit(Q.BOS)), cut, "rt", F.array(F.lit(Q.EOS)))
    return pair_tokens(spark, sf).select("conv_id", "turn", joined(cut).alias("prompt"), joined(Q.head(whole, F.lit(64))).alias("sequence"))


@query("seq_add_eos", f"""WITH {V_PAIR_TOKENS} SELECT conv_id, turn, array_to_string(list_concat(rt, ['</s>']), ' ') AS ended, array_to_string(list_concat(rt, ['</s>']), ' ') AS kept, array_to_string(rt, ' ') AS dropped FROM v_pair_tokens""")
def seq_add_eos(spark, sf):
    eos = F.lit(Q.EOS)
    once = Q.ensure_end(F.col("rt"), eos)
    return pair_tokens(spark, sf).select("conv_id", "turn", joined(once).alias("ended"), joined(Q.ensure_end(once, eos)).alias("kept"),
                                         joined(Q.drop_end(Q.drop_end(once, eos), eos)).alias("dropped"))


@query("seq_label_mask", f"""WITH {V_PAIR_TOKENS} SELECT conv_id, turn, array_to_string(list_transform(list_concat(list_transform(pt, lambda x: -100), list_transform(rt, lambda x: CAST(length(x) AS INT))), lambda x: CAST(x AS VARCHAR)), ' ') AS labels FROM v_pair_tokens""")
def seq_label_mask(spark, sf):
    ids = F.transform(F.concat("pt", "rt"), lambda w: F.length(w).cast("long"))
    labels = Q.labels(ids, F.size("pt"))
    return pair_tokens(spark, sf).select("conv_id", "turn", F.array_join(labels.cast("array<string>"), " ").alias("labels"))


SQL_CUT = SQL_HEX.format(seed="'9|'", id="conv_id * 1000 + turn") + " % greatest(len(t) - 5 - 1, 1) + 1"


@query("seq_view", f"""WITH {V_PAIR_TOKENS}, s AS (SELECT conv_id, turn, list_concat(['<s>'], pt, rt) AS t, len(pt)+1 AS n FROM v_pair_tokens)
  SELECT conv_id, turn, array_to_string(t, ' ') AS whole, array_to_string(list_concat(['<s>'], t[n+1:len(t)]), ' ') AS response, array_to_string(list_concat(['<s>'], t[({SQL_CUT})+1:len(t)]), ' ') AS random FROM s""")
def seq_view(spark, sf):
    bos = F.lit(Q.BOS)
    t, n = F.concat(F.array(bos), "pt", "rt"), F.size("pt") + 1
    rid = F.col("conv_id") * 1000 + F.col("turn")
    view = lambda mode: joined(Q.view(t, n, mode, bos, 9, rid, first=1, spare=5))
    return pair_tokens(spark, sf).select("conv_id", "turn", view("full").alias("whole"), view("partial-response").alias("response"), view("partial-random").alias("random"))


@query("seq_pack_blocks", f"""WITH d AS (SELECT doc_id, {SQL_WORDS.format("text")} AS t FROM documents),
  w AS (SELECT doc_id, unnest(t) AS tok, generate_subscripts(t, 1) AS i FROM d),
  g AS (SELECT tok, row_number() OVER (ORDER BY doc_id, i) - 1 AS p FROM w), n AS (SELECT (count(*) // 127) AS whole FROM g)
  SELECT p // 127 AS block, concat('<s> ', string_agg(tok, ' ' ORDER BY p)) AS tokens FROM g CROSS JOIN n WHERE p // 127 < whole GROUP BY 1""")
def seq_pack_blocks(spark, sf):
    docs = wide_table(spark, sf, "documents").select("doc_id", Q.words(F.col("text")).alias("t"))
    blocks = packed_blocks(docs, "doc_id", "t", 128, bos=Q.BOS)
    return blocks.select("block", joined("tokens").alias("tokens"))


TEMPLATE = "DECISION.IN::: on topic\nDECISION.OUT::: off topic\nDECISION.INVALID::: no language\n------\nTopic: {{topic}}\nText: {{sentence}}\nSay {{DECISION.IN}}, {{DECISION.OUT}} or {{DECISION.INVALID}}: {{DECISION}}"


@query("judge_template_fill", f"""SELECT doc_id, concat({NL}, 'Topic: ', lang, {NL}, 'Text: ', text, {NL}, 'Say on topic, off topic or no language: {{{{DECISION}}}}') AS filled FROM documents""")
def judge_template_fill(spark, sf):
    filled = P.fill_template(F.lit(TEMPLATE), F.col("text"), F.col("lang"))
    return table(spark, sf, "documents").select("doc_id", filled.alias("filled"))
