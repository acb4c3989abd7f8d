"""Preference formatting of chosen and rejected conversations.

The longest common prefix of turns is rendered once as the prompt; what follows on either side is that side's
completion, with the character spans that carry loss (the assistant's words and their closing mark).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

OPEN, CLOSE = "<|", "|>"
END = "<|end|>\n"


def _head(turn):
    return F.concat(F.lit(OPEN), turn["role"], F.lit(CLOSE + "\n"))


def _rendered(turn):
    return F.concat(_head(turn), turn["text"], F.lit(END))


def conversations(turns: DataFrame) -> DataFrame:
    """One row (conv_id, turns) for each conversation, turns in order.

    Null roles and texts count as empty. Rows equal in all of turn, role and text are one turn; rows that share
    the number only follow one another by role and text. Rows without a conv_id belong to no conversation.
    A conversation is one rendered text, so its turns have to fit in a task. An empty table gives no conversations;
    other columns are not read.
    """
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return turns.where("conv_id is not null").select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_set("t")).alias("turns"))


def format_preferences(pairs: DataFrame) -> DataFrame:
    """From rows with array columns ``chosen`` and ``rejected`` of struct<turn, role, text>.

    Adds n_prompt_turns, prompt, chosen_completion, rejected_completion and, for each completion, its ``mask``:
    an array of struct<start, end> in characters (end is exclusive) that hold assistant words with the closing
    mark; all else is masked. Turns are equal if role and text are. If one side is a prefix of the other, or both
    are equal, its completion is empty, with an empty mask.
    """
    shorter = F.least(F.size("chosen"), F.size("rejected"))
    differs = F.filter(
        F.sequence(F.lit(0), shorter - 1),
        lambda i: (F.col("chosen")[i]["role"] != F.col("rejected")[i]["role"]) | (F.col("chosen")[i]["text"] != F.col("rejected")[i]["text"]),
    )
    common_turns = F.when(shorter == 0, F.lit(0)).otherwise(F.coalesce(F.try_element_at(differs, F.lit(1)), shorter))
    done = pairs.withColumn("n_prompt_turns", common_turns)
    n = F.col("n_prompt_turns")

    def rest(side: str):
        return F.slice(F.col(side), n + 1, F.size(side))

    def text(turns):
        return F.array_join(F.transform(turns, _rendered), "")

    def mask(turns):
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

        def step(acc, turn):
            begin = acc["at"] + F.length(_head(turn))
            end = acc["at"] + F.length(_rendered(turn))
            span = F.array(F.struct(begin.alias("start"), end.alias("end")))
            spans = F.when(turn["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"])
            return F.struct(end.alias("at"), spans.alias("spans"))

        return F.aggregate(turns, start, step, lambda acc: acc["spans"])

    return done.withColumns(
        {
            "prompt": text(F.slice(F.col("chosen"), F.lit(1), n)),
            "chosen_completion": text(rest("chosen")),
            "rejected_completion": text(rest("rejected")),
            "chosen_mask": mask(rest("chosen")),
            "rejected_mask": mask(rest("rejected")),
        }
    )


def _spans(mask: str):
    return F.array_join(F.transform(mask, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation 2i is the chosen answer and 2i + 1 the rejected one of pair i; a half without its other is left out."""
    whole = conversations(common.table(spark, sf_dir, "conversations"))
    side = F.struct("conv_id", "turns")
    pair = F.floor(F.col("conv_id") / 2).cast("long")
    sides = whole.groupBy(pair.alias("pair_id")).agg(
        F.max(F.when(F.pmod("conv_id", F.lit(2)) == 0, side)).alias("c"),
        F.max(F.when(F.pmod("conv_id", F.lit(2)) == 1, side)).alias("r"),
    )
    pairs = sides.where("c is not null and r is not null").select("pair_id", F.col("c.conv_id").alias("chosen_id"), F.col("r.conv_id").alias("rejected_id"), F.col("c.turns").alias("chosen"), F.col("r.turns").alias("rejected"))
    return format_preferences(pairs).select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"),
        "prompt",
        "chosen_completion",
        "rejected_completion",
        _spans("chosen_mask").alias("chosen_mask"),
        _spans("rejected_mask").alias("rejected_mask"),
    )


OP10_SQL = """
with t as (select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
n as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as k, count(*) over (partition by conv_id) as size from t),
pair as (select distinct a.conv_id // 2 as pair_id, a.conv_id as chosen_id, b.conv_id as rejected_id from n a join n b on b.conv_id = a.conv_id + 1 where a.conv_id % 2 = 0),
first_diff as (
  select p.pair_id, min(c.k) as k from pair p join n c on c.conv_id = p.chosen_id join n r on r.conv_id = p.rejected_id and r.k = c.k
  where c.role <> r.role or c.text <> r.text group by 1),
cut as (
  select p.*, coalesce(f.k - 1, least((select max(size) from n where conv_id = p.chosen_id), (select max(size) from n where conv_id = p.rejected_id))) as keep
  from pair p left join first_diff f using (pair_id)),
r as (select *, '<|' || role || '|>' || chr(10) as head, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as body from n),
prompts as (select c.pair_id, string_agg(r.body, '' order by r.k) as prompt from cut c join r on r.conv_id = c.chosen_id and r.k <= c.keep group by 1),
late as (
  select c.pair_id, r.conv_id, r.k, r.role, r.head, r.body, coalesce(sum(length(r.body)) over (partition by r.conv_id order by r.k rows between unbounded preceding and 1 preceding), 0) as ahead
  from cut c join r on r.conv_id in (c.chosen_id, c.rejected_id) and r.k > c.keep),
done as (
  select conv_id, string_agg(body, '' order by k) as completion,
         string_agg(case when role = 'assistant' then (ahead + length(head))::bigint::varchar || '-' || (ahead + length(body))::bigint::varchar end, ',' order by k) as mask
  from late group by 1)
select c.pair_id::bigint as pair_id, c.chosen_id, c.rejected_id, c.keep::bigint as n_prompt_turns, coalesce(p.prompt, '') as prompt,
       coalesce(a.completion, '') as chosen_completion, coalesce(b.completion, '') as rejected_completion,
       coalesce(a.mask, '') as chosen_mask, coalesce(b.mask, '') as rejected_mask
from cut c left join prompts p using (pair_id) left join done a on a.conv_id = c.chosen_id left join done b on b.conv_id = c.rejected_id
"""
