"""Preference formatting: pairs of conversations with their common beginning rendered once.

The longest common prefix of turns (same role and text) of the chosen and the rejected
conversation is the prompt; what follows in each is its completion, with the character
ranges to learn from: the content and end mark of assistant turns, everything else is
masked.

Defined cases: a null text is an empty turn, a null role is "unknown", a null turn
number sorts first; repeated rows count once; rows without conv_id belong to no
conversation; a conversation without its partner is paired with an empty one; if one
conversation begins the other, its completion is empty; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import bind

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
LEARNED = "assistant"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the ordered distinct turns (role, text) of each conversation; one conversation is one document."""
    one = F.struct(F.col("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_set(one)).alias("t"))
    return rows.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")


def learned(turns: Column) -> Column:
    """Character ranges [start, end) of a rendered text that a model learns from."""
    head = lambda t: F.char_length(t["role"]) + len(OPEN) + len(MIDDLE)
    body = lambda t: F.char_length(t["text"]) + len(CLOSE)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,role:string>>").alias("v"))

    def add(acc: Column, t: Column) -> Column:
        begin = acc["at"] + head(t)
        return F.struct((begin + body(t)).alias("at"), F.concat(acc["v"], F.array(F.struct(begin.alias("start"), (begin + body(t)).alias("end"), t["role"].alias("role")))).alias("v"))

    spans = F.filter(F.aggregate(turns, start, add)["v"], lambda s: s["role"] == LEARNED)
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def common_turns(a: Column, b: Column) -> Column:
    """How many turns two conversations have in common at their beginning."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))  # the longer one meets nulls: not the same
    stop = F.array_position(same, False)
    return F.when(stop > 0, stop - 1).otherwise(F.size(same)).cast("int")


def preference_pairs(turns: DataFrame, pair: Column, is_chosen: Column) -> DataFrame:
    """pair_id, prompt_turns, prompt, chosen, rejected and the learned ranges of both completions.

    ``pair`` and ``is_chosen`` are expressions over conv_id: which pair a conversation belongs to, and on which side.
    """
    packed = conversations(turns).select(pair.alias("pair_id"), is_chosen.alias("side"), "turns")
    none = F.array().cast("array<struct<role:string,text:string>>")
    a = packed.where("side").select("pair_id", F.col("turns").alias("a"))
    b = packed.where("not side").select("pair_id", F.col("turns").alias("b"))
    both = a.join(b, "pair_id", "full").select("pair_id", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    cut = both.withColumn("prompt_turns", common_turns(F.col("a"), F.col("b")))
    rest = lambda c: F.slice(c, F.col("prompt_turns") + 1, F.greatest(F.size(c) - F.col("prompt_turns"), F.lit(0)))
    return cut.select(
        "pair_id",
        "prompt_turns",
        render(F.slice("a", F.lit(1), F.col("prompt_turns"))).alias("prompt"),
        bind(rest(F.col("a")), render).alias("chosen"),
        bind(rest(F.col("b")), render).alias("rejected"),
        bind(rest(F.col("a")), learned).alias("chosen_learned"),
        bind(rest(F.col("b")), learned).alias("rejected_learned"),
    )


def op7_chat_preferences(spark, sf_dir: str) -> DataFrame:
    """Conversation 2k is the chosen and 2k + 1 the rejected one of pair k."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    pairs = preference_pairs(turns, F.floor(F.col("conv_id") / 2), F.pmod("conv_id", F.lit(2)) == 0)
    show = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return pairs.select("pair_id", "prompt_turns", "prompt", "chosen", "rejected", show("chosen_learned").alias("chosen_learned"), show("rejected_learned").alias("rejected_learned"))


CHAT_SQL = """
with t as (select distinct conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations where conv_id is not null),
n as (select conv_id // 2 as pair_id, conv_id % 2 as side, role, text, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from t),
j as (select coalesce(a.pair_id, b.pair_id) as pair_id, coalesce(a.i, b.i) as i, a.role is not distinct from b.role and a.text is not distinct from b.text as same
  from (select * from n where side = 0) a full join (select * from n where side = 1) b on a.pair_id = b.pair_id and a.i = b.i),
k as (select pair_id, coalesce(min(i) filter (not same) - 1, max(i))::int as prompt_turns from j group by pair_id),
r as (select n.*, prompt_turns, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as line, length(role) + 5 as head from n join k using (pair_id)),
s as (select *, coalesce(sum(length(line)) over (partition by pair_id, side order by i rows between unbounded preceding and 1 preceding), 0) as before from r where i > prompt_turns)
select k.pair_id, k.prompt_turns, coalesce((select string_agg(line, '' order by i) from r where r.pair_id = k.pair_id and side = 0 and i <= k.prompt_turns), '') as prompt,
  coalesce(string_agg(line, '' order by i) filter (side = 0), '') as chosen, coalesce(string_agg(line, '' order by i) filter (side = 1), '') as rejected,
  coalesce(string_agg((before + head) || '-' || (before + length(line)), ',' order by i) filter (side = 0 and role = 'assistant'), '') as chosen_learned,
  coalesce(string_agg((before + head) || '-' || (before + length(line)), ',' order by i) filter (side = 1 and role = 'assistant'), '') as rejected_learned
from k left join s using (pair_id) group by k.pair_id, k.prompt_turns"""
