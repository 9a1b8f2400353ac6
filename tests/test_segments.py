"""Segment states merge to what the whole conversation gives, wherever it is cut."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from convolens.functions import patterns as P
from convolens.operators import features as FT
from convolens.operators.segments import CUTS, SEGMENT, Cuts, cuts_of, hot_keys, merge_states, split_states
from convolens.sources import adapters as A

SCHEMA = "cleaned_phone string, src_ord int, creation_time timestamp, msg_from string, message string"
T0 = datetime(2024, 1, 4)
TEXTS = [A.BOT_INVITE, A.BOT_OFFER, A.BOT_TRANSFER, A.BOT_RECEIVED, A.BOT_PREVALIDATION, A.USER_YES_WANT, A.USER_NO_THANKS,
         "No pierdas la oportunidad", "hola, soy Ana", "texto", None, P.RECOVERY_TEMPLATE_PHRASES[0]]
SPECS = [*FT.chain(FT.DEFAULT_CHAIN), FT.TransferContext(), FT.Recency(), FT.LastTimes(), FT.FollowUps(), FT.LeadName(), FT.Digest()]


def conversations(n=40, seed=1):
    rng, rows = random.Random(seed), []
    for k in range(n):
        for i in range(rng.randint(1, 14)):
            when = None if rng.random() < 0.02 else T0 + timedelta(minutes=rng.randint(0, 12))
            rows.append((f"p{k}", i, when, rng.choice(["bot", "bot", "user", "operator", None]), rng.choice(TEXTS)))
    return rows


def by_key(df, key="cleaned_phone"):
    names = sorted(c for c in df.columns if c != key)
    return {r[key]: tuple(str(r[c]) for c in names) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_any_cuts_give_the_whole_fold(spark, seed):
    rows = conversations(seed=seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    whole = by_key(FT.conversation_features(df, SPECS, cuts=Cuts()))
    rng = random.Random(seed)
    cuts = Cuts(tuple((f"p{k}", sorted({T0 + timedelta(minutes=rng.randint(0, 13)) for _ in range(rng.randint(1, 9))})) for k in range(30)))
    assert len(whole) == 40 and by_key(FT.conversation_features(df, SPECS, cuts=cuts)) == whole


def test_split_states_keep_the_last_apart(spark):
    df = spark.createDataFrame(conversations(seed=9), SCHEMA).where("creation_time is not null")
    merges = FT.state_merges(SPECS)
    states = FT.segment_states(df.withColumn(SEGMENT, F.minute("creation_time")), SPECS)
    split = split_states(states, merges, "cleaned_phone", SEGMENT)
    assert by_key(split.select("cleaned_phone", "whole.*")) == by_key(merge_states(states, merges, ["cleaned_phone"], SEGMENT))
    last = states.groupBy("cleaned_phone").agg(F.max(SEGMENT).alias(SEGMENT))
    assert by_key(split.select("cleaned_phone", SEGMENT, "last.*")) == by_key(states.join(last, ["cleaned_phone", SEGMENT]))
    alone = states.groupBy("cleaned_phone").count().where("count = 1").count()
    assert split.where("before is null").count() == alone > 0


def test_merging_is_associative(spark):
    df = spark.createDataFrame(conversations(seed=4), SCHEMA).where("creation_time is not null")
    merges = FT.state_merges(SPECS)
    segment = F.floor(F.minute("creation_time") / 2).cast("int")
    states = FT.segment_states(df.withColumn(SEGMENT, segment), SPECS)
    flat = merge_states(states, merges, ["cleaned_phone"], SEGMENT)
    pairs = merge_states(states.withColumn("pair", F.floor(F.col(SEGMENT) / 3)), merges, ["cleaned_phone", "pair"], SEGMENT)
    assert by_key(merge_states(pairs, merges, ["cleaned_phone"], "pair")) == by_key(flat)


def test_hot_keys_are_found_and_cut(spark):
    df = spark.range(20_000).select(
        F.when(F.col("id") % 5 < 3, "hot").when(F.col("id") % 5 == 3, "warm").otherwise(F.col("id").cast("string")).alias("k"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id")).alias("t"))
    assert dict(hot_keys(df, "k", 3_000)) == {"hot": 12_000, "warm": 4_000}
    cuts = cuts_of(df, "k", "t", least=3_000, rows=1_000)
    assert {k: len(c) for k, c in cuts.rows} == {"hot": 11, "warm": 11} and len(cuts.rows[0][1]) <= CUTS
    sizes = cuts.assign(df, "k", "t").groupBy("k", SEGMENT).count()
    assert sizes.agg(F.max("count")).first()[0] < 1_500
    order = cuts.assign(df, "k", "t").where("k = 'hot'").groupBy(SEGMENT).agg(F.min("t").alias("a"), F.max("t").alias("b")).orderBy(SEGMENT).collect()
    assert len(order) == 12 and all(x.b < y.a for x, y in zip(order, order[1:]))
    assert cuts_of(df, "k", "t") == Cuts() and cuts_of(df.limit(0), "k", "t", least=1) == Cuts()


def test_a_feature_without_merges_is_never_cut(spark):
    class Longest(FT.Feature):
        name, alias, columns = "LongestFeature", "longest", [("longest", None)]

        def anchors(self, m):
            return {f"{self.prefix}n": F.max(F.length(m.text))}

        def aggregates(self, m):
            return {f"{self.prefix}first": F.min_by(m.text, F.when(F.length(m.text) == F.col(f"{self.prefix}n"), m.ord))}

        def outputs(self, a, prior, as_of):
            return {"longest": a("first")}

    df = spark.createDataFrame(conversations(seed=6), SCHEMA)
    assert FT.state_merges([Longest()]) is None
    got = FT.conversation_features(df, [Longest()], cuts=Cuts((("p1", [T0]),)))
    longest = {}
    for p, i, t, _, text in conversations(seed=6):
        longest.setdefault(p, []).append((-len(text or ""), t is not None, t or T0, i, text or ""))
    assert {r.cleaned_phone: r.longest for r in got.collect()} == {p: min(v)[-1] for p, v in longest.items()}
