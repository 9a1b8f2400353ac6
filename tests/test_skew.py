"""A conversation holding most of the rows: the feature fold cuts it into
bounded segments, and joins on it are split."""

from collections import Counter

from pyspark.sql import functions as F

from convolens.operators import features as FT
from convolens.operators.features import order_key
from convolens.operators.messages import for_targets
from convolens.operators.prefix import PLACE, with_prefix
from convolens.operators.segments import SEGMENT, cuts_of
from convolens.operators.transcript import PLAIN, conversation_chunks, conversation_digest, conversation_text


def test_hot_key_is_split_and_results_match(spark):
    conf = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        n = 40000
        base = spark.range(n).select(
            F.when(F.col("id") % 10 < 7, F.lit("5500000001")).otherwise((F.col("id") % 500 + 5500001000).cast("string"))
            .alias("cleaned_phone"),
            F.col("id").cast("int").alias("src_ord"),
            F.timestamp_seconds(F.lit(1704067200) + F.col("id")).alias("creation_time"),
            F.when(F.col("id") % 3 == 0, "user").otherwise("bot").alias("msg_from"),
            F.when(F.col("id") % 97 == 0, "No pierdas la oportunidad").otherwise(F.lit("texto")).alias("message"),
        ).repartition(16)
        cuts = cuts_of(base, least=10_000, rows=2_000)
        assert [k for k, _ in cuts.rows] == ["5500000001"]
        out = FT.conversation_features(base, [FT.Handoff(), FT.Template()], cuts=cuts)
        rows = {r.cleaned_phone: r for r in out.collect()}
        sizes = [r["count"] for r in cuts.assign(base, "cleaned_phone").groupBy("cleaned_phone", SEGMENT).count().collect()]
        assert max(sizes) < 4_000  # no task gets the hot conversation whole
        hot = rows["5500000001"]
        assert hot.handoff_invitation_detected is True
        assert len(rows) == 1 + len({i % 500 for i in range(n) if i % 10 >= 7})
        # "texto" answers neither way; the last row of every conversation is no template
        hot_ids = [i for i in range(n) if i % 10 < 7]
        first_invite = min(i for i in hot_ids if i % 97 == 0 and i % 3 != 0)
        reply = min(i for i in hot_ids if i % 3 == 0 and i > first_invite)
        assert reply % 97 != 0 and hot.handoff_response == "UNCLEAR_RESPONSE"
        assert hot.handoff_finalized is False and hot.consecutive_recovery_templates_count == 0
        digest = {r.cleaned_phone: r for r in conversation_digest(base).collect()}
        assert digest["5500000001"].n_messages == len(hot_ids)
        assert digest["5500000001"].conversation_digest == conversation_digest(
            base.where("cleaned_phone = '5500000001'").orderBy(F.desc("creation_time"))).first().conversation_digest
        text = conversation_text(base, style=PLAIN).where("cleaned_phone = '5500000001'").first()
        lines = text.conversation_text.split("\n")
        assert len(lines) == len(hot_ids) and lines == sorted(lines)

        # chunks of the hot conversation (one day holds it) stay under the budget
        chunks, sums = conversation_chunks(base, style=PLAIN, budget=5_000)
        own = chunks.where("cleaned_phone = '5500000001'").orderBy("chunk_no").collect()
        assert max(len(r.text.encode()) for r in own) <= 5_000 and len(own) > 200
        assert [r.chunk_no for r in own] == list(range(len(own))) and "".join(r.text for r in own) == text.conversation_text
        total = sums.where("cleaned_phone = '5500000001'").first()
        assert (total.n_messages, total.n_bytes, total.n_chunks) == (len(hot_ids), len(text.conversation_text), len(own))

        # the place of a message: the hot day lies in several stretches
        order = order_key(base.columns)
        placed, _ = with_prefix(base, "cleaned_phone", order, {"n": F.lit(1).cast("long")}, partitions=16)
        hot_rows = placed.where("cleaned_phone = '5500000001'").withColumn("stretch", F.shiftright(PLACE, 33)).collect()
        assert [r.src_ord for r in sorted(hot_rows, key=lambda r: r.n)] == hot_ids and sorted(r.n for r in hot_rows) == list(range(len(hot_ids)))
        shares = Counter(r.stretch for r in hot_rows)
        assert len(shares) >= 8 and max(shares.values()) < len(hot_ids) / 4

        # the semi-join with the targets is split on the hot phone
        targets = spark.createDataFrame([("5500000001",), ("5500001003",), ("5500000001",), (None,), (" ",)], "cleaned_phone string")
        met = for_targets(base, targets)
        assert met.count() == len(hot_ids) + sum(i % 500 == 3 for i in range(n) if i % 10 >= 7)
        met.write.format("noop").mode("overwrite").save()
        plan = met._jdf.queryExecution().executedPlan()
        met.collect()
        assert "skew=true" in plan.toString()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
