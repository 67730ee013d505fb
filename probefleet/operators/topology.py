"""Topic topology: broker order, replica plans, decisions and checks.

Brokers are rows (cluster_id, broker_id, rack), topics rows (cluster_id, topic, current_partitions, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probefleet import constants as C
from probefleet.functions.lookups import is_dynamic, min_in_sync, replication_factor
from probefleet.functions.payload import encode_payload
from probefleet.operators.chunks import chunk_start, rank_within, running_sums

TOPIC = ("cluster_id", "topic")
_IDS_PER_CHUNK = 65536
_RANKS_PER_CHUNK = 4096
# Broker ids are 32-bit numbers from 0.
_ID_RANGE = 1 << 31
_POSITIONS_PER_PIECE = 256


def latest_roster(snapshots: DataFrame) -> DataFrame:
    """Brokers of each cluster's newest snapshot, one row each."""
    newest = snapshots.groupBy("cluster_id").agg(F.max("snapshot_ms").alias("snapshot_ms"))
    return (
        snapshots.join(newest, ["cluster_id", "snapshot_ms"], "left_semi")
        .groupBy("cluster_id", "broker_id")
        .agg(F.max(F.coalesce("rack", F.lit(""))).alias("rack"))
    )


def rack_completeness(brokers: DataFrame) -> DataFrame:
    """Does every broker of the cluster have a rack? Only then racks count."""
    return brokers.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("brokers"),
        F.count_if(F.col("rack") != "").alias("brokers_with_rack"),
        (F.count_if(F.col("rack") != "") == F.count(F.lit(1))).alias("rack_aware"),
    )


def replication_params(brokers: DataFrame) -> DataFrame:
    n = F.col("brokers")
    return (
        brokers.groupBy("cluster_id")
        .agg(F.count(F.lit(1)).alias("brokers"))
        .select("cluster_id", "brokers", replication_factor(n).alias("rf"), min_in_sync(n).alias("min_isr"))
    )


def _ordered(brokers: DataFrame) -> DataFrame:
    """Brokers with their position and the number of brokers in their cluster.

    With ``k`` the rank of a broker in its rack, brokers stand by k, and among those of the same k by the smallest id
    of their rack.
    """
    rack = F.coalesce("rack", F.lit(""))
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    known = brokers.select(
        "cluster_id", "broker_id", rack.alias("rack"), one.alias("_one"), F.when(rack != "", one).otherwise(none).alias("_known")
    )
    totals = known.groupBy("cluster_id").agg(F.sum("_one").alias("brokers"), F.sum("_known").alias("_racked"))
    grouped = known.join(totals, "cluster_id").select(
        "cluster_id",
        "broker_id",
        "rack",
        "brokers",
        F.when(F.col("_racked") == F.col("brokers"), F.col("rack")).otherwise("").alias("_rack"),
    )
    ranked = rank_within(
        grouped, ["cluster_id", "_rack"], "broker_id", "_k", _IDS_PER_CHUNK, firsts={"_first": "broker_id"}
    )
    # No two brokers of a cluster have the same rank and the same first broker of their rack.
    turn = F.col("_k") * _ID_RANGE + F.col("_first")
    placed = rank_within(ranked.withColumn("_at", turn), ["cluster_id"], "_at", "_position", _RANKS_PER_CHUNK * _ID_RANGE)
    return placed.select("cluster_id", "broker_id", "rack", "brokers", (F.col("_position") - 1).alias("position"))


def broker_order(brokers: DataFrame) -> DataFrame:
    """Position of each broker, from 0: racks take turns in the order of their smallest id.

    Racks count only where every broker of the cluster has one; else brokers stand by id.
    """
    return _ordered(brokers).drop("brokers")


def replica_ring(brokers: DataFrame) -> DataFrame:
    """Replicas that start at each position: the broker there and the next ones, wrapping around.

    Every broker names the (at most three) positions it serves, so a group never exceeds that.
    """
    r, n = F.col("_r"), F.col("brokers")
    served = (
        _ordered(brokers)
        .select("*", F.explode(F.sequence(F.lit(0), replication_factor(n).cast("int") - 1)).alias("_r"))
        .select(
            "cluster_id",
            "brokers",
            F.pmod(F.col("position") - r, n).alias("position"),
            F.struct(r.alias("r"), F.col("broker_id").alias("broker_id"), F.col("rack").alias("rack")).alias("_replica"),
        )
    )
    replicas = F.array_sort(F.collect_list("_replica"))
    return served.groupBy("cluster_id", "brokers", "position").agg(
        F.transform(replicas, lambda x: x["broker_id"]).alias("replicas"),
        F.transform(replicas, lambda x: x["rack"]).alias("racks"),
    )


def planned_partitions(topics: DataFrame, brokers: DataFrame) -> DataFrame:
    """Every planned partition: (columns of topics, partition_id, brokers, replicas, racks of the replicas).

    Topics meet the ring in pieces of a fixed number of positions and multiply only behind the join, so the
    join sees the true sizes of its sides. The outer join and explode let it broadcast the ring but not the
    topics, whose tasks do the multiplying. Position q serves the partitions q, q + n, q + 2n ...
    """
    ring = replica_ring(brokers)
    pieces = ring.groupBy("cluster_id", "brokers", chunk_start(F.col("position"), _POSITIONS_PER_PIECE)).agg(
        F.collect_list(F.struct("position", "replicas", "racks")).alias("_piece")
    )
    # A given number of partitions is not coalesced: the rows are few now, but not what becomes of them.
    spread = int(topics.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n, position = F.col("brokers"), F.col("_at.position")
    wanted = F.greatest(F.col("current_partitions").cast("bigint"), n)
    return (
        topics.repartition(spread, "cluster_id", "topic")
        .join(pieces.select("cluster_id", "brokers", "_piece"), "cluster_id", "left")
        .select(*topics.columns, "brokers", F.explode_outer("_piece").alias("_at"))
        .select(
            *topics.columns,
            F.explode(F.sequence(position, wanted - 1, n)).alias("partition_id"),
            "brokers",
            F.col("_at.replicas").alias("replicas"),
            F.col("_at.racks").alias("racks"),
        )
    )


def plan_replicas(topics: DataFrame, brokers: DataFrame) -> DataFrame:
    """Replica plan in long form; replica 0 leads."""
    return planned_partitions(topics, brokers).select(
        "cluster_id", "topic", "partition_id", F.posexplode("replicas").alias("replica_idx", "broker_id")
    )


def in_partition_order(rows: DataFrame) -> DataFrame:
    """Rows by cluster, topic and partition, and within a partition by replica where there are several."""
    columns = [c for c in ("cluster_id", "topic", "partition_id", "replica_idx") if c in rows.columns]
    return rows.orderBy(*columns)


def decide(topics: DataFrame, sizes: DataFrame) -> DataFrame:
    """What a reconcile does with each topic.

    ``topics`` has expected_size, first_run, topic_error (NULL: fine) and has_config; ``sizes`` (cluster_id, brokers).
    """
    n = F.coalesce(F.col("brokers"), F.lit(0))
    dynamic = is_dynamic(F.col("expected_size"))
    complete = F.col("expected_size") == n
    unknown, fine = F.col("topic_error") == C.UNKNOWN_TOPIC, F.col("topic_error").isNull()
    decision = (
        F.when(unknown & (dynamic | complete), "CREATE")
        .when(unknown, "WAIT_CLUSTER_SIZE")
        .when(fine & (dynamic | (F.col("first_run") & complete)), "REASSIGN")
        .when(fine, "KEEP")
        .otherwise("DESCRIBE_ERROR")
    )
    return (
        topics.join(sizes, "cluster_id", "left")
        .withColumn("brokers", n)
        .withColumn("dynamic", dynamic)
        .withColumn("decision", decision)
        .withColumn("alter_config", F.coalesce(fine & F.col("first_run") & F.col("has_config"), F.lit(False)))
        .withColumn("refresh", (F.col("decision") == "REASSIGN") & (F.col("brokers") != F.col("current_partitions")))
    )


def topology_actions(decided: DataFrame, brokers: DataFrame, current: DataFrame) -> DataFrame:
    """Steps to take: (cluster_id, topic, step, action, partition_id, replicas as text).

    Existing partitions are reassigned (step 1) before new ones are created (step 2). ``current`` holds the
    replicas (cluster_id, topic, partition_id, replicas) of the topics that stay as they are (step 0).
    """
    creating = F.col("decision") == "CREATE"
    changing = decided.where(F.col("decision").isin("CREATE", "REASSIGN")).select(
        "cluster_id",
        "topic",
        "decision",
        F.when(creating, 0).otherwise(F.col("current_partitions")).alias("current_partitions"),
    )
    planned = planned_partitions(changing, brokers)
    existing = F.col("partition_id") < F.col("current_partitions")
    steps = planned.select(
        "cluster_id",
        "topic",
        F.when(creating | existing, 1).otherwise(2).alias("step"),
        F.when(creating, "create_topic").when(existing, "reassign").otherwise("create_partitions").alias("action"),
        "partition_id",
        F.array_join(F.transform("replicas", lambda b: b.cast("string")), ",").alias("replicas"),
    )
    kept = current.join(
        decided.where(F.col("decision") == "KEEP").select("cluster_id", "topic"), ["cluster_id", "topic"], "left_semi"
    ).select(
        "cluster_id",
        "topic",
        F.lit(0).alias("step"),
        F.lit("keep").alias("action"),
        F.col("partition_id").cast("bigint"),
        F.array_join(F.transform("replicas", lambda b: b.cast("string")), ",").alias("replicas"),
    )
    return steps.unionByName(kept)


def orphan_partitions(topics: DataFrame, sizes: DataFrame) -> DataFrame:
    """Existing partitions, flagged where there are more of them than brokers. None is dropped."""
    return (
        topics.join(sizes, "cluster_id", "left")
        .where(F.col("current_partitions") > 0)
        .select(
            "cluster_id",
            "topic",
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("current_partitions").cast("bigint") - 1)).alias(
                "partition_id"
            ),
            F.coalesce("brokers", F.lit(0)).alias("brokers"),
        )
        .withColumn("orphan", F.col("partition_id") >= F.col("brokers"))
    )


def plan_quality(planned: DataFrame) -> DataFrame:
    """Does a topic's plan repeat a broker or a rack in a partition, and how many partitions has its busiest leader?

    ``planned`` has a row for each partition with its replicas and their racks in arrays, as ``planned_partitions`` gives
    them, so repeats show in the row and only leaders are counted across rows. A rack repeats only where it is known.
    """
    known = F.filter("racks", lambda rack: rack != "")
    rows = planned.select(
        "cluster_id",
        "topic",
        F.get("replicas", F.lit(0)).alias("_leader"),
        (F.size("replicas") > F.size(F.array_distinct("replicas"))).alias("_broker"),
        (F.size(known) > F.size(F.array_distinct(known))).alias("_rack"),
    )
    led = rows.groupBy("cluster_id", "topic", "_leader").agg(
        F.max("_broker").alias("_broker"), F.max("_rack").alias("_rack"), F.count(F.lit(1)).alias("_led")
    )
    return led.groupBy("cluster_id", "topic").agg(
        F.max("_broker").alias("dup_broker"), F.max("_rack").alias("dup_rack"), F.max("_led").alias("max_leaders")
    )


def leader_mismatch(topic_leaders: DataFrame, client_leaders: DataFrame) -> DataFrame:
    """Do both sides know the same leader for the same partitions of a topic?"""
    nothing = F.lit(None).cast("bigint")
    zero, one = F.lit(0), F.lit(1)

    def side(df, here, there):
        return df.select(
            *TOPIC, "partition_id", F.col("leader").cast("bigint").alias(here), nothing.alias(there),
            one.alias(f"_has_{here}"), zero.alias(f"_has_{there}"),
        )

    pairs = (
        side(topic_leaders, "a", "b")
        .unionByName(side(client_leaders, "b", "a"))
        .groupBy(*TOPIC, "partition_id")
        .agg(F.max("a").alias("a"), F.max("b").alias("b"), F.max("_has_a").alias("ha"), F.max("_has_b").alias("hb"))
    )
    same = F.col("a").eqNullSafe(F.col("b")) & (F.col("ha") == F.col("hb"))
    return pairs.groupBy(*TOPIC).agg(F.bool_or(~same).alias("mismatch"))


def leader_election_needed(partitions: DataFrame, sizes: DataFrame) -> DataFrame:
    """With as many partitions as brokers, is any partition led by another broker than its own?

    ``sizes`` has (cluster_id, topic, brokers). Without a known size there is nothing to elect.
    """
    led = partitions.groupBy(*TOPIC).agg(
        F.count(F.lit(1)).alias("_partitions"), F.bool_or(F.col("partition_id") != F.col("leader")).alias("_moved")
    )
    elect = (F.col("_partitions") == F.col("brokers")) & F.col("_moved")
    return led.join(sizes, [*TOPIC], "left").select(*TOPIC, F.coalesce(elect, F.lit(False)).alias("elect_leader"))


def reassignment_ongoing(status: DataFrame) -> DataFrame:
    """Is any partition of the topic still adding or removing replicas?"""
    return status.groupBy(*TOPIC).agg(F.bool_or((F.size("adding") > 0) | (F.size("removing") > 0)).alias("ongoing"))


#: Partitions of a topic that share one row, one bit each, and their number as a power of two.
ROW_BITS, ROW_POWER = 64, 6


def _partition_bit() -> tuple[Column, Column]:
    """The row of bits that a partition_id is in, and its bit there. A null is the only partition of a row of its own."""
    number = F.col("partition_id").cast("bigint")
    place = F.coalesce(F.pmod(number, F.lit(ROW_BITS)), F.lit(0)).cast("int")
    return F.shiftright(number, ROW_POWER).alias("_row"), F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


def _partition_bits(expected: DataFrame, consumed: DataFrame) -> DataFrame:
    """Expected and seen partitions as bits: (cluster_id, topic, _row, _expected, _seen).

    Consumed rows are reduced before they travel, to a row of bits for each ROW_BITS partitions of a topic.
    """
    row, bit = _partition_bit()
    none = F.lit(0).cast("bigint")
    marks = expected.select(*TOPIC, row, bit.alias("_expected"), none.alias("_seen")).unionByName(
        consumed.select(*TOPIC, row, none.alias("_expected"), bit.alias("_seen"))
    )
    return marks.groupBy(*TOPIC, "_row").agg(F.bit_or("_expected").alias("_expected"), F.bit_or("_seen").alias("_seen"))


def partition_coverage(expected: DataFrame, consumed: DataFrame) -> DataFrame:
    """Expected partitions of a topic and how many of them had a record; records of other partitions do not count."""
    wanted, seen = F.col("_expected"), F.col("_expected").bitwiseAND(F.col("_seen"))
    return (
        _partition_bits(expected, consumed)
        .where(wanted != 0)
        .groupBy(*TOPIC)
        .agg(
            F.sum(F.bit_count(wanted).cast("bigint")).alias("expected"),
            F.sum(F.bit_count(seen).cast("bigint")).alias("seen"),
            F.bool_and(wanted == seen).alias("covered"),
        )
    )


def unconsumed_partitions(expected: DataFrame, consumed: DataFrame) -> DataFrame:
    """Expected partitions without any record."""
    row, bit = _partition_bit()
    seen = consumed.where(F.col("partition_id").isNotNull()).groupBy(*TOPIC, row).agg(F.bit_or(bit).alias("_seen"))
    wanted = expected.select("*", row, bit.alias("_bit")).join(seen, [*TOPIC, "_row"], "left")
    missed = F.coalesce(F.col("_seen"), F.lit(0)).bitwiseAND(F.col("_bit")) == 0
    return wanted.where(missed).select(*expected.columns)


def generate_round(plan_sizes: DataFrame, width: int = 1 << 32) -> DataFrame:
    """One message for each partition 0 .. partitions - 1 at each tick of a client.

    ``plan_sizes`` has (cluster_id, client_id, tick, partitions), one row per round, and may have started_ms, the start
    of the client's process. Message numbers run on through the rounds of a process, starting at 1.
    """
    client = [c for c in ("cluster_id", "client_id", "started_ms") if c in plan_sizes.columns]
    upto = running_sums(plan_sizes, client, "tick", {"_upto": "partitions"}, width)
    messages = upto.where(F.col("partitions") > 0).select(
        *client,
        "tick",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("partitions") - 1)).alias("partition"),
        (F.col("_upto") - F.col("partitions")).alias("_before"),
    )
    number = F.col("_before") + F.col("partition") + 1
    return messages.select(
        *client,
        "tick",
        "partition",
        number.alias("message_id"),
        encode_payload(F.col("client_id"), number, F.col("tick")).alias("payload"),
    )
