"""Configurations of a fleet: rows (client_id, key, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probefleet import constants as C
from probefleet.functions.keyvalue import pairs_map, parse_bounds, parse_pairs
from probefleet.functions.lookups import bool_value, int_value, min_in_sync
from probefleet.operators.chunks import last_before

_DEFAULTS = {key: default for key, _, default in C.CONFIG_KEYS}


def wide_config(config: DataFrame, keys: Sequence[str], clients: DataFrame | None = None) -> DataFrame:
    """One row per client with a text column ``set_<key>`` per key; NULL where a client does not set it.

    A client without any known key has a row too. ``clients`` (client_id) adds those that set nothing at all.
    """
    number = F.array_position(F.array(*map(F.lit, keys)), F.col("key")).cast("int")
    named = config.select("client_id", number.alias("_number"), "value")
    if clients is not None:
        named = named.unionByName(clients.select("client_id", F.lit(0).alias("_number"), F.lit(None).cast("string").alias("value")))
    # Rows travel to their client as they are. The greatest text is found by sorting, and before they travel, that would sort
    # all rows of a file in the task that reads it.
    dealt = named.repartition("client_id")
    return dealt.groupBy("client_id").agg(
        *[F.max(F.when(F.col("_number") == i, F.col("value"))).alias(f"set_{key}") for i, key in enumerate(keys, 1)]
    )


def _text(key: str) -> Column:
    return F.coalesce(F.col(f"set_{key}"), F.lit(_DEFAULTS[key]))


def typed_config(
    config: DataFrame, spec: Sequence[tuple[str, str, str]] = C.CONFIG_KEYS, clients: DataFrame | None = None
) -> DataFrame:
    """One row per client with a typed column for each key of ``spec`` (key, type, default).

    Columns have the keys' names in lower case; CLIENT_ID is ``own_client_id``, as ``client_id`` names the row.
    """

    def typed(key: str, kind: str, default: str) -> Column:
        given = F.col(f"set_{key}")
        text = F.coalesce(given, F.lit(default))
        if kind == "int":
            return int_value(given, int(default))
        if kind == "bool":
            return bool_value(given, default in C.TRUE_WORDS)
        if kind == "list":
            return F.split(text, ",", -1)
        if kind == "buckets":
            return parse_bounds(text)["bounds"]
        if kind == "map":
            return pairs_map(text)
        return text

    names = {"CLIENT_ID": "own_client_id"}
    wide = wide_config(config, [key for key, _, _ in spec], clients)
    return wide.select("client_id", *[typed(*entry).alias(names.get(entry[0], entry[0].lower())) for entry in spec])


def pair_rows(config: DataFrame) -> DataFrame:
    """Key-value strings in long form; an invalid string gives one row without a pair."""
    parsed = config.withColumn("_parsed", parse_pairs(F.col("value")))
    return parsed.select(
        "client_id",
        F.col("key").alias("config_key"),
        F.col("_parsed.is_valid").alias("is_valid"),
        F.explode_outer("_parsed.pairs").alias("_pair"),
    ).select("client_id", "config_key", "is_valid", "_pair.key", "_pair.value")


def bound_rows(config: DataFrame) -> DataFrame:
    """Bucket strings in long form; an invalid string gives one row without a bound."""
    parsed = config.withColumn("_parsed", parse_bounds(F.col("value")))
    return parsed.select(
        "client_id",
        F.col("key").alias("config_key"),
        F.col("_parsed.is_valid").alias("is_valid"),
        F.posexplode_outer("_parsed.bounds").alias("idx", "bound"),
    )


def redact_config(config: DataFrame, clients: DataFrame | None = None) -> DataFrame:
    """The printed form of each client's configuration: (client_id, key, shown).

    Numbers and switches are shown as they are understood: 0 for a text that is no number, false for anything but a word
    for true. Other values are shown as given, or their defaults. Certificates and keys become placeholders. User and
    password do so under PLAIN, else they are blank.
    """
    keys = [key for key, _, _ in C.CONFIG_KEYS]
    kinds = {key: kind for key, kind, _ in C.CONFIG_KEYS}
    plain = _text("SASL_MECHANISM") == "PLAIN"

    def shown(key: str) -> Column:
        mark = C.SECRET_PLACEHOLDERS.get(key)
        if mark is None and kinds[key] == "int":
            return int_value(F.col(f"set_{key}"), int(_DEFAULTS[key])).cast("string")
        if mark is None and kinds[key] == "bool":
            return bool_value(F.col(f"set_{key}"), _DEFAULTS[key] in C.TRUE_WORDS).cast("string")
        if mark is None:
            return _text(key)
        visible = _text(key) != ""
        if key.startswith("SASL_"):
            visible = visible & plain
        return F.when(visible, mark).otherwise("")

    rows = [
        F.struct(F.lit(key).alias("key"), shown(key).alias("shown")) for key in keys if key not in C.UNPRINTED_KEYS
    ]
    return wide_config(config, keys, clients).select("client_id", F.inline(F.array(*rows)))


def dynamic_config_text(log_enabled: Column, verbosity: Column) -> Column:
    """Display text of a dynamic configuration; absent fields are left out."""
    log_name, verbosity_name = C.DYNAMIC_DISPLAY
    return F.concat(
        F.lit("{"),
        F.concat_ws(
            ", ",
            F.concat(F.lit(f"{log_name}:"), log_enabled.cast("string")),
            F.concat(F.lit(f"{verbosity_name}:"), verbosity.cast("string")),
        ),
        F.lit("}"),
    )


def dynamic_texts(snapshots: DataFrame) -> DataFrame:
    """Adds ``shown``, the display text of each file that parses, to rows (path, poll_ms, exists, content)."""
    fields = f"{C.DYNAMIC_FIELDS}, _bad STRING"
    parsed = F.from_json("content", fields, {"columnNameOfCorruptRecord": "_bad"})
    read = snapshots.where("exists").withColumn("_read", parsed).where("_read IS NOT NULL AND _read._bad IS NULL")
    text = dynamic_config_text(F.col("_read.saramaLogEnabled"), F.col("_read.verbosityLogLevel"))
    return read.withColumn("shown", text).drop("_read")


def lint_config(config: DataFrame, clients: DataFrame | None = None) -> DataFrame:
    """Rules that each client's configuration must keep: (client_id, rule, ok)."""
    keys = [key for key, _, _ in C.CONFIG_KEYS]
    mechanism = _text("SASL_MECHANISM")
    off = mechanism == ""
    rules = {
        "sasl_mechanism": off | mechanism.isin(*C.SASL_MECHANISMS),
        "sasl_user": ~mechanism.isin(*C.SASL_MECHANISMS) | (_text("SASL_USER") != ""),
        "sasl_password": ~mechanism.isin(*C.SASL_MECHANISMS) | (_text("SASL_PASSWORD") != ""),
        "tracing_exporter": _text("EXPORTER_TYPE_TRACING").isin(*C.TRACING_EXPORTERS),
        "topic_config": parse_pairs(_text("TOPIC_CONFIG"))["is_valid"],
        "constant_labels": parse_pairs(_text("PROMETHEUS_CONSTANT_LABELS"))["is_valid"],
        "producer_buckets": parse_bounds(_text("PRODUCER_LATENCY_BUCKETS"))["is_valid"],
        "endtoend_buckets": parse_bounds(_text("ENDTOEND_LATENCY_BUCKETS"))["is_valid"],
        "connection_buckets": parse_bounds(_text("CONNECTION_CHECK_LATENCY_BUCKETS"))["is_valid"],
    }
    rows = [F.struct(F.lit(rule).alias("rule"), ok.alias("ok")) for rule, ok in rules.items()]
    return wide_config(config, keys, clients).select("client_id", F.inline(F.array(*rows)))


def merge_topic_config(topics: DataFrame) -> DataFrame:
    """Configuration entries of topics: (cluster_id, topic, key, value).

    ``topics`` has (cluster_id, topic, topic_config text, brokers, decision). On creation two entries are forced; an
    existing topic gets the user's entries only.
    """
    user = F.coalesce(pairs_map(F.col("topic_config")), F.create_map().cast("map<string,string>"))
    forced = F.create_map(
        F.lit(C.MIN_ISR_KEY),
        min_in_sync(F.col("brokers")).cast("string"),
        F.lit(C.CLEANUP_KEY),
        F.lit(C.CLEANUP_POLICY),
    )
    free = F.map_filter(user, lambda k, _: ~F.map_contains_key(forced, k))
    entries = F.when(F.col("decision") == "CREATE", F.map_concat(free, forced)).otherwise(user)
    return topics.select("cluster_id", "topic", F.explode(entries))


def config_changes(snapshots: DataFrame, width: int = 30000 * 4096, ties: Sequence[str] = ()) -> DataFrame:
    """Changes of polled files: (path, poll_ms, event, hash), event ``apply`` or ``default``.

    ``snapshots`` has (path, poll_ms, exists, content). A file that does not parse is ignored. A file is
    applied when its hash differs from the last one applied, even if it was gone in between; a file that
    disappears brings the defaults back once.
    """
    ties = list(ties)
    fields = f"{C.DYNAMIC_FIELDS}, _bad STRING"
    parsed = F.from_json("content", fields, {"columnNameOfCorruptRecord": "_bad"})
    readable = F.col("exists") & parsed.isNotNull() & parsed["_bad"].isNull()
    polls = snapshots.select(
        "path",
        "poll_ms",
        *ties,
        "exists",
        F.when(readable, F.sha2("content", 256)).alias("hash"),
    )
    known = last_before(polls, ["path"], "poll_ms", {"_hash": "hash", "_existed": "exists"}, width, ties)
    gone = ~F.col("exists") & F.coalesce("_existed", F.lit(False))
    changed = F.col("hash").isNotNull() & ~F.col("hash").eqNullSafe(F.col("_hash"))
    event = F.when(changed, "apply").when(gone, "default")
    return known.select(
        "path", "poll_ms", *ties, event.alias("event"), F.when(changed, F.col("hash")).alias("hash")
    ).where(F.col("event").isNotNull())

