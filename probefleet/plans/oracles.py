"""SQL for DuckDB that computes what each query must give, from the same tables."""

from __future__ import annotations

from probefleet import constants as C
from probefleet.plans import fixtures as fx

HOUR, DAY = fx.HOUR_MS, fx.DAY_MS


def _text(value) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_text(v) if v is None or isinstance(v, str) else str(v) for v in values) + "]"


def _pick(values, index: str) -> str:
    """Entry of a list by an index modulo its length; DuckDB lists start at 1."""
    return f"({_list(values)})[CAST({index} % {len(values)} AS BIGINT) + 1]"


PAYLOAD = (
    "'{\"producerId\":\"' || client_id || '\",\"messageId\":' || event_id || ',\"timestamp\":' || ms || '}'"
)

# Derived tables: name -> (what it needs, body).
TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "probes": (
        (),
        """SELECT event_id, user_id, event_type, 'cluster-' || (user_id % 2) AS cluster_id,
        'client-' || (user_id % 5) AS client_id, user_id % 3 AS partition, epoch_us(ts) // 1000 AS ms,
        CAST(floor(value) AS BIGINT) AS lat FROM events""",
    ),
    "attempts": (
        ("probes",),
        """SELECT cluster_id, client_id, partition, event_id AS message_id, ms AS create_ms, ms + lat AS ack_ms,
        CASE WHEN event_type = 'error' THEN 'timeout' END AS error,
        CASE WHEN event_type <> 'error' THEN lat END AS latency_ms FROM probes""",
    ),
    "records": (
        ("probes",),
        f"""SELECT cluster_id, client_id, partition, event_id AS "offset", ms, lat,
        CASE WHEN lat = 20 THEN substr({PAYLOAD}, 1, 20) ELSE {PAYLOAD} END AS value,
        ms + CASE WHEN lat < 1 THEN -3 ELSE 2 * lat END + again AS recv_ms
        FROM (SELECT *, unnest(CASE WHEN lat >= 150 THEN [0, 1000] ELSE [0] END) AS again FROM probes
              WHERE event_type <> 'error' AND NOT lat BETWEEN 40 AND 41)""",
    ),
    "decoded": (
        ("records",),
        """SELECT *, NOT ok AS is_malformed,
        CASE WHEN ok THEN json_extract_string(value, '$.producerId') ELSE '' END AS producer_id,
        CASE WHEN ok THEN CAST(json_extract(value, '$.messageId') AS BIGINT) ELSE 0 END AS message_id,
        recv_ms - CASE WHEN ok THEN CAST(json_extract(value, '$.timestamp') AS BIGINT) ELSE 0 END AS latency_ms,
        CASE WHEN ok THEN CAST(json_extract(value, '$.timestamp') AS BIGINT) ELSE 0 END AS sent_ms
        FROM (SELECT *, json_valid(value) AS ok FROM records)""",
    ),
    "checks": (
        ("probes",),
        """SELECT cluster_id, user_id % 12 AS broker_id, ms AS check_ms, event_type <> 'error' AS connected,
        lat AS duration_ms FROM probes""",
    ),
    "lines": (
        ("probes",),
        """SELECT event_id, 'I0101 00:00:00.000000       1 ' || CASE
        WHEN lat = 7 THEN 'consumer.go:10] Consumer refreshing metadata'
        WHEN event_type IN ('click', 'view') THEN 'producer.go:10] Message sent: partition=' || partition
             || ', offset=' || event_id || ', duration=' || lat || ' ms'
        WHEN event_type = 'purchase' THEN 'consumer.go:10] Message received: value={ProducerID:' || client_id
             || ' MessageID:' || event_id || ' Timestamp:' || ms || '}, partition=' || partition
             || ', offset=' || event_id || ', duration=' || CASE WHEN lat < 1 THEN -3 ELSE 2 * lat END || ' ms'
        WHEN event_type = 'signup' THEN 'connection_check.go:10] Connected to broker ' || (user_id % 12)
             || ' in ' || lat || ' ms'
        ELSE 'connection_check.go:10] Error connecting to broker ' || (user_id % 12) || ' in ' || lat
             || ' ms (error [EOF])' END AS value FROM probes""",
    ),
    "log_rows": (
        ("lines",),
        """SELECT event_id, kind, CAST(digits AS BIGINT) AS duration_ms FROM (
        SELECT event_id, CASE WHEN p <> '' THEN 'producer' WHEN e <> '' THEN 'e2e' WHEN c <> '' THEN 'connection' END
        AS kind, CASE WHEN p <> '' THEN p WHEN e <> '' THEN e ELSE c END AS digits FROM (
        SELECT event_id,
        regexp_extract(value, '"""
        + C.LOG_PATTERNS[0][2]
        + """', 1) AS p, regexp_extract(value, '"""
        + C.LOG_PATTERNS[1][2]
        + """', 1) AS e, regexp_extract(value, '"""
        + C.LOG_PATTERNS[2][3]
        + """', 1) AS c FROM lines)) WHERE kind IS NOT NULL""",
    ),
    "sorted_rows": (
        ("log_rows",),
        """SELECT kind, duration_ms AS x, row_number() OVER (PARTITION BY kind ORDER BY duration_ms) AS pos,
        count(*) OVER (PARTITION BY kind) AS ld FROM log_rows""",
    ),
    "errors": (
        ("probes",),
        f"""SELECT cluster_id, client_id, 'topic-' || cluster_id AS topic, ms AS ts_ms,
        {_pick([r[0] for r in C.ERROR_COUNTERS], 'user_id')} AS step,
        {_pick(fx.ERROR_CLASSES, 'event_id')} AS error_class, CASE WHEN event_id % 10 < 8 THEN event_id % 10 <> 0 END AS will_retry
        FROM probes WHERE event_type = 'error'""",
    ),
    "clients": (
        ("probes",),
        """SELECT DISTINCT cluster_id, client_id, 'topic-' || cluster_id AS topic FROM (
        SELECT cluster_id, client_id FROM probes UNION ALL SELECT cluster_id, 'client-9' FROM probes)""",
    ),
    "ticks": (
        ("attempts", "records"),
        f"""SELECT cluster_id, client_id, tick, sum(p) AS p, sum(c) AS c FROM (
        SELECT cluster_id, client_id, ack_ms - ack_ms % {HOUR} + {HOUR} AS tick, 1 AS p, 0 AS c FROM attempts
        UNION ALL SELECT cluster_id, client_id, recv_ms - recv_ms % {HOUR} + {HOUR}, 0, 1 FROM records) GROUP BY ALL""",
    ),
    "samples": (
        ("ticks",),
        f"""SELECT g.cluster_id, g.client_id, g.tick,
        CAST(sum(coalesce(p, 0)) OVER w AS BIGINT) AS produced, CAST(sum(coalesce(c, 0)) OVER w AS BIGINT) AS consumed
        FROM (SELECT cluster_id, client_id, unnest(range(min(tick), max(tick) + 1, {HOUR})) AS tick FROM ticks
              GROUP BY cluster_id, client_id) g
        LEFT JOIN ticks t ON g.cluster_id = t.cluster_id AND g.client_id = t.client_id AND g.tick = t.tick
        WINDOW w AS (PARTITION BY g.cluster_id, g.client_id ORDER BY g.tick ROWS UNBOUNDED PRECEDING)""",
    ),
    "ring": (
        ("samples",),
        """SELECT cluster_id, client_id, tick, first_value(produced) OVER w AS produced_tail, produced AS produced_head,
        first_value(consumed) OVER w AS consumed_tail, consumed AS consumed_head, count(*) OVER w AS count
        FROM samples WINDOW w AS (PARTITION BY cluster_id, client_id ORDER BY tick ROWS 9 PRECEDING)""",
    ),
    "status": (
        ("ring",),
        f"""SELECT cluster_id, client_id, tick, produced_head - produced_tail AS produced_delta,
        consumed_head - consumed_tail AS consumed_delta, count, count * {HOUR} AS time_window,
        CASE WHEN produced_head = produced_tail THEN -1.0 ELSE
        floor(CAST((consumed_head - consumed_tail) * 100 AS DOUBLE) / CAST(produced_head - produced_tail AS DOUBLE)
        * 100.0 + 0.5) / 100.0 END AS percentage FROM ring""",
    ),
    "snapshots": (
        (),
        """SELECT 'cluster-' || (s_suppkey // 10) AS cluster_id, s_suppkey AS broker_id, s_acctbal >= 0 AS again,
        CASE WHEN s_suppkey % 100 = 9 THEN '' ELSE 'rack' || (s_nationkey % 3) END AS rack FROM supplier""",
    ),
    "brokers": (
        ("snapshots",),
        """SELECT cluster_id, broker_id, rack FROM (
        SELECT *, bool_or(again) OVER (PARTITION BY cluster_id) AS newer FROM snapshots) WHERE again OR NOT newer""",
    ),
    "sizes": (
        ("brokers",),
        """SELECT cluster_id, count(*) AS brokers, count(*) FILTER (rack <> '') AS brokers_with_rack
        FROM brokers GROUP BY cluster_id""",
    ),
    "ordered": (
        ("brokers", "sizes"),
        """SELECT cluster_id, broker_id, rack, brokers, row_number() OVER (PARTITION BY cluster_id
        ORDER BY CASE WHEN aware THEN k ELSE 0 END, CASE WHEN aware THEN first_id ELSE broker_id END) - 1 AS position
        FROM (SELECT b.*, s.brokers, s.brokers = s.brokers_with_rack AS aware,
        row_number() OVER (PARTITION BY b.cluster_id, rack ORDER BY broker_id) AS k,
        min(broker_id) OVER (PARTITION BY b.cluster_id, rack) AS first_id
        FROM brokers b JOIN sizes s ON b.cluster_id = s.cluster_id)""",
    ),
    "topics": (
        (),
        f"""SELECT 'cluster-' || (p_partkey // 200) AS cluster_id, 'topic-' || (p_partkey % 200) AS topic,
        CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 1 + p_size % 12 END AS current_partitions,
        CASE WHEN p_size % 2 = 0 THEN -1 ELSE {fx.EXPECTED_SIZE} END AS expected_size,
        p_partkey % 2 = 0 AS first_run,
        CASE p_partkey % 7 WHEN 0 THEN '{C.UNKNOWN_TOPIC}' WHEN 1 THEN 'LEADER_NOT_AVAILABLE' END AS topic_error,
        coalesce({_pick(fx.CONFIG_CHOICES['TOPIC_CONFIG'], 'p_partkey')}, '') AS topic_config FROM part""",
    ),
    "decided": (
        ("topics", "sizes"),
        """SELECT t.*, brokers, expected_size = -1 AS dynamic, CASE
        WHEN topic_error = 'UNKNOWN_TOPIC_OR_PARTITION' THEN
             CASE WHEN expected_size = -1 OR expected_size = brokers THEN 'CREATE' ELSE 'WAIT_CLUSTER_SIZE' END
        WHEN topic_error IS NOT NULL THEN 'DESCRIBE_ERROR'
        WHEN expected_size = -1 OR (first_run AND expected_size = brokers) THEN 'REASSIGN' ELSE 'KEEP' END AS decision,
        topic_error IS NULL AND first_run AND topic_config <> '' AS alter_config
        FROM (SELECT t.*, coalesce(s.brokers, 0) AS brokers FROM topics t LEFT JOIN sizes s USING (cluster_id)) t""",
    ),
    "plan": (
        ("topics", "sizes", "ordered"),
        """SELECT p.cluster_id, topic, partition_id, r AS replica_idx, broker_id, rack FROM (
        SELECT t.cluster_id, topic, brokers, unnest(range(greatest(current_partitions, brokers))) AS partition_id
        FROM topics t JOIN sizes s ON t.cluster_id = s.cluster_id) p
        JOIN (SELECT unnest([0, 1, 2]) AS r) ON r < least(p.brokers, 3)
        JOIN ordered o ON o.cluster_id = p.cluster_id AND o.position = (partition_id + r) % p.brokers""",
    ),
    "leaders": (
        (),
        """SELECT 'cluster-' || (l_orderkey % 3) AS cluster_id, 'topic-' || (l_orderkey // 3) AS topic,
        l_linenumber - 1 AS partition_id, min(l_suppkey) % 7 AS leader,
        min(l_suppkey) FILTER (l_quantity >= 5) % 7 AS known, min(l_returnflag) AS flag
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    ),
    "seen_partitions": (
        (),
        """SELECT DISTINCT 'cluster-' || (k // 200) AS cluster_id, 'topic-' || (k % 200) AS topic, p AS partition_id FROM (
        SELECT l_partkey + CASE WHEN l_orderkey % 2 = 0 THEN 200 ELSE 0 END AS k, l_linenumber - 1 AS p FROM lineitem)""",
    ),
    "hourly": (
        ("probes",),
        f"""SELECT cluster_id, client_id, partition, ms - ms % {HOUR} + {HOUR} + (user_id % 5) * {fx.SCRAPE_OFFSET_MS} AS scrape_ms,
        count(*) AS p_total,
        count(*) FILTER (event_type <> 'error') AS p_n,
        coalesce(sum(lat) FILTER (event_type <> 'error'), 0) AS p_sum,
        count(*) FILTER (event_type <> 'error' AND lat <= 400) AS p_400,
        count(*) FILTER (event_type <> 'error' AND lat NOT BETWEEN 40 AND 41) AS c_n,
        coalesce(sum(2 * lat) FILTER (event_type <> 'error' AND lat NOT BETWEEN 40 AND 41), 0) AS c_sum,
        count(*) FILTER (event_type <> 'error' AND lat NOT BETWEEN 40 AND 41 AND 2 * lat <= 400) AS c_400
        FROM probes WHERE client_id <> 'client-4' OR ms < {fx.LAST_SCRAPE_MS} GROUP BY ALL""",
    ),
    "running": (
        ("hourly",),
        "SELECT cluster_id, client_id, partition, scrape_ms, "
        + ", ".join(
            f"CAST(sum({c}) OVER w AS DOUBLE) AS {c}" for c in ("p_total", "p_n", "p_sum", "p_400", "c_n", "c_sum", "c_400")
        )
        + f""" FROM hourly WINDOW w AS (PARTITION BY cluster_id, client_id, partition, scrape_ms // {10 * DAY}
        ORDER BY scrape_ms ROWS UNBOUNDED PRECEDING)""",
    ),
    "metrics": (
        ("running",),
        " UNION ALL ".join(
            f"""SELECT '{name}' AS name, cluster_id AS cluster, client_id AS clientid, CAST(partition AS VARCHAR) AS partition,
            {le} AS le, scrape_ms, {column} AS value FROM running"""
            for name, le, column in (
                ("records_produced_total", "NULL", "p_total"),
                ("records_produced_latency_sum", "NULL", "p_sum"),
                ("records_produced_latency_count", "NULL", "p_n"),
                ("records_produced_latency_bucket", "'400'", "p_400"),
                ("records_produced_latency_bucket", "'+Inf'", "p_n"),
                ("records_consumed_total", "NULL", "c_n"),
                ("records_consumed_latency_sum", "NULL", "c_sum"),
                ("records_consumed_latency_count", "NULL", "c_n"),
                ("records_consumed_latency_bucket", "'400'", "c_400"),
                ("records_consumed_latency_bucket", "'+Inf'", "c_n"),
            )
        ),
    ),
    # A series' counter without its restarts.
    "adjusted": (
        ("metrics",),
        """SELECT *, sum(step) OVER (PARTITION BY name, cluster, clientid, partition, le ORDER BY scrape_ms) AS adj FROM (
        SELECT *, CASE WHEN value < lag(value) OVER w THEN value ELSE coalesce(value - lag(value) OVER w, 0) END AS step
        FROM metrics WINDOW w AS (PARTITION BY name, cluster, clientid, partition, le ORDER BY scrape_ms))""",
    ),
    # All times at which dashboards are evaluated, by the hour.
    "grid": (
        ("metrics",),
        f"""SELECT unnest(range(min(scrape_ms) - min(scrape_ms) % {HOUR}, max(scrape_ms) + {7 * HOUR}, {HOUR})) AS at_ms
        FROM metrics""",
    ),
    # At each time, from the scrapes of the window that ends there.
    "increases": (
        ("adjusted", "grid"),
        f"""SELECT name, cluster, clientid, partition, le, at_ms, max(adj) - min(adj) AS increase,
        max(scrape_ms) - min(scrape_ms) AS covered FROM grid
        JOIN adjusted ON scrape_ms <= at_ms AND scrape_ms > at_ms - {6 * HOUR} GROUP BY ALL HAVING count(*) >= 2""",
    ),
    "configs": (
        (),
        " UNION ALL ".join(
            f"""SELECT 'customer-' || c_custkey AS client_id, '{key}' AS key, {_pick(values, 'c_custkey')} AS value
            FROM customer WHERE {_pick(values, 'c_custkey')} IS NOT NULL"""
            for key, values in fx.CONFIG_CHOICES.items()
        )
        + " UNION ALL SELECT 'customer-' || c_custkey, 'CLIENT_ID', c_name FROM customer",
    ),
    "wide": (
        ("configs",),
        "SELECT client_id, "
        + ", ".join(f"max(value) FILTER (key = '{key}') AS {key if key != 'CLIENT_ID' else 'OWN_CLIENT_ID'}" for key, _, _ in C.CONFIG_KEYS)
        + " FROM configs GROUP BY client_id",
    ),
    "polls": (
        (),
        """SELECT path, poll_ms, event_id, present, CASE WHEN present AND NOT broken THEN sha256(content) END AS hash FROM (
        SELECT 'user-' || user_id AS path, epoch_us(ts) // 1000 AS poll_ms, event_id, event_type <> 'error' AS present,
        event_type = 'signup' AND CAST(json_extract(props, '$.k') AS BIGINT) = 11 AS broken,
        '{"verbosityLogLevel": ' || (CAST(json_extract(props, '$.k') AS BIGINT) % 3) || '}' AS content FROM events)""",
    ),
}


def _sql(needs: str, body: str) -> str:
    """Put the derived tables that a query needs in front of it, each after those it needs itself."""
    names: list[str] = []

    def add(name: str) -> None:
        for before in TABLES[name][0]:
            add(before)
        if name not in names:
            names.append(name)

    for name in needs.split():
        add(name)
    if not names:
        return body
    return "WITH " + ", ".join(f"{name} AS ({TABLES[name][1]})" for name in names) + " " + body


def _histogram(source: str, value: str, keys: str, bounds) -> str:
    rows = [
        f"""SELECT {keys}, '{int(b)}' AS le, count(*) FILTER ({value} <= {b}) AS bucket_count,
        CAST(sum({value}) AS BIGINT) AS sum, count(*) AS count FROM {source} WHERE {value} IS NOT NULL GROUP BY {keys}"""
        for b in bounds
    ]
    rows.append(
        f"""SELECT {keys}, '+Inf' AS le, count(*) AS bucket_count, CAST(sum({value}) AS BIGINT) AS sum,
        count(*) AS count FROM {source} WHERE {value} IS NOT NULL GROUP BY {keys}"""
    )
    return " UNION ALL ".join(rows)


def _quantiles(n: int, j: str, rest: str) -> str:
    return f"""SELECT kind, i, max((xj * ({n} - rest) + xk * rest) / CAST({n} AS DOUBLE)) AS q FROM (
    SELECT kind, i, max(rest) AS rest, sum(x) FILTER (pos = j) AS xj, sum(x) FILTER (pos = j + 1) AS xk FROM (
    SELECT *, {rest} AS rest FROM (SELECT *, {j} AS j FROM sorted_rows, (SELECT unnest(range(1, {n})) AS i)))
    GROUP BY kind, i) GROUP BY kind, i"""


def _error_counters() -> str:
    parts = []
    for step, metric, label, retried, zero in C.ERROR_COUNTERS:
        client = "client_id" if label == "client" else "''"
        topic = "topic" if label == "topic" else "''"
        retry = " AND will_retry" if retried else ""
        parts.append(
            f"SELECT cluster_id, '{metric}' AS metric, {client} AS client_id, {topic} AS topic, 1 AS n "
            f"FROM errors WHERE step = '{step}'{retry}"
        )
        if zero:
            parts.append(f"SELECT cluster_id, '{metric}', {client}, {topic}, 0 FROM clients")
    return (
        "SELECT cluster_id, metric, client_id, topic, CAST(sum(n) AS BIGINT) AS value FROM ("
        + " UNION ALL ".join(parts)
        + ") GROUP BY ALL"
    )


def _number(x: str) -> str:
    """Text of a whole number: plain below a million, then with an exponent."""
    digits = f"CAST(CAST({x} AS BIGINT) AS VARCHAR)"
    tail = f"rtrim(substr({digits}, 2), '0')"
    return f"""CASE WHEN {x} < 1000000 THEN {digits} ELSE left({digits}, 1)
    || CASE WHEN {tail} = '' THEN '' ELSE '.' || {tail} END || 'e+' || lpad(CAST(length({digits}) - 1 AS VARCHAR), 2, '0') END"""


# Key-value strings: valid unless an item, but for one empty last one, is not key=value with a key.
_ITEMS = """CASE WHEN list_last(string_split(value, ';')) = '' THEN string_split(value, ';')[:-2]
    ELSE string_split(value, ';') END"""
_PAIRS_OK = f"""(value = '' OR len(list_filter({_ITEMS},
    lambda s: len(string_split(s, '=')) <> 2 OR starts_with(s, '='))) = 0)"""
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_BOUNDS_OK = f"len(list_filter(string_split(value, ','), lambda s: NOT regexp_matches(s, '{_NUMBER}'))) = 0"


def _rule(expression: str, key: str) -> str:
    default = {k: d for k, _, d in C.CONFIG_KEYS}[key]
    return expression.replace("value", f"coalesce({key}, {_text(default)})")


def _lint() -> str:
    mechanisms = "('PLAIN', 'SCRAM-SHA-256', 'SCRAM-SHA-512')"
    rules = {
        "sasl_mechanism": f"coalesce(SASL_MECHANISM, '') = '' OR SASL_MECHANISM IN {mechanisms}",
        "sasl_user": f"coalesce(SASL_MECHANISM, '') NOT IN {mechanisms} OR coalesce(SASL_USER, '') <> ''",
        "sasl_password": f"coalesce(SASL_MECHANISM, '') NOT IN {mechanisms} OR coalesce(SASL_PASSWORD, '') <> ''",
        "tracing_exporter": "coalesce(EXPORTER_TYPE_TRACING, '') IN ('', 'jaeger', 'otlp')",
        "topic_config": _rule(_PAIRS_OK, "TOPIC_CONFIG"),
        "constant_labels": _rule(_PAIRS_OK, "PROMETHEUS_CONSTANT_LABELS"),
        "producer_buckets": _rule(_BOUNDS_OK, "PRODUCER_LATENCY_BUCKETS"),
        "endtoend_buckets": _rule(_BOUNDS_OK, "ENDTOEND_LATENCY_BUCKETS"),
        "connection_buckets": _rule(_BOUNDS_OK, "CONNECTION_CHECK_LATENCY_BUCKETS"),
    }
    return " UNION ALL ".join(f"SELECT client_id, '{rule}' AS rule, {ok} AS ok FROM wide" for rule, ok in rules.items())


def _typed(key: str, kind: str, default: str) -> str:
    name, column = ("own_client_id", "OWN_CLIENT_ID") if key == "CLIENT_ID" else (key.lower(), key)
    text = f"coalesce({column}, {_text(default)})"
    if kind == "int":
        return f"{_INT.format(column, int(default))} AS {name}"
    if kind == "bool":
        words = ", ".join(f"'{word}'" for word in C.TRUE_WORDS)
        return f"coalesce({column} IN ({words}), {str(default in C.TRUE_WORDS).lower()}) AS {name}"
    if kind == "list":
        return f"replace({text}, ',', '|') AS {name}"
    if kind == "buckets":
        fits, items = _rule(_BOUNDS_OK, key), f"string_split({text}, ',')"
        return (
            f"CASE WHEN {fits} THEN len({items}) ELSE 0 END AS {name}_n, "
            f"CASE WHEN {fits} THEN list_sum(list_transform({items}, lambda x: TRY_CAST(x AS DOUBLE))) ELSE 0.0 END AS {name}_sum"
        )
    if kind == "map":
        items = _ITEMS.replace("value", text)
        return (
            f"CASE WHEN {_rule(_PAIRS_OK, key)} AND {text} <> '' "
            f"THEN len(list_distinct(list_transform({items}, lambda x: string_split(x, '=')[1]))) ELSE 0 END AS {name}_n"
        )
    return f"{text} AS {name}"


def _redacted() -> str:
    shown = []
    for key, kind, default in C.CONFIG_KEYS:
        if key in C.UNPRINTED_KEYS:
            continue
        column = "OWN_CLIENT_ID" if key == "CLIENT_ID" else key
        mark = C.SECRET_PLACEHOLDERS.get(key)
        text = f"coalesce({column}, {_text(default)})"
        if kind == "int" and not mark:
            text = f"CAST({_INT.format(column, default)} AS VARCHAR)"
        if kind == "bool" and not mark:
            words = ", ".join(_text(w) for w in C.TRUE_WORDS)
            text = f"CASE WHEN coalesce({column}, {_text(default)}) IN ({words}) THEN 'true' ELSE 'false' END"
        if mark:
            plain = " AND SASL_MECHANISM = 'PLAIN'" if key.startswith("SASL_") else ""
            text = f"CASE WHEN coalesce({column}, '') <> ''{plain} THEN '{mark}' ELSE '' END"
        shown.append(f"SELECT client_id, '{key}' AS key, {text} AS shown FROM wide")
    return " UNION ALL ".join(shown)


_INT = """CASE WHEN {0} IS NULL THEN {1} WHEN NOT regexp_matches({0}, '^[+-]?[0-9]+$') THEN 0 ELSE
    CAST(greatest(least(CAST({0} AS HUGEINT), 9223372036854775807), -9223372036854775808) AS BIGINT) END"""
_SERIES = """name || '{clientid="' || clientid || '",cluster="' || cluster || '",partition="' || partition || '"'
    || coalesce(',le="' || le || '"', '') || '}'"""


def _ratio(upper: str, lower: str, factor: str, out: str) -> str:
    """Increase of one kind of series by that of another, by metric and labels."""
    return f"""SELECT metric, clientid, partition, at_ms,
    CASE WHEN l <> 0 THEN u / l {factor} END AS {out} FROM (
    SELECT regexp_extract(name, '^(.*_latency)_', 1) AS metric, clientid, partition, at_ms,
    sum(increase) FILTER ({upper}) AS u, sum(increase) FILTER ({lower}) AS l FROM increases
    WHERE {upper} OR {lower} GROUP BY ALL)"""


def oracles() -> dict[str, str]:
    series = "cluster_id, client_id, partition"
    targets = ", ".join(f"{_pick(v, 'c_custkey')} AS {k}" for k, v in fx.BACKOFF_CHOICES.items())
    by_broker = "cluster_id, broker_id, connected"
    bounds = _histogram("checks", "duration_ms", by_broker, C.CONNECTION_BOUNDS)
    found = {
        "log_latency_rows": _sql("log_rows", "SELECT * FROM log_rows"),
        "log_latency_mean": _sql(
            "log_rows", "SELECT kind, avg(duration_ms) AS mean_ms, count(*) AS n FROM log_rows GROUP BY kind"
        ),
        "log_quantiles_exclusive": _sql(
            "sorted_rows",
            _quantiles(4, "greatest(1, least(ld - 1, (i * (ld + 1)) // 4))", "i * (ld + 1) - j * 4"),
        ),
        "log_quantiles_inclusive": _sql(
            "sorted_rows", _quantiles(10, "(i * (ld - 1)) // 10 + 1", "i * (ld - 1) - (j - 1) * 10")
        ),
        "records_produced": _sql(
            "attempts",
            f"""SELECT {series}, count(*) AS produced_total, count(error) AS produced_failed_total
            FROM attempts GROUP BY {series}""",
        ),
        "records_consumed": _sql("records", f"SELECT {series}, count(*) AS consumed_total FROM records GROUP BY {series}"),
        "produce_latency": _sql("attempts", f"SELECT {series}, message_id, latency_ms FROM attempts"),
        "e2e_latency": _sql("decoded", f"""SELECT {series}, "offset", recv_ms, latency_ms, is_malformed FROM decoded"""),
        "produce_latency_hist": _sql("attempts", _histogram("attempts", "latency_ms", series, C.PRODUCE_BOUNDS)),
        "e2e_latency_hist": _sql("decoded", _histogram("decoded", "latency_ms", series, C.END_TO_END_BOUNDS)),
        "connection_latency_hist": _sql("checks", bounds),
        "connection_totals": _sql(
            "checks",
            """SELECT u.cluster_id, u.broker_id, u.connected, count(c.check_ms) AS connection_total,
            count(c.check_ms) FILTER (NOT u.connected) AS connection_error_total
            FROM (SELECT cluster_id, broker_id, connected FROM (SELECT DISTINCT cluster_id FROM checks),
                  (SELECT unnest(range(13)) AS broker_id), (SELECT unnest([true, false]) AS connected)) u
            LEFT JOIN checks c ON u.cluster_id = c.cluster_id AND u.broker_id = c.broker_id
            AND u.connected = c.connected GROUP BY ALL""",
        ),
        "error_totals": _sql(
            "errors clients",
            f"""SELECT cluster_id, metric, client_id, value FROM ({_error_counters()})
            WHERE NOT starts_with(metric, 'topic_')""",
        ),
        "topic_errors": _sql(
            "errors clients",
            f"SELECT cluster_id, metric, topic, value FROM ({_error_counters()}) WHERE starts_with(metric, 'topic_')",
        ),
        "disconnections": _sql(
            "errors",
            f"""SELECT cluster_id, client_id, ts_ms, error_class,
            error_class IN ({', '.join(_text(c) for c in C.DISCONNECTIONS)}) AS disconnected FROM errors""",
        ),
        "payload_roundtrip": _sql(
            "probes",
            f"""SELECT event_id, payload, CASE WHEN cut THEN '' ELSE client_id END AS producer_id,
            CASE WHEN cut THEN 0 ELSE event_id END AS message_id, CASE WHEN cut THEN 0 ELSE ms END AS timestamp,
            cut AS is_malformed FROM (SELECT *, lat = 20 AS cut,
            CASE WHEN lat = 20 THEN substr({PAYLOAD}, 1, 20) ELSE {PAYLOAD} END AS payload FROM probes)""",
        ),
        "status_samples": _sql("samples", "SELECT * FROM samples"),
        "status_ring": _sql("ring", "SELECT * FROM ring"),
        "status_percentage": _sql("status", "SELECT * FROM status"),
        "status_json": _sql(
            "status",
            """SELECT cluster_id, client_id, tick, '{"Consuming":{"TimeWindow":' || time_window || ',"Percentage":'
            || regexp_replace(printf('%.2f', percentage), '\\.?0+$', '') || '}}' AS json FROM status""",
        ),
        "broker_order": _sql("ordered", "SELECT cluster_id, broker_id, rack, position FROM ordered"),
        "rack_completeness": _sql("sizes", "SELECT *, brokers = brokers_with_rack AS rack_aware FROM sizes"),
        "replication_params": _sql(
            "sizes",
            """SELECT cluster_id, brokers, least(brokers, 3) AS rf, greatest(1, least(brokers, 3) - 1) AS min_isr
            FROM sizes""",
        ),
        "replica_plan": _sql(
            "plan",
            "SELECT cluster_id, topic, partition_id, CAST(replica_idx AS BIGINT) AS replica_idx, broker_id FROM plan",
        ),
        "plan_quality": _sql(
            "plan",
            """SELECT cluster_id, topic, max(dup_broker) AS dup_broker, max(dup_rack) AS dup_rack,
            max(leads) AS max_leaders FROM (
            SELECT *, count(*) OVER (PARTITION BY cluster_id, topic, leader) AS leads FROM (
            SELECT cluster_id, topic, partition_id, count(*) <> count(DISTINCT broker_id) AS dup_broker,
            count(nullif(rack, '')) <> count(DISTINCT nullif(rack, '')) AS dup_rack,
            max(broker_id) FILTER (replica_idx = 0) AS leader FROM plan GROUP BY ALL)) GROUP BY cluster_id, topic""",
        ),
        "reconcile_decision": _sql(
            "decided",
            """SELECT cluster_id, topic, brokers, dynamic, decision, alter_config,
            decision = 'REASSIGN' AND brokers <> current_partitions AS refresh FROM decided""",
        ),
        "topology_actions": _sql(
            "decided plan",
            """SELECT d.cluster_id, d.topic,
            CAST(CASE WHEN decision = 'CREATE' OR partition_id < current_partitions THEN 1 ELSE 2 END AS BIGINT) AS step,
            CASE WHEN decision = 'CREATE' THEN 'create_topic' WHEN partition_id < current_partitions THEN 'reassign'
            ELSE 'create_partitions' END AS action, partition_id,
            string_agg(CAST(broker_id AS VARCHAR), ',' ORDER BY replica_idx) AS replicas
            FROM decided d JOIN plan p ON d.cluster_id = p.cluster_id AND d.topic = p.topic WHERE decision IN ('CREATE', 'REASSIGN') GROUP BY ALL
            UNION ALL SELECT cluster_id, topic, 0, 'keep', p, (p % 10) || ',' || ((p + 1) % 10) FROM (
            SELECT *, unnest(range(current_partitions)) AS p FROM decided WHERE decision = 'KEEP')""",
        ),
        "orphan_partitions": _sql(
            "decided",
            """SELECT cluster_id, topic, partition_id, brokers, partition_id >= brokers AS orphan FROM (
            SELECT *, unnest(range(current_partitions)) AS partition_id FROM decided)""",
        ),
        "topic_config_merge": _sql(
            "decided",
            f"""SELECT cluster_id, topic, key, max(v) AS value FROM (
            SELECT cluster_id, topic, key, last(v ORDER BY i) AS v FROM (
            SELECT cluster_id, topic, string_split(item, '=')[1] AS key, string_split(item, '=')[2] AS v, i, decision FROM (
            SELECT cluster_id, topic, decision, unnest(items) AS item, unnest(range(len(items))) AS i FROM (
            SELECT cluster_id, topic, decision, {_ITEMS} AS items FROM (SELECT *, topic_config AS value FROM decided)
            WHERE (decision = 'CREATE' OR alter_config) AND {_PAIRS_OK} AND value <> '')))
            WHERE decision <> 'CREATE' OR key NOT IN ('cleanup.policy', 'min.insync.replicas') GROUP BY cluster_id, topic, key
            UNION ALL SELECT cluster_id, topic, 'cleanup.policy', 'delete' FROM decided WHERE decision = 'CREATE'
            UNION ALL SELECT cluster_id, topic, 'min.insync.replicas', CAST(greatest(1, least(brokers, 3) - 1) AS VARCHAR)
            FROM decided WHERE decision = 'CREATE') GROUP BY cluster_id, topic, key""",
        ),
        "leader_mismatch": _sql(
            "leaders",
            """SELECT cluster_id, topic, bool_or(known IS DISTINCT FROM leader) AS mismatch FROM leaders
            GROUP BY cluster_id, topic""",
        ),
        "leader_election_needed": _sql(
            "leaders",
            """SELECT l.cluster_id, l.topic, coalesce(n = o.brokers AND moved, false) AS elect_leader FROM (
            SELECT cluster_id, topic, count(*) AS n, bool_or(partition_id <> leader) AS moved FROM leaders
            GROUP BY cluster_id, topic) l
            LEFT JOIN (SELECT 'cluster-' || (o_orderkey % 3) AS cluster_id, 'topic-' || (o_orderkey // 3) AS topic,
            1 + o_custkey % 7 AS brokers FROM orders WHERE o_custkey % 11 <> 0) o
            ON l.cluster_id = o.cluster_id AND l.topic = o.topic""",
        ),
        "reassignment_ongoing": _sql(
            "leaders",
            "SELECT cluster_id, topic, bool_or(flag IN ('R', 'A')) AS ongoing FROM leaders GROUP BY cluster_id, topic",
        ),
        "partition_coverage": _sql(
            "topics seen_partitions",
            """SELECT t.cluster_id, t.topic, count(*) AS expected, count(s.topic) AS seen, count(*) = count(s.topic) AS covered
            FROM (SELECT cluster_id, topic, unnest(range(current_partitions)) AS partition_id FROM topics) t
            LEFT JOIN seen_partitions s ON t.cluster_id = s.cluster_id AND t.topic = s.topic
            AND t.partition_id = s.partition_id GROUP BY t.cluster_id, t.topic""",
        ),
        "partitions_unconsumed": _sql(
            "topics seen_partitions",
            """SELECT cluster_id, topic, unnest(range(current_partitions)) AS partition_id FROM topics
            EXCEPT SELECT * FROM seen_partitions""",
        ),
        "probe_round": _sql(
            "probes",
            f"""SELECT cluster_id, client_id, tick, partition, message_id, '{{"producerId":"' || client_id || '","messageId":'
            || message_id || ',"timestamp":' || tick || '}}' AS payload FROM (
            SELECT *, row_number() OVER (PARTITION BY cluster_id, client_id ORDER BY tick, partition) AS message_id FROM (
            SELECT cluster_id, client_id, tick, unnest(range(n)) AS partition FROM (
            SELECT cluster_id, client_id, ms - ms % {HOUR} AS tick, max(partition) + 1 AS n FROM probes GROUP BY ALL)))""",
        ),
        "probe_reconcile": _sql(
            "attempts decoded",
            """SELECT a.cluster_id, a.client_id, a.partition, a.message_id, count(d.recv_ms) > 0 AS received,
            count(d.recv_ms) AS copies, min(d.recv_ms) AS first_recv_ms FROM attempts a
            LEFT JOIN decoded d ON a.cluster_id = d.cluster_id AND a.client_id = d.producer_id
            AND a.message_id = d.message_id AND a.create_ms = d.sent_ms
            GROUP BY a.cluster_id, a.client_id, a.partition, a.message_id, a.create_ms""",
        ),
        "probe_lost": _sql(
            "attempts decoded",
            """SELECT cluster_id, client_id, partition, message_id, create_ms, error FROM attempts a WHERE NOT EXISTS (
            SELECT 1 FROM decoded d WHERE a.cluster_id = d.cluster_id AND a.client_id = d.producer_id AND a.message_id = d.message_id
            AND a.create_ms = d.sent_ms)""",
        ),
        "join_timeouts": """SELECT 'cluster-' || (o_custkey % 2) AS cluster_id,
            'client-' || (o_custkey % 5) AS client_id, count(*) AS attempts,
            count(*) FILTER (CAST(floor(o_totalprice) AS BIGINT) % 60000 > 30000) AS timeouts
            FROM orders GROUP BY ALL""",
        "roster_asof": _sql(
            "probes",
            f"""SELECT DISTINCT cluster_id, check_ms, broker_id FROM (
            SELECT c.*, CASE WHEN expected_size > 0 AND check_ms >= min(CASE WHEN fits THEN check_ms END) OVER w
                 THEN first_value(snapshot_ms) OVER (w ORDER BY fits DESC, check_ms)
                 WHEN NOT failed THEN snapshot_ms END AS used FROM (
            SELECT c.*, s.snapshot_ms, s.size = expected_size AND NOT failed AS fits FROM (
            SELECT *, check_ms // {HOUR} % {fx.FAILED_EVERY} = 0 AS failed FROM (
            SELECT DISTINCT cluster_id, ms - ms % {HOUR} + {HOUR // 2} AS check_ms,
            CASE WHEN cluster_id = 'cluster-1' THEN {fx.ROSTER_SIZE} ELSE -1 END AS expected_size FROM probes)) c
            ASOF JOIN (SELECT cluster_id, ms - ms % {4 * HOUR} AS snapshot_ms, count(DISTINCT user_id % 12) AS size
            FROM probes WHERE event_type = 'view' GROUP BY ALL) s
            ON c.cluster_id = s.cluster_id AND c.check_ms >= s.snapshot_ms) c
            WINDOW w AS (PARTITION BY cluster_id, expected_size)) u
            JOIN (SELECT DISTINCT cluster_id, ms - ms % {4 * HOUR} AS at, user_id % 12 AS broker_id FROM probes
            WHERE event_type = 'view') m USING (cluster_id) WHERE m.at = u.used""",
        ),
        "scrape_parse": _sql("metrics", "SELECT name, cluster, clientid, partition, le, value FROM metrics"),
        "exposition_lines": _sql(
            "checks",
            f"""SELECT 'probe_connection_latency' || suffix || '{{brokerid="' || broker_id || '",cluster="' || cluster_id
            || '",connected="' || connected || '"' || tag || '}} ' || {_number('n')} AS line FROM (
            SELECT {by_broker}, '_bucket' AS suffix, ',le="' || le || '"' AS tag, bucket_count AS n FROM ({bounds})
            UNION ALL SELECT {by_broker}, '_sum', '', sum FROM ({bounds}) WHERE le = '+Inf'
            UNION ALL SELECT {by_broker}, '_count', '', count FROM ({bounds}) WHERE le = '+Inf')""",
        ),
        "series_with_labels": _sql(
            "attempts",
            f"""SELECT 'records_produced_total{{clientid="' || client_id || '",cluster="' || cluster_id
            || '",partition="' || partition || '",site="one"}} ' || {_number('n')} AS line FROM (
            SELECT {series}, count(*) AS n FROM attempts GROUP BY ALL)""",
        ),
        "scrape_growth": _sql(
            "metrics",
            f"""SELECT {_SERIES} AS series, scrape_ms, coalesce(value > lag(value) OVER (
            PARTITION BY name, cluster, clientid, partition, le ORDER BY scrape_ms), false) AS grew FROM metrics""",
        ),
        "dashboard_totals": _sql(
            "metrics grid",
            f"""SELECT name, at_ms, sum(v) AS total FROM (
            SELECT name, cluster, clientid, partition, at_ms, max_by(value, scrape_ms) AS v FROM metrics
            JOIN grid ON scrape_ms <= at_ms AND scrape_ms > at_ms - {6 * HOUR} AND at_ms % {DAY} = 0
            WHERE ends_with(name, '_total') GROUP BY ALL) GROUP BY name, at_ms""",
        ),
        "dashboard_rates": _sql(
            "increases",
            """SELECT name, at_ms, round(sum(increase * 60000.0::DOUBLE / covered), 6) AS per_minute
            FROM increases WHERE ends_with(name, '_total') GROUP BY ALL""",
        ),
        "dashboard_avg_latency": _sql(
            "increases", _ratio("ends_with(name, '_latency_sum')", "ends_with(name, '_latency_count')", "", "mean_ms")
        ),
        "dashboard_perf_index": _sql("increases", _ratio("le = '400'", "le = '+Inf'", "* 100", "percentage")),
        "config_typed": _sql(
            "wide",
            f"""SELECT client_id, OWN_CLIENT_ID AS own_client_id,
            replace(coalesce(KAFKA_BOOTSTRAP_SERVERS, 'localhost:9092'), ',', '|') AS kafka_bootstrap_servers,
            coalesce(TOPIC, '__probe') AS topic, {_INT.format('RECONCILE_INTERVAL_MS', 30000)} AS reconcile_interval_ms,
            {_INT.format('EXPECTED_CLUSTER_SIZE', -1)} AS expected_cluster_size,
            {_INT.format('VERBOSITY_LOG_LEVEL', 0)} AS verbosity_log_level,
            coalesce(TLS_ENABLED IN ('1', 't', 'T', 'TRUE', 'true', 'True'), false) AS tls_enabled,
            coalesce(SASL_MECHANISM, '') AS sasl_mechanism,
            CASE WHEN {_rule(_BOUNDS_OK, 'PRODUCER_LATENCY_BUCKETS')}
            THEN len(string_split(coalesce(PRODUCER_LATENCY_BUCKETS, '2,5,10,20,50,100,200,400'), ',')) ELSE 0 END
            AS producer_buckets,
            CASE WHEN {_rule(_PAIRS_OK, 'TOPIC_CONFIG')}
            THEN nullif(regexp_extract(TOPIC_CONFIG, '(^|;)retention.ms=([^;]*)', 2), '') END AS retention_ms
            FROM wide""",
        ),
        "config_kv": _sql(
            "configs",
            f"""SELECT client_id, config_key, true AS is_valid, key, last(v ORDER BY i) AS value FROM (
            SELECT client_id, config_key, string_split(item, '=')[1] AS key, string_split(item, '=')[2] AS v, i FROM (
            SELECT client_id, key AS config_key, unnest(items) AS item, unnest(range(len(items))) AS i FROM (
            SELECT client_id, key, {_ITEMS} AS items FROM configs
            WHERE key IN ('TOPIC_CONFIG', 'PROMETHEUS_CONSTANT_LABELS') AND {_PAIRS_OK} AND value <> '')))
            GROUP BY ALL
            UNION ALL SELECT client_id, key, {_PAIRS_OK}, NULL, NULL FROM configs
            WHERE key IN ('TOPIC_CONFIG', 'PROMETHEUS_CONSTANT_LABELS') AND (NOT {_PAIRS_OK} OR value = '')""",
        ),
        "config_buckets": _sql(
            "configs",
            f"""SELECT client_id, config_key, true AS is_valid, idx, CAST(item AS DOUBLE) AS bound FROM (
            SELECT client_id, key AS config_key, unnest(string_split(value, ',')) AS item,
            unnest(range(len(string_split(value, ',')))) AS idx FROM configs
            WHERE ends_with(key, '_LATENCY_BUCKETS') AND {_BOUNDS_OK})
            UNION ALL SELECT client_id, key, false, NULL, NULL FROM configs
            WHERE ends_with(key, '_LATENCY_BUCKETS') AND NOT {_BOUNDS_OK}""",
        ),
        "config_redacted": _sql("wide", _redacted()),
        "config_lint": _sql("wide", _lint()),
        "config_changes": _sql(
            "polls",
            """SELECT path, poll_ms, event_id, event, CASE WHEN event = 'apply' THEN hash END AS hash FROM (
            SELECT *, CASE WHEN hash IS NOT NULL AND hash IS DISTINCT FROM last_value(hash IGNORE NULLS) OVER before
            THEN 'apply' WHEN NOT present AND lag(present) OVER (PARTITION BY path ORDER BY poll_ms, event_id)
            THEN 'default' END AS event FROM polls WINDOW before AS (PARTITION BY path ORDER BY poll_ms, event_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE event IS NOT NULL""",
        ),
        "retry_schedule": f"""WITH t AS (SELECT target, max_attempts, ceiling, scale,
            unnest(range(max_attempts)) AS attempt FROM (SELECT target, max_attempts,
            CASE WHEN scale_ms > 0 THEN scale_ms ELSE 200 END AS scale,
            CASE WHEN max_ms > 0 THEN max_ms ELSE 300000 END AS ceiling
            FROM (SELECT 'customer-' || c_custkey AS target, {targets} FROM customer))),
            d AS (SELECT *, CAST(least(scale * pow(2, attempt), ceiling) AS BIGINT) AS delay_ms,
            scale * 1000000.0 * pow(2, attempt) < 9223372036854775808.0 AS fits FROM t)
            SELECT target, attempt, delay_ms, CAST(sum(delay_ms) OVER (PARTITION BY target ORDER BY attempt) AS BIGINT)
            AS elapsed_ms, CASE WHEN bool_and(fits) OVER (PARTITION BY target) THEN 'exceeded' ELSE 'overflow' END
            AS last_outcome FROM d QUALIFY fits""",
        "probe_overview": _sql(
            "decoded status",
            f"""SELECT * FROM ({_histogram('decoded', 'latency_ms', 'cluster_id, client_id', C.END_TO_END_BOUNDS)})
            JOIN (SELECT cluster_id, client_id, max(tick) AS tick, max_by(percentage, tick) AS percentage FROM status
            GROUP BY cluster_id, client_id) USING (cluster_id, client_id)""",
        ),
    }
    found["status_current"] = f"""SELECT cluster_id, client_id, max(tick) AS tick, max_by(json, tick) AS json
        FROM ({found['status_json']}) GROUP BY cluster_id, client_id"""
    found["log_files_mean"] = found["log_latency_mean"]
    found["broker_files_racks"] = found["rack_completeness"]
    found["topic_files_replicas"] = _sql(
        "topics",
        """SELECT cluster_id, topic, partition_id, CAST(unnest([0, 1]) AS BIGINT) AS replica_idx,
        unnest([partition_id % 10, (partition_id + 1) % 10]) AS broker_id FROM (
        SELECT cluster_id, topic, unnest(range(current_partitions)) AS partition_id FROM topics)""",
    )
    found["config_dynamic_text"] = """SELECT 'user-' || user_id AS path, epoch_us(ts) // 1000 AS poll_ms, event_id,
        '{VerbosityLogLevel:' || (CAST(json_extract(props, '$.k') AS BIGINT) % 3) || '}' AS shown FROM events
        WHERE event_type <> 'error' AND NOT (event_type = 'signup' AND CAST(json_extract(props, '$.k') AS BIGINT) = 11)"""
    found["status_implausible"] = _sql(
        "records",
        f"""SELECT cluster_id, client_id, count(*) FILTER (recv_ms < {fx.FIRST_MS}) AS too_early,
        count(*) FILTER (recv_ms >= {fx.LAST_SCRAPE_MS}) AS too_late, count(*) FILTER (recv_ms IS NULL) AS no_time
        FROM records WHERE recv_ms < {fx.FIRST_MS} OR recv_ms >= {fx.LAST_SCRAPE_MS} OR recv_ms IS NULL
        GROUP BY cluster_id, client_id""",
    )
    found["stream_records_consumed"] = found["stream_records_periodic"] = found["records_consumed"]
    found["status_runs"] = _sql(
        "ring",
        """SELECT cluster_id, client_id, min(tick) AS tick, count(*) AS length, produced_tail, produced_head, consumed_tail,
        consumed_head FROM ring GROUP BY cluster_id, client_id, produced_tail, produced_head, consumed_tail, consumed_head""",
    )
    found["probe_round_planned"] = _sql(
        "probes topics sizes",
        f"""SELECT cluster_id, client_id, tick, partition, message_id, '{{"producerId":"' || client_id || '","messageId":'
            || message_id || ',"timestamp":' || tick || '}}' AS payload FROM (
            SELECT *, row_number() OVER (PARTITION BY cluster_id, client_id ORDER BY tick, partition) AS message_id FROM (
            SELECT r.cluster_id, client_id, tick, unnest(range(greatest(current_partitions, brokers))) AS partition FROM (
            SELECT DISTINCT cluster_id, client_id, ms - ms % {HOUR} AS tick FROM probes) r
            JOIN topics t ON t.cluster_id = r.cluster_id AND t.topic = replace(client_id, 'client-', 'topic-')
            JOIN sizes s ON s.cluster_id = r.cluster_id))""",
    )
    held = found["topology_actions"]
    number = "CAST(regexp_extract(topic, '([0-9]+)$', 1) AS BIGINT) % 3"
    columns = "cluster_id, topic, partition_id, step, action, replicas"
    found["actions_outbox"] = f"""WITH held AS ({held})
        SELECT CAST(0 AS BIGINT) AS run, 'issue' AS change, CAST(1 AS BIGINT) AS version, {columns} FROM held WHERE {number} <> 0
        UNION ALL SELECT 1, 'issue', 1, {columns} FROM held WHERE {number} = 0
        UNION ALL SELECT 1, 'withdraw', 2, {columns} FROM held WHERE {number} = 1"""
    found["config_all"] = _sql("wide", f"SELECT client_id, {', '.join(_typed(*entry) for entry in C.CONFIG_KEYS)} FROM wide")
    found["stream_latency_hist"] = _sql(
        "decoded",
        _histogram(f"(SELECT *, recv_ms - recv_ms % {DAY} AS window_ms FROM decoded)", "latency_ms", "cluster_id, client_id, window_ms", C.END_TO_END_BOUNDS),
    )
    found["stream_status"] = found["status_percentage"]
    found["stream_status_current"] = found["status_current"]
    found["stream_reconcile"] = found["probe_reconcile"]
    found["stream_join_timeouts"] = found["join_timeouts"]
    # All clients are sampled until three ticks after the last record of any.
    live = {"samples": "live_samples", "ring": "live_ring", "status": "live_status"}
    last = f"(SELECT max(tick) FROM ticks) + 3 * {HOUR}"
    parts = [TABLES["samples"][1].replace("max(tick)", last), TABLES["ring"][1].replace("FROM samples", "FROM live_samples")]
    parts.append(TABLES["status"][1].replace("FROM ring", "FROM live_ring"))
    extra = ", ".join(f"{name} AS ({part})" for name, part in zip(live.values(), parts, strict=True))
    found["stream_status_ticks"] = _sql("ticks", "").rstrip() + f", {extra} " + found["status_json"][
        found["status_json"].index("SELECT cluster_id, client_id, tick, '{\"Consuming") :
    ].replace("FROM status", "FROM live_status")
    found["stream_join_outcomes"] = f"""WITH starts AS (SELECT 'cluster-' || (o_custkey % 2) AS cluster_id,
            'client-' || (o_custkey % 5) AS client_id, o_orderkey AS attempt, epoch_us(o_orderdate) // 1000 AS ts_ms,
            CAST(floor(o_totalprice) AS BIGINT) % 60000 AS wait FROM orders),
        joins AS (SELECT *, wait > {C.JOIN_TIMEOUT_MS} AS timed_out FROM starts),
        runs AS (SELECT *, count(*) FILTER (NOT timed_out) OVER (PARTITION BY cluster_id, client_id ORDER BY ts_ms, attempt
            ROWS UNBOUNDED PRECEDING) AS run FROM joins),
        numbered AS (SELECT *, CASE WHEN timed_out THEN (count(*) FILTER (timed_out) OVER (PARTITION BY cluster_id, client_id, run
            ORDER BY ts_ms, attempt ROWS UNBOUNDED PRECEDING) - 1) % {C.JOIN_RETRIES + 1} + 1 ELSE 0 END AS retry FROM runs)
        SELECT cluster_id, client_id, attempt, ts_ms, 'attempt' AS kind, timed_out, retry, retry > {C.JOIN_RETRIES} AS fatal
        FROM numbered
        UNION ALL SELECT cluster_id, client_id, attempt, ts_ms + wait, 'late_ready', NULL, NULL, NULL FROM joins WHERE timed_out"""
    return found
