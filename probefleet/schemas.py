"""Schemas of the tables that the operators read."""

PAYLOAD = "producerId STRING, messageId BIGINT, timestamp BIGINT"
PRODUCE_ATTEMPT = (
    "cluster_id STRING, client_id STRING, partition INT, message_id BIGINT, create_ms BIGINT, ack_ms BIGINT, "
    "offset BIGINT, error STRING"
)
CONSUME_RECORD = "cluster_id STRING, client_id STRING, partition INT, offset BIGINT, value STRING, recv_ms BIGINT"
CONNECTION_CHECK = (
    "cluster_id STRING, broker_id INT, check_ms BIGINT, connected BOOLEAN, duration_ms BIGINT, error STRING"
)
BROKER_SNAPSHOT = "cluster_id STRING, snapshot_ms BIGINT, broker_id INT, rack STRING"
TOPIC_PARTITION = (
    "cluster_id STRING, topic STRING, topic_error STRING, partition_id INT, leader INT, replicas ARRAY<INT>, "
    "isr ARRAY<INT>, offline ARRAY<INT>"
)
REASSIGNMENT = "cluster_id STRING, topic STRING, partition_id INT, adding ARRAY<INT>, removing ARRAY<INT>"
METRIC_SAMPLE = "scrape_ms BIGINT, name STRING, labels MAP<STRING, STRING>, value DOUBLE"
LOG_LINE = "path STRING, value STRING"
CONFIG = "client_id STRING, key STRING, value STRING"
CONFIG_SNAPSHOT = "path STRING, poll_ms BIGINT, exists BOOLEAN, content STRING"
JOIN_EVENT = "cluster_id STRING, client_id STRING, attempt BIGINT, kind STRING, ts_ms BIGINT"
ERROR_EVENT = (
    "cluster_id STRING, client_id STRING, topic STRING, step STRING, error_class STRING, ts_ms BIGINT, "
    "will_retry BOOLEAN"
)
STATUS_SAMPLE = "cluster_id STRING, client_id STRING, tick BIGINT, produced BIGINT, consumed BIGINT"
KAFKA_RECORD = (
    "key BINARY, value BINARY, topic STRING, partition INT, offset BIGINT, timestamp TIMESTAMP, timestampType INT"
)
