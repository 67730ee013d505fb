"""Results depend on them, so they are stated as they are."""

# Upper bounds of the latency histograms, in milliseconds.
PRODUCE_BOUNDS = (2.0, 5.0, 10.0, 20.0, 50.0, 100.0, 200.0, 400.0)
END_TO_END_BOUNDS = (5.0, 10.0, 20.0, 50.0, 100.0, 200.0, 400.0, 800.0)
CONNECTION_BOUNDS = (100.0, 200.0, 400.0, 800.0, 1600.0)

# How often the periodic jobs of a probe run; triggers for their streaming queries.
TRIGGERS = {
    "reconcile": "30 seconds",
    "connection_check": "120 seconds",
    "status": "30 seconds",
    "config": "30 seconds",
}

# Status window.
STATUS_SAMPLING_MS = 30000
STATUS_WINDOW_MS = 300000
NO_DATA_PERCENTAGE = -1.0

# Retries and timeouts.
BACKOFF_SCALE_MS = 200
BACKOFF_MAX_MS = 300000
JOIN_TIMEOUT_MS = 30000
JOIN_RETRIES = 3
LATENCY_TARGET_MS = 400

# Topology.
DYNAMIC_SIZE = -1
MAX_REPLICATION_FACTOR = 3
UNKNOWN_TOPIC = "UNKNOWN_TOPIC_OR_PARTITION"
MIN_ISR_KEY = "min.insync.replicas"
CLEANUP_KEY = "cleanup.policy"
CLEANUP_POLICY = "delete"

# Error classes that mean "the connection is gone".
DISCONNECTIONS = ("EOF", "ECONNRESET", "EPIPE", "ETIMEDOUT", "DEADLINE_EXCEEDED")

# Log line patterns in matching order: kind, word in every match, pattern, pattern for broker ids of any length.
LOG_PATTERNS = (
    (
        "producer",
        "producer",
        r"^.*?producer.go:\d+\]\sMessage\ssent.*duration=([0-9]+)\sms",
        r"^.*?producer.go:\d+\]\sMessage\ssent.*duration=([0-9]+)\sms",
    ),
    (
        "e2e",
        "consumer",
        r"^.*?consumer.go:\d+\]\sMessage\sreceived.*duration=([0-9]+)\sms",
        r"^.*?consumer.go:\d+\]\sMessage\sreceived.*duration=([0-9]+)\sms",
    ),
    (
        "connection",
        "connection_check",
        r"^.*?connection_check.go:\d+\].*broker\s[0-9]\sin\s([0-9]+)\sms",
        r"^.*?connection_check.go:\d+\].*broker\s[0-9]+\sin\s([0-9]+)\sms",
    ),
)

# Configuration keys: key, type, default. Names of topic, client and group are ours.
CONFIG_KEYS = (
    ("KAFKA_BOOTSTRAP_SERVERS", "list", "localhost:9092"),
    ("KAFKA_BOOTSTRAP_BACKOFF_MAX_ATTEMPTS", "int", "10"),
    ("KAFKA_BOOTSTRAP_BACKOFF_SCALE", "int", "5000"),
    ("TOPIC", "string", "__probe"),
    ("TOPIC_CONFIG", "map", ""),
    ("RECONCILE_INTERVAL_MS", "int", "30000"),
    ("CLIENT_ID", "string", "probe-client"),
    ("CONSUMER_GROUP_ID", "string", "probe-group"),
    ("PRODUCER_LATENCY_BUCKETS", "buckets", "2,5,10,20,50,100,200,400"),
    ("ENDTOEND_LATENCY_BUCKETS", "buckets", "5,10,20,50,100,200,400,800"),
    ("EXPECTED_CLUSTER_SIZE", "int", "-1"),
    ("KAFKA_VERSION", "string", "3.2.0"),
    ("SARAMA_LOG_ENABLED", "bool", "false"),
    ("VERBOSITY_LOG_LEVEL", "int", "0"),
    ("TLS_ENABLED", "bool", "false"),
    ("TLS_CA_CERT", "string", ""),
    ("TLS_CLIENT_CERT", "string", ""),
    ("TLS_CLIENT_KEY", "string", ""),
    ("TLS_INSECURE_SKIP_VERIFY", "bool", "false"),
    ("SASL_MECHANISM", "string", ""),
    ("SASL_USER", "string", ""),
    ("SASL_PASSWORD", "string", ""),
    ("CONNECTION_CHECK_INTERVAL_MS", "int", "120000"),
    ("CONNECTION_CHECK_LATENCY_BUCKETS", "buckets", "100,200,400,800,1600"),
    ("STATUS_CHECK_INTERVAL_MS", "int", "30000"),
    ("STATUS_TIME_WINDOW_MS", "int", "300000"),
    ("DYNAMIC_CONFIG_FILE", "string", ""),
    ("DYNAMIC_CONFIG_WATCHER_INTERVAL", "int", "30000"),
    ("EXPORTER_TYPE_TRACING", "string", ""),
    ("PROMETHEUS_CONSTANT_LABELS", "map", ""),
)
# Fields of the dynamic configuration file, and their names when displayed.
DYNAMIC_FIELDS = "saramaLogEnabled BOOLEAN, verbosityLogLevel BIGINT"
DYNAMIC_DISPLAY = ("SaramaLogEnabled", "VerbosityLogLevel")
TRUE_WORDS = ("1", "t", "T", "TRUE", "true", "True")
SASL_MECHANISMS = ("PLAIN", "SCRAM-SHA-256", "SCRAM-SHA-512")
TRACING_EXPORTERS = ("", "jaeger", "otlp")
SECRET_PLACEHOLDERS = {
    "TLS_CA_CERT": "[CA cert]",
    "TLS_CLIENT_CERT": "[Client cert]",
    "TLS_CLIENT_KEY": "[Client key]",
    "SASL_USER": "[SASL user]",
    "SASL_PASSWORD": "[SASL password]",
}
# Keys that the printed configuration leaves out.
UNPRINTED_KEYS = ("EXPORTER_TYPE_TRACING", "PROMETHEUS_CONSTANT_LABELS")

# Counters of errors by the step that failed: step, metric, label, counted only if retried, starts at 0.
ERROR_COUNTERS = (
    ("consume", "consumer_error_total", "client", False, True),
    ("producer_refresh", "producer_refresh_metadata_error_total", "client", False, True),
    ("consumer_refresh", "consumer_refresh_metadata_error_total", "client", False, True),
    ("client_creation", "client_creation_error_total", None, True, False),
    ("expected_size", "expected_cluster_size_error_total", None, True, True),
    ("topic_creation", "topic_creation_failed_total", "topic", False, True),
    ("describe_cluster", "topic_describe_cluster_error_total", None, False, True),
    ("describe_topic", "topic_describe_error_total", "topic", False, True),
    ("alter_assignments", "topic_alter_assignments_error_total", "topic", False, True),
    ("alter_configuration", "topic_alter_configuration_error_total", "topic", False, True),
)

# Texts of the metrics' help lines; wording is ours.
METRIC_HELP = {
    "records_produced_total": "Records produced",
    "records_produced_failed_total": "Records that could not be produced",
    "records_consumed_total": "Records consumed",
    "records_produced_latency": "Milliseconds from creating a record to its acknowledgement",
    "records_consumed_latency": "Milliseconds from creating a record to its receipt",
    "connection_latency": "Milliseconds of connection checks, successful or not",
    "connection_total": "Connection checks, successful or not",
    "connection_error_total": "Connection checks that failed",
    "consumer_error_total": "Errors while consuming",
    "consumer_timeout_join_group_total": "Group joins that took too long",
    "producer_refresh_metadata_error_total": "Errors while the producer refreshed metadata",
    "consumer_refresh_metadata_error_total": "Errors while the consumer refreshed metadata",
    "client_creation_error_total": "Errors while creating a client",
    "expected_cluster_size_error_total": "Waits for the expected number of brokers",
    "topic_creation_failed_total": "Errors while creating the topic",
    "topic_describe_cluster_error_total": "Errors while describing the cluster",
    "topic_describe_error_total": "Errors while describing the topic",
    "topic_alter_assignments_error_total": "Errors while changing assignments",
    "topic_alter_configuration_error_total": "Errors while changing the topic's configuration",
}
