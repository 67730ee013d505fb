"""Fleet-scale analysis of message broker probes on Spark."""
