"""Spark-native control-plane ledger: events, projections and job queues as DataFrame plans."""
