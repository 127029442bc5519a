"""Spark-native bounded views: profiles, ranked retrieval, event logs, graphs, text views and experiments as DataFrame functions."""
