"""Churn, segmentation, lifetime value and anomaly jobs."""
