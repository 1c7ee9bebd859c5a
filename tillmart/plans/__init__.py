"""Staging, marts, facts, analyses, reports and metrics."""
