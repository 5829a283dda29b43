"""Rollout and evaluation analytics on Spark."""
