"""Subscriber churn and revenue-risk analytics as Spark DataFrame operators."""
