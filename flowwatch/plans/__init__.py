"""Composed jobs: training, scoring and alerting."""
