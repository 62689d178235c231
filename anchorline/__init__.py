"""Anchor-time cohorts, windowed measurement features and outcome models as Spark jobs."""
