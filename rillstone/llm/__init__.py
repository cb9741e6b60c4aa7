"""Operators that a training-data pipeline needs for texts, ratings and telemetry. Nothing else imports this package."""
