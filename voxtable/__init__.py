"""Timed-dialogue analytics for film dubbing, as Spark DataFrame jobs."""
