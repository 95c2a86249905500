"""rollmill: preference-data, rollout and training-corpus analytics as lazy Spark plans."""

__version__ = "0.1.0"
