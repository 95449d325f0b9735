"""riskframe: Spark-native credit-risk analytics (profiling, features,
evaluation, decisioning, scoring, streaming) as DataFrame operators."""

__version__ = "0.1.0"
