"""Operators for training-data pipelines. Nothing else in the package imports
this subpackage; its queries are listed in :mod:`riskframe.llm.queries`."""
