"""Operators for training-data pipelines: one module per operator, and their registered queries.

Nothing outside this folder (but `corpus_pipeline.py` and the guarded lines of `__spark_entry__.py`) imports it.
"""
