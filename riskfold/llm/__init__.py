"""Training-data operators: one module per operator, queries in ``queries``.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
