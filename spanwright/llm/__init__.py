"""Training-data operators: one module per operator, plus their registered queries.

Nothing outside this folder (other than the guarded import in ``__spark_entry__``
and ``corpus_pipeline``) imports it.
"""
