"""Nothing to run here: the data model has no unbounded source or event time.

Repeated runs are incremental batches instead; see ``gleaner.sources.index``.
"""
