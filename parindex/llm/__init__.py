"""Operators of a training-data pipeline over a ``documents`` table.

One module per operator; ``registry`` maps the registered queries to them.
Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
