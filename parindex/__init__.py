"""parindex — full-text indexing, Boolean search and relevance ranking on Spark.

Everything is a ``DataFrame -> DataFrame`` function built from Spark SQL
expressions.  The package layout:

* ``functions``  column expressions (text normalisation, array helpers,
  proximity folds, score formulas) — no Python on the row path;
* ``sources``    corpus readers and index-table writers/layouts;
* ``operators``  the relational operators (text, index, search, rank,
  vector form, text-search form, evaluation);
* ``plans``      the structured query tables and composed query plans;
* ``streaming``  incremental append through Structured Streaming.
"""

from parindex.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
