"""shoal: group free-text submissions into labelled clusters with Spark DataFrames.

Every operator takes and returns Spark DataFrames keyed by an explicit
``record_id``.  Sub-packages:

* ``functions``  -- Column expressions (text normalisation, markers, tokens)
* ``sources``    -- workbook decoding, table bindings, CSV sink
* ``operators``  -- grid shaping, filters, features, reduction, clustering,
                    evaluation, labels and report tables
* ``plans``      -- the end-to-end pipeline and the registered queries
* ``streaming``  -- incremental workbook ingest over a watched folder
"""

from shoal.session import get_session, ensure_checkpoint_dir  # noqa: F401

__all__ = ["get_session", "ensure_checkpoint_dir"]
