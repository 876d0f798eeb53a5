"""Training-data operators: deduplication, filters, token counts, packing.

Nothing else in the package imports this subpackage.  Shared conventions:

* ``doc_id`` names a document.  Rows with a null ``doc_id`` are passed through
  unchanged and are compared with nothing; rows sharing a ``doc_id`` are one
  document for every "which copy is first" decision.
* A null text counts as empty unless an operator says otherwise.
* Extra columns are ignored; clashing names never reach a join, because every
  operator first projects its own columns.
"""
