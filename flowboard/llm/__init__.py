"""Operators of a training-data pipeline: languages, lines, near copies, leaks, packing, and the sinks around them.

Nothing else in the package imports this one. Shared conventions:

* A document is a row of (doc_id, text); rows with the same doc_id and text are the same document
  and get the same result. A null text counts as empty unless an operator says otherwise.
* A null doc_id sorts before all others. Equal doc_ids with different texts are told apart, and
  ordered, by hashes of the text.
* Operators read only the columns they name and carry other columns in one struct, so extra
  columns may have any names.
"""
