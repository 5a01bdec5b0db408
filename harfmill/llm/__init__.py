"""Training-data operators for large text corpora.

Nothing else in the package imports this subpackage; `queries.py` holds the
registered queries and `corpus_pipeline.py` at the repository top chains five
of the operators.

Conventions shared by all modules:

* Operators take DataFrames and return DataFrames.  They select the columns
  they need under internal names first, so extra or clashing input columns are
  harmless.
* Python code runs in Arrow batches (`mapInArrow`, grouped `applyInArrow`) and
  works on the UTF-8 bytes with numpy; nothing is collected but fixed-size
  models and per-partition totals.
* Steps that are read more than once are written as tables under
  `spark.checkpoint.dir` (see `shared.py`), so a lost executor costs only its
  running tasks.
"""
