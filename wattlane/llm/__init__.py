"""Training-data pipeline operators: ten DataFrame operators over documents, pages and embeddings.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own general interface; :mod:`wattlane.llm.queries` derives
the registered queries from them.

Conventions shared by all operators:

* inputs are selected down to the columns an operator names, so extra columns
  with any name pass through or are ignored, never clash;
* a null text is an empty text; rows with equal id and text are one document;
* intermediate tables go to the shared folder of ``spark.checkpoint.dir``;
* a side is broadcast only after its size was counted, and joined by a
  shuffle beyond the limit.
"""
