"""Training-data operators: filtering, deduplication, search, tokenisation and scoring of text corpora.

Nothing else in the library imports this subpackage.  Shared conventions:

* operators read only the columns they need, so extra columns never clash;
* a null text is handled like an empty one unless a docstring says otherwise;
* a null ``doc_id`` is kept and is in no held-out fold (nor learnt from);
* lineage is cut with Parquet tables in the folder of ``spark.checkpoint.dir``.
"""
