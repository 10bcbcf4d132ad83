"""batchtrace: DataFrame jobs for recipe, batch and lot traceability data.

Sub-packages:
  sources    typed table scans, schema evolution, snapshot writes, fixed registries
  functions  Column -> Column expressions (codes, text cleaning, hashing)
  operators  DataFrame -> DataFrame building blocks (filters, joins, aggregates,
             paging, table changes, registration, quality rules, access policy)
  plans      composite queries (recipe views, lineage, listings) and the query catalog
  streaming  micro-batch packaging of registration jobs
"""

from batchtrace.session import get_spark, checkpoint_dir  # noqa: F401
