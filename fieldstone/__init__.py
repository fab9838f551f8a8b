"""fieldstone: document collections on Spark.

Filter documents compiled to DataFrame predicates, includes across collections, unit-of-work
sessions over versioned Parquet snapshots, row diffs, chunked attachments, ids and constraints.
"""
