"""Training-data operators: identification, deduplication, scans, packing and formatting.

Nothing outside this subpackage imports it.  Every module holds one operator
with a general interface, a thin ``opN_*`` query over the standard tables and,
where SQL can state the result, the SQL.
"""
