"""Training-data operators: cleaning, deduplication, mixing, tokenizing and search over text tables.

Nothing outside this subpackage imports it.  Every operator works on whole tables through Spark;
Python code runs only inside tasks, on batches that Spark has partitioned.
"""
