"""Source-corpus structure and call graphs as Spark tables.

Everything is a batch DataFrame job: files in, structure tables and a call graph out.
"""
