"""Nothing here: the workload that this engine serves has no streams, windows in time or late data.

Operators that need no order between rows (parsing, routing, record building) are plain
column expressions and run on streaming DataFrames as they are.
"""
