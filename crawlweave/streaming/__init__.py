"""The frontier, status and index steps on Structured Streaming.

Sources are parameters (any format with a ``value`` column, or files); sinks are
files, written once per micro-batch whatever fails.
"""
