"""Lazy DataFrame operators for categorical and ordinal survey tables.

Every operator takes and returns a DataFrame (or a Column) and starts no job of
its own; only the sinks in ``surveyloom.sources.sinks`` write anything.
"""
