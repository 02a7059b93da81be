"""Operators for preparing training corpora, one module per operator.

Nothing outside this package imports it.  Every operator takes and returns
DataFrames, reads the shared checkpoint folder from the session and leaves the
caller's extra columns alone unless its docstring says otherwise.
"""
