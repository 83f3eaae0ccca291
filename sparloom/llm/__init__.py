"""Training-data operators: ten text-corpus operators and the pipeline that chains five of them.

Nothing outside this folder imports it.  Every operator takes and returns DataFrames; the thin
``opN_*`` queries in :mod:`sparloom.llm.queries` derive the digest columns of their contracts.
"""
