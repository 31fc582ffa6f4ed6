"""Training-data operators: ten DataFrame-in, DataFrame-out building blocks.

Nothing outside this subpackage imports it.  Queries and their SQL are in
``granary.llm.queries``.
"""
