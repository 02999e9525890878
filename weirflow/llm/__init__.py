"""Operations for preparing training text at scale.

Nothing outside this subpackage imports it; :mod:`weirflow.llm.queries` holds the thin
queries that apply each operator to a whole table.
"""
