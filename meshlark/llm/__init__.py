"""Operations for large training corpora.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; ``queries`` holds the registered queries and their SQL.
"""
