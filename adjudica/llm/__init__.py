"""Operations of a training-data pipeline: one module for each operator, nothing outside imports them.

Every operator takes and returns DataFrames.  ``queries.py`` holds the registered queries, ``oracle.py`` the SQL
that states the same results where SQL can.
"""
