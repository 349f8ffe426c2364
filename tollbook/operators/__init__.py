"""Analytic operators: ``f(tables, as_of, **parameters) -> DataFrame``.

``tables`` maps table names to DataFrames of the star schema. Every operator is lazy, and
its parameters default to the standard report. ``as_of`` stands for the present moment.

Facts are folded to the reporting keys plus the customer before anything else happens, so
that shuffles carry combined rows and a customer with very many events is one row per
key and task. Only then do customer attributes or windows come in. Lookup joins carry no
broadcast hint: Spark broadcasts a side after checking its size, and sorts it otherwise.
"""
