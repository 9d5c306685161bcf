"""Training-data operators: quality, dedup, tokenisation, privacy, licences, URL rules.

Each module holds one operator with a general interface; ``registry`` binds
them to the tables as the ``opN_*`` queries.  Nothing else in the library
imports this subpackage.
"""
