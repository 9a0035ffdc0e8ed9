"""Operations of a training-data pipeline: ten operators over documents and vectors.

Nothing outside this subpackage imports it.  Each operator has a module of its
own; ``queries`` registers one query per operator and its SQL where there is any.
"""
