"""Operations of a training-data pipeline over the tables ``documents`` and ``embeddings``.

Each operator has one module; ``queries`` registers one query for each.
"""
