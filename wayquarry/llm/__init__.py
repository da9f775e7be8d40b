"""Operations of a training-data pipeline: tokenisation, quality, language models, deduplication, sharding.

Nothing else in the library imports this subpackage.
"""
