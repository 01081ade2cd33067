"""Operations of a training-data pipeline, each an operator over plain DataFrames.

Nothing else in the library imports this subpackage. ``queries`` registers the
operators over the synthetic tables.
"""
