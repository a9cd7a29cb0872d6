"""Operations of a training-data pipeline: dedup, quality, decontamination, packing and their kin.

Nothing else in the library imports this subpackage. ``queries`` registers one
query per operator.
"""
