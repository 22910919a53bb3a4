"""Training-data operators: deduplication, scanning, archiving, decontamination, scoring and mixing.

Nothing else in the library imports this subpackage; ``queries`` registers one thin query per operator.
"""
