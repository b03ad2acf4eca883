"""Operators of a training-data pipeline. Nothing else in the package imports
this subpackage; ``__spark_entry__.py`` registers its queries when it is there."""
