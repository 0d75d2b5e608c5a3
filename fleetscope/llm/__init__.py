"""Operators of a training-data pipeline. Nothing outside this subpackage imports it.

What holds for all of them: whole texts of any length are read, a very long one in one task, and nothing is cut off. An
operator that gives rows of its own reads the id and the text column alone, so other columns may have any name; one that
gives its input's columns back names its own columns so that they clash with none. Equal texts have equal results, repeated
rows each give what one of them gives, and ties go to the smaller id. Each docstring states nulls and empty tables.
"""
