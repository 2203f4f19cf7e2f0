"""Corpus-preparation operators for training data.

Every module has one operator with a general interface and a thin
``query(spark, sf_dir)`` that applies it to a whole table.
"""
