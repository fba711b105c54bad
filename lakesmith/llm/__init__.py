"""Operators of a training-data pipeline: filtering, near-duplicate
detection, decontamination, tokenisation, search and sharding.

Nothing outside this package imports it. ``queries.py`` registers one
``opN_<name>`` query per operator and the pipeline of
``corpus_pipeline.py``.
"""
