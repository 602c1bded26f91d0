"""Operators for training-data pipelines: secrets, dedup, quality, fingerprints, WARC, BPE, packing, LM scoring.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
