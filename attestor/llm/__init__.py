"""Training-data operators: toxicity, duplicates, mixing, scans, token files, decontamination.

Nothing outside this folder, its tests and ``corpus_pipeline.py`` imports from here.
"""
