"""Jobs on text corpora for training data. Nothing outside this package and corpus_pipeline.py imports it."""
