"""Training-data operators: filters, fingerprints, scans, classifiers and joins over a text corpus.

Nothing else in the library imports this subpackage.
"""
