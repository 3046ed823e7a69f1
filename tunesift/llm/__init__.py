"""Training-data operators: near-duplicate search, sharding, fingerprints,
language and toxicity models, packing, WARC files, source mixing and
language-model scoring.  Nothing else in the library imports this subpackage;
``plans`` holds the registered queries.
"""
