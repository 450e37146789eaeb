"""Training-data operators: mixing, sharding, decontamination, licence scans,
toxicity, PII, two kinds of substring removal, exact top-k, near-dedup,
language-model scores, a source audit and fill-in-middle.

Each module holds one operator with its own general interface; the registered
queries in ``queries.py`` are thin digests of them.  Nothing else in the
library imports this package.
"""
