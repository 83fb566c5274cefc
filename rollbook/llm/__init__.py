"""Training-data operators: token files, language ID, decontamination, byte-level BPE, secret,
license and WARC audits, near-duplicates, line quality and sharding.

Nothing else in the package imports this subpackage.
"""
