"""Operators for training-data corpora: near-duplicate joins, decontamination,
quality rules, source mixing, token rollups, secret and licence scans, repeated
substrings, language identification, quality classification, conversation repair,
BPE encoding and Merkle manifests."""
