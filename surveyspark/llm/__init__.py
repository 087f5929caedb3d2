"""Operators for preparing large text corpora: extraction, search,
classification, de-duplication, decontamination, pseudonyms, sharding and
tokenization. Nothing outside this subpackage imports it."""
