"""Operators for preparing large text corpora: filters, mixing, tokenizing and the several kinds of deduplication."""
