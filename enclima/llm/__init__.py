"""Training-data operators: dedup, decontamination, mixing, sharding, chat
formatting, URL filters, embedding near-dedup and language identification.

Nothing else in the library imports this subpackage.
"""
