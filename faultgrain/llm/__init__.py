"""Training-data operators: language-model scoring, chat formatting, near
duplicates, quality rules, language id, privacy, decontamination, secrets,
line duplicates and sequence packing.

Nothing else in the library imports this subpackage.
"""
