"""Operators for training data: WARC, quality, language, personal data, duplicates,
chat formatting, decontamination and byte-level BPE. Nothing else imports this package."""
