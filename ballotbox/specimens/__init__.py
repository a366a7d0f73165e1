"""Codes drawn and read back: generators of QR and linear codes, specimen corpora, and a reader for clean upright images."""
