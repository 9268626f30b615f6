"""Operators for building training corpora; nothing else in tabulon imports this."""
