"""The hashes of word windows, under the name that the operators for training data use."""

from ..functions.hashing import BASE, CACHE_WORDS, WordHasher, concatenated, sliced, windows  # noqa: F401
