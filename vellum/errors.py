"""Errors that callers may want to tell apart."""


class CorpusError(Exception):
    """The corpus can't be read as asked."""


class BookNotFound(CorpusError):
    """No page of the book is in the corpus."""


class BadBlob(CorpusError):
    """A page's token blob is not a whole number of u32."""
