"""Errors with a message for users and a detail for logs."""


class PagemillError(Exception):
    user_message = "The request could not be handled."

    def __init__(self, detail: str = "", user_message: str | None = None):
        super().__init__(detail or self.user_message)
        self.detail = detail
        self.user_message = user_message or self.user_message


class ConfigError(PagemillError):
    user_message = "The settings are not valid."


class DocumentError(PagemillError):
    user_message = "The document could not be read."


class DocumentMissing(DocumentError):
    user_message = "The document was not found."


class DocumentInvalid(DocumentError):
    user_message = "The file is not a readable document."


class DocumentEncrypted(DocumentError):
    user_message = "The document needs a password."


class IndexError_(PagemillError):
    user_message = "The index is not available."


class IndexMissing(IndexError_):
    user_message = "The index has not been built."


class ModelMismatch(IndexError_):
    user_message = "The index was built with another embedding model."


class EmbeddingError(PagemillError):
    user_message = "The embedding service failed."


class CompletionError(PagemillError):
    user_message = "The language model failed."


class EmptyQuestion(PagemillError):
    user_message = "The question is empty."


class InvalidRequest(PagemillError):
    user_message = "The request is out of bounds."


class InvalidChunk(PagemillError):
    user_message = "A chunk's payload does not match its type."


def from_worker(message: str) -> PagemillError | None:
    """The library's error that a Python worker's traceback ends with, as Spark hands it to the driver; else none."""
    kinds: dict[str, type[PagemillError]] = {}
    open_ = [PagemillError]
    while open_:
        kind = open_.pop()
        kinds[f"{kind.__module__}.{kind.__name__}"] = kind
        open_ += kind.__subclasses__()
    for line in reversed(message.splitlines()):
        name, _, detail = line.strip().partition(": ")
        if name in kinds:
            return kinds[name](detail)
    return None
