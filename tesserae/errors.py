"""Error classes of the engine."""
from __future__ import annotations


class EngineError(Exception):
    pass


class ValidationError(EngineError, ValueError):
    def __init__(self, field: str, message: str):
        super().__init__(message)
        self.field = field


class ConfigurationError(EngineError):
    pass


class StoreError(EngineError):
    pass


class EmbeddingError(EngineError):
    pass


class NotFoundError(EngineError):
    def __init__(self, ids):
        self.ids = list(ids)
        super().__init__(f"not found: {', '.join(map(str, self.ids))}")


class JudgeError(EngineError):
    """A judge could not be asked. Its message holds no text that was judged."""
