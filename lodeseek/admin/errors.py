"""Errors with the JSON-RPC codes that tool callers expect."""

from __future__ import annotations


class EngineError(Exception):
    code = -32603

    def __init__(self, message: str, data: object = None, suggestion: str | None = None):
        super().__init__(message)
        self.message, self.data, self.suggestion = message, data, suggestion

    def to_dict(self) -> dict:
        out = {"code": self.code, "message": self.message, "data": self.data, "suggestion": self.suggestion}
        return {k: v for k, v in out.items() if v is not None}


class InvalidParams(EngineError):
    code = -32602


class InternalError(EngineError):
    code = -32603


class MethodNotFound(EngineError):
    code = -32601

    def __init__(self, method: str):
        super().__init__(f"Method not found: {method}")


class NotFound(EngineError):
    code = -32001


class ConfigInvalid(EngineError):
    code = -32002


def as_engine_error(error: object) -> EngineError:
    return error if isinstance(error, EngineError) else InternalError(str(error) or type(error).__name__)
