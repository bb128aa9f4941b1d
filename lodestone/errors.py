"""Errors with a code and a hint."""

from __future__ import annotations


class LodestoneError(Exception):
    code, hint = "E000", ""

    def __init__(self, message: str, hint: str | None = None):
        super().__init__(message)
        self.hint = self.hint if hint is None else hint

    def __str__(self) -> str:
        text = f"[{self.code}] {super().__str__()}"
        return f"{text} ({self.hint})" if self.hint else text


class NotFound(LodestoneError):
    code, hint = "E001", "check the path"


class UnsupportedFormat(LodestoneError):
    code, hint = "E002", "use csv or parquet, or pass strict=False for json and orc"


class QueryError(LodestoneError):
    code = "E003"


class FilterSyntax(LodestoneError):
    code, hint = "E004", "sizes: >1MB, 1KB-2KB, gt:5; times: -7d, +30d, 2024-01-01"


class SearchSyntax(LodestoneError):
    code, hint = "E005", 'words, +must, -not, AND, OR, NOT, "phrases", (groups), prefix*, ~fuzzy'


class ExportError(LodestoneError):
    code = "E006"


class ConfigError(LodestoneError):
    code = "E007"


class IndexFailed(LodestoneError):
    code, hint = "E008", "build the index again"


class IndexConflict(IndexFailed):
    """Another writer was there first."""


class SearchFailed(LodestoneError):
    code = "E009"


class ProcessFailed(LodestoneError):
    code = "E010"


class ReadFailed(LodestoneError):
    code, hint = "E011", "is the file there, and may it be read?"


class ParseFailed(LodestoneError):
    code, hint = "E012", "check the options of the reader"


class Invalid(LodestoneError):
    code = "E013"


class HistoryFailed(LodestoneError):
    code, hint = "E014", "clear the history"


class TimedOut(LodestoneError):
    code, hint = "E015", "ask for less, or raise the limit"


class NotPermitted(LodestoneError):
    code, hint = "E016", "check the rights of the file"


class OverLimit(LodestoneError):
    code = "E017"

    def __init__(self, what: str, current: int, most: int):
        super().__init__(f"{what}: {current} is over {most}")


class ModelFailed(LodestoneError):
    code, hint = "E018", "check the model and tokenizer files"


def from_os(e: OSError) -> LodestoneError:
    """Errors of the system as ours."""
    kind = NotFound if isinstance(e, FileNotFoundError) else NotPermitted if isinstance(e, PermissionError) else TimedOut if isinstance(e, TimeoutError) else ReadFailed
    return kind(f"{e.strerror}: {e.filename}")
