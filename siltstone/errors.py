"""Errors of the table engine."""


class TableError(Exception):
    """Carries the text that a lookup result shows."""

    def __str__(self) -> str:
        return f"io err: {self.args[0]}" if self.args else "io err"


class KeyNotFound(TableError):
    def __init__(self) -> None:
        super().__init__("Key not found")


class LogMissing(TableError):
    def __init__(self) -> None:
        super().__init__("File not found")


class LogDisabled(TableError):
    def __init__(self) -> None:
        super().__init__("WAL is disabled")


class CommitConflict(TableError):
    """Another writer has committed the version that this one was about to write."""


KEY_NOT_FOUND = str(KeyNotFound())
