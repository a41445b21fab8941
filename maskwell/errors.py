"""Errors that say what happened and what to do about it."""

from __future__ import annotations


class ActionableError(ValueError):
    """An error with a fixed set of statements; the message never repeats the text that was processed."""

    FIELDS = ("what", "why", "where", "when", "means", "fix")

    def __init__(self, what: str, why: str, where: str, when: str, means: str, fix: str, cause: BaseException | None = None):
        self.what, self.why, self.where, self.when, self.means, self.fix, self.cause = what, why, where, when, means, fix, cause
        super().__init__(self.render())
        if cause is not None:
            self.__cause__ = cause

    def render(self) -> str:
        lines = [f"{name}: {getattr(self, name)}" for name in self.FIELDS]
        if self.cause is not None:
            lines.append(f"cause: {self.cause}")
        return "\n".join(lines)

    def __reduce__(self):
        return type(self), (self.what, self.why, self.where, self.when, self.means, self.fix, self.cause)
