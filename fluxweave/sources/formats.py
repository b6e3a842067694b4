"""Settings of the log dialect: address namespace and server names."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class LogFormat:
    """``namespace`` is the first segment of client addresses (``/<namespace>/touch``)
    and the tag of app messages; ``servers`` are the names under which the
    analysis processes write events. Set both to what your logs contain."""

    namespace: str = "ensemble"
    servers: tuple[str, ...] = field(default=("LiveProc", "WebProc"))
    separator: str = ", "

    def address(self, path: str) -> str:
        return f"/{self.namespace}/{path}"


DEFAULT_FORMAT = LogFormat()
