"""Settings from a mapping such as ``os.environ``; what can't be read is refused, not guessed."""

from __future__ import annotations

from collections.abc import Mapping

TRUE, FALSE = frozenset({"1", "t", "true"}), frozenset({"0", "f", "false"})


def text(source: Mapping[str, str], name: str, default: str | None = None) -> str:
    value = source.get(name, "").strip()
    if value:
        return value
    if default is None:
        raise ValueError(f"{name} is not set")
    return default


def items(source: Mapping[str, str], name: str, default: list[str] | None = None) -> list[str]:
    """Parts between commas, without empty ones; a setting of nothing but commas is refused."""
    raw = source.get(name, "").strip()
    if not raw:
        if default is None:
            raise ValueError(f"{name} is not set")
        return default
    found = [x.strip() for x in raw.split(",") if x.strip()]
    if not found:
        raise ValueError(f"{name}: an empty list")
    return found


def integer(source: Mapping[str, str], name: str, default: int | None = None, least: int | None = None) -> int:
    raw = text(source, name, None if default is None else str(default))
    try:
        value = int(raw)
    except ValueError:
        raise ValueError(f"{name}: not a whole number: {raw!r}") from None
    if least is not None and value < least:
        raise ValueError(f"{name}: below {least}: {value}")
    return value


def boolean(source: Mapping[str, str], name: str, default: bool | None = None) -> bool:
    raw = text(source, name, None if default is None else str(default)).lower()
    if raw not in TRUE | FALSE:
        raise ValueError(f"{name}: neither true nor false: {raw!r}")
    return raw in TRUE
